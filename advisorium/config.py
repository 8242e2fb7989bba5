"""Settings from the environment, with a ``.env`` file behind it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "ADVISORIUM_"


@dataclass(frozen=True)
class Settings:
    """Where tables and state lie, and how the reader and the collectors behave."""

    folder: str = "data"
    address: str = "127.0.0.1:8080"
    token: str = ""
    sources: tuple[str, ...] = ()
    csaf_providers: tuple[str, ...] = ()
    scan_minimum: str = "possible"
    page_limit: int = 100


def read_env_file(path: str) -> dict[str, str]:
    """``KEY=value`` lines, quotes removed; comments and anything else are passed over."""
    out: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("\"'")
    return out


def load(environment: Mapping[str, str] | None = None, env_file: str = ".env") -> Settings:
    """Settings by name; the environment goes before the file. A number that is none, or a wrong choice, is an error."""
    given = read_env_file(env_file) | dict(os.environ if environment is None else environment)
    known = {}
    for f in fields(Settings):
        text = given.get(PREFIX + f.name.upper())
        if text is None or (text == "" and f.name != "token"):
            continue
        if isinstance(f.default, tuple):
            known[f.name] = tuple(x.strip() for x in text.split(",") if x.strip())
        elif isinstance(f.default, int):
            if not text.isdigit() or int(text) < 1:
                raise ValueError(f"{PREFIX}{f.name.upper()} is no positive number: {text}")
            known[f.name] = int(text)
        else:
            known[f.name] = text
    out = Settings(**known)
    if out.scan_minimum not in ("possible", "probable", "confirmed"):
        raise ValueError(f"{PREFIX}SCAN_MINIMUM is possible, probable or confirmed")
    return out
