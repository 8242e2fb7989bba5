"""Names of packages: lookup keys and folds as expressions, package URLs, platform names and ecosystems in Python."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from advisorium.functions.text import as_column

# Ecosystem families with their spellings, and what each is called in advisories.
FAMILIES = {
    "npm": ("npm", "node"),
    "pypi": ("pypi",),
    "maven": ("maven", "maven.org"),
    "go": ("go", "golang"),
    "cargo": ("cargo", "crates.io", "crates"),
    "rubygems": ("gem", "rubygems"),
    "nuget": ("nuget",),
    "packagist": ("composer", "packagist"),
    "hex": ("hex",),
    "pub": ("pub",),
    "cran": ("cran",),
    "hackage": ("hackage",),
    "swifturl": ("swift", "swifturl"),
    "opam": ("opam",),
    "julia": ("julia",),
    "github actions": ("githubactions", "github actions", "github"),
    "bitnami": ("bitnami",),
    "debian": ("debian", "raspbian"),
    "ubuntu": ("ubuntu", "linuxmint", "linux mint"),
    "redhat": ("red hat", "redhat", "rhel"),
    "fedora": ("fedora",),
    "centos": ("centos",),
    "rocky": ("rocky linux", "rocky"),
    "almalinux": ("almalinux", "alma"),
    "suse": ("suse", "sles"),
    "opensuse": ("opensuse", "opensuse-leap", "opensuse leap", "opensuse tumbleweed"),
    "azurelinux": ("azure linux", "azurelinux", "mariner", "cbl-mariner"),
    "openeuler": ("openeuler",),
    "mageia": ("mageia",),
    "photon": ("photon os", "photon"),
    "alpine": ("alpine",),
    "wolfi": ("wolfi",),
    "chainguard": ("chainguard",),
    "minimos": ("minimos",),
    "alpaquita": ("alpaquita",),
    "echo": ("echo",),
    "root": ("root",),
    "cleanstart": ("cleanstart",),
    "bellsoft": ("bellsoft hardened containers",),
    "linux": ("linux",),
    "oss-fuzz": ("oss-fuzz",),
    "android": ("android",),
    "gsd": ("gsd",),
    "uvi": ("uvi",),
    "vscode": ("vscode",),
}
# Families that are distributions, and those of programming languages.
DISTROS = frozenset({
    "debian", "ubuntu", "redhat", "fedora", "centos", "rocky", "almalinux", "suse", "opensuse", "azurelinux", "openeuler", "mageia",
    "photon", "alpine", "wolfi", "chainguard", "minimos", "alpaquita", "echo", "root", "cleanstart", "bellsoft",
})
LANGUAGES = frozenset({"npm", "pypi", "maven", "go", "cargo", "rubygems", "nuget", "packagist", "hex", "pub", "cran", "hackage", "swifturl", "opam", "julia", "github actions"})
#: Families whose package names ignore letter case.
CASELESS = DISTROS | {"npm", "packagist", "hex", "pub", "opam", "nuget", "github actions", "bitnami"}
# Types of package URLs whose names ignore letter case, and legal forms at the end of company names.
CASELESS_TYPES = frozenset({
    "npm", "composer", "hex", "pub", "opam", "githubactions", "nuget", "deb", "rpm", "apk", "alpm", "generic", "docker", "oci", "conan",
    "bitnami",
})
CORPORATE = (
    "inc", "corp", "corporation", "ltd", "llc", "gmbh", "ag", "sa", "bv", "co", "company", "foundation", "project",
)
FAMILY_OF = {s: f for f, spellings in FAMILIES.items() for s in spellings}


def purl_key(c: Column | str) -> Column:
    """Lookup key of a package URL: in lower case, without qualifiers, subpath and version."""
    bare = F.split_part(F.split_part(as_column(c), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return F.lower(F.regexp_replace(bare, "@[^/@]*$", ""))


def folded_name(c: Column | str) -> Column:
    """Name in lower case, runs of separators as one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(as_column(c))), r"[ \t_./-]+", "-"), F.lit("-"))


def folded_vendor(c: Column | str) -> Column:
    """Folded name without leading articles and trailing legal forms, of which one word always remains."""
    ends = "|".join(CORPORATE)
    bare = F.regexp_replace(folded_name(c), r"^(?:the-)+(?=.)", "")
    return F.regexp_replace(bare, rf"(?<=.)(?:-(?:{ends}))+$", "")


def pep503(c: Column | str) -> Column:
    """Python project name: lower case, runs of ``-_.`` as one hyphen."""
    return F.regexp_replace(F.lower(as_column(c)), r"[-_.]+", "-")


@dataclass(frozen=True)
class Purl:
    type: str
    namespace: str
    name: str
    version: str
    epoch: str
    distro: str

    @property
    def canonical(self) -> str:
        return "/".join(p for p in (f"pkg:{self.type}", self.namespace, self.name) if p)


def fold(name: str | None) -> str:
    """``folded_name`` of one text."""
    return re.sub(r"[ \t_./-]+", "-", (name or "").strip().lower()).strip("-")


def fold_vendor(name: str | None) -> str:
    words = fold(name).split("-")
    while len(words) > 1 and words[0] == "the":
        words.pop(0)
    while len(words) > 1 and words[-1] in CORPORATE:
        words.pop()
    return "-".join(words)


@lru_cache(maxsize=100_000)
def parse_purl(text: str | None) -> Purl | None:
    """A package URL in its canonical letter case; None for anything else. ``+`` is an ordinary character."""
    s = (text or "").strip()
    if not re.match("(?i)pkg:", s):
        return None
    path, _, quals = s[4:].lstrip("/").partition("#")[0].partition("?")
    head, at, version = path.rpartition("@")
    if not at or "/" in version:
        head, version = path, ""
    parts = [p for p in head.split("/") if p]
    if len(parts) < 2 or not unquote(parts[-1]):
        return None
    kind, namespace, name = parts[0].lower(), "/".join(map(unquote, parts[1:-1])), unquote(parts[-1])
    stated = {k.strip().lower(): unquote(v) for k, eq, v in (q.partition("=") for q in quals.split("&")) if eq}
    if kind == "pypi":
        namespace, name = namespace.lower(), re.sub("[-_.]+", "-", name.lower())
    elif kind in CASELESS_TYPES:
        namespace, name = namespace.lower(), name.lower()
    elif kind == "golang":
        host, slash, rest = namespace.partition("/")
        namespace = host.lower() + slash + rest
    return Purl(kind, namespace, name, unquote(version), stated.get("epoch", ""), stated.get("distro", ""))


def family(name: str | None) -> str:
    s = (name or "").strip().lower()
    return FAMILY_OF.get(s, s)


def _numbers_itself(name: str | None) -> bool:
    """Linux Mint counts its releases on its own."""
    return (name or "").strip().lower() in ("linuxmint", "linux mint")


def _release(text: str) -> str:
    return re.sub(r"^v(?=\d)", "", text.strip().lower())


@lru_cache(maxsize=100_000)
def split_ecosystem(text: str | None) -> tuple[str, str]:
    """(family, release) of an ecosystem such as ``Debian:12``."""
    head, _, tail = (text or "").strip().partition(":")
    f = family(head)
    release = "" if _numbers_itself(head) else _release(tail.partition(":")[0])
    return f, re.sub("^rhel[_-]", "", release) if f == "redhat" else release


def purl_ecosystem(p: Purl) -> tuple[str, str]:
    """(family, release) of a package URL; distributions are named by the namespace and the distro qualifier."""
    packaged = p.type in ("deb", "rpm", "apk", "alpm")
    f = family(p.namespace if packaged else p.type)
    own = packaged and _numbers_itself(p.namespace)
    rest = p.distro
    before, dash, after = rest.rpartition("-")
    if dash and family(before) == f and f:
        own, rest = own or _numbers_itself(before), after
    release = _release(rest)
    if release[:1].isdigit():
        parts = release.split(".")
        if f in ("debian", "rocky", "almalinux", "redhat"):
            release = parts[0]
        elif f in ("alpine", "ubuntu") and len(parts) > 2:
            release = ".".join(parts[:2])
    return f, "" if own else release


def ecosystem_name(f: str, name: str) -> str:
    """Package name as its ecosystem compares it."""
    name = name.strip()
    return re.sub("[-_.]+", "-", name.lower()) if f == "pypi" else name.lower() if f in CASELESS else name


CPE_FIELDS = ("part", "vendor", "product", "version", "update", "edition", "language", "sw_edition", "target_sw", "target_hw", "other")


@lru_cache(maxsize=100_000)
def parse_cpe(text: str | None) -> dict[str, str] | None:
    """The eleven attributes of a platform name in either form; missing ones are ``*``. None for anything else."""
    s = (text or "").strip()
    if re.match("(?i)cpe:2\\.3:", s):
        fields = _escaped_split(s)
        if len(fields) != 13:
            return None
        values = fields[2:]
    elif re.match("(?i)cpe:/", s):
        values = (s[5:].split(":") + [""] * 7)[:7]
        if values[5].startswith("~"):
            packed = (values[5].split("~") + [""] * 6)[:6]
            values = [*values[:5], packed[1], values[6], *packed[2:6]]
        values = [unquote(v) for v in values]
    else:
        return None
    values = [*values, *[""] * (11 - len(values))]
    return {k: v.strip() or "*" for k, v in zip(CPE_FIELDS, values)}


def _escaped_split(s: str) -> list[str]:
    """Split at colons that no backslash escapes."""
    return re.sub(r"((?:^|[^\\])(?:\\\\)*):", "\\1\x00", re.sub(r"((?:^|[^\\])(?:\\\\)*):", "\\1\x00", s)).split("\x00")


def unescaped(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def has_wildcard(s: str) -> bool:
    return bool(re.match(r"(?:\\.|[^\\*?])*[*?]", s))


@lru_cache(maxsize=20_000)
def _glob(pattern: str) -> re.Pattern:
    out = []
    for m in re.finditer(r"\\(.)|(\*)|(\?)|(.)", pattern.lower(), re.S):
        out.append(".*" if m[2] else "." if m[3] else re.escape(m[1] or m[4]))
    return re.compile("".join(out), re.S)


def glob_match(pattern: str, value: str) -> bool:
    """``*`` and ``?`` with backslash escapes, letter case aside."""
    return bool(_glob(pattern).fullmatch(value.lower()))
