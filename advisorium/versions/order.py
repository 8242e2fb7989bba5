"""Version orders of eight schemes, with a refusal where a scheme has no answer.

Schemes that order every pair they can read have a key: a nested tuple whose natural order is the scheme's order,
which ``sort_text`` writes as a string that sorts alike, so ranges become comparisons of plain columns. The generic
scheme is a partial order and has no key.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import zip_longest
from typing import NamedTuple

SCHEMES = ("semver", "debian", "rpm", "alpine", "maven", "python", "go", "generic", "opaque")

# Words that stand for no version, in lower case.
ALL_WORDS = ("*", "-", "any", "all", "all versions")
UNKNOWN_WORDS = ("unspecified", "unknown", "n/a", "na", "none", "not applicable")
# Pre-release words of the generic scheme and suffixes of Alpine with their ranks.
PRE_WORDS = {"dev": 0, "devel": 0, "alpha": 1, "beta": 2, "milestone": 3, "snapshot": 4, "pre": 5, "preview": 5, "cr": 6, "rc": 6}
APK_SUFFIXES = {"alpha": -4, "beta": -3, "pre": -2, "rc": -1, "cvs": 1, "svn": 2, "git": 3, "hg": 4, "p": 5}
# Maven's qualifiers in order, and other spellings of them.
MAVEN_QUALIFIERS = ("alpha", "beta", "milestone", "rc", "snapshot", "", "sp")
MAVEN_SPELLINGS = {"ga": "", "final": "", "release": "", "cr": "rc"}
MAVEN_SHORT = {"a": "alpha", "b": "beta", "m": "milestone"}
# Scheme by declared range type and by ecosystem.
RANGE_TYPES = {
    "semver": ("SEMVER", "NPM", "NODE", "CARGO", "NUGET"),
    "debian": ("DEBIAN", "DEB", "DPKG"),
    "rpm": ("RPM", "NEVRA", "EVR"),
    "alpine": ("APK", "ALPINE"),
    "maven": ("MAVEN",),
    "python": ("PYTHON", "PYPI", "PEP440"),
    "go": ("GO", "GOLANG"),
    "opaque": ("GIT", "ORIGINAL_COMMIT_FOR_FIX", "COMMIT", "SHA", "REVISION_ID"),
}
ECOSYSTEMS = {
    "debian": ("debian", "ubuntu", "opam"),
    "rpm": ("red hat", "redhat", "rhel", "rocky linux", "rocky", "almalinux", "alma", "suse", "opensuse", "sles", "mageia", "openeuler", "azure linux", "mariner", "cbl-mariner", "oracle linux", "centos", "fedora", "amazon linux", "photon", "openanolis", "anolis"),
    "alpine": ("alpine", "wolfi", "chainguard", "alpaquita", "bellsoft hardened containers"),
    "semver": ("npm", "crates.io", "cratesio", "rust", "nuget", "pub", "hex", "erlang", "swifturl", "swift", "github actions", "actions", "julia", "vscode", "packagist", "composer", "rubygems", "linux"),
    "maven": ("maven",),
    "python": ("pypi", "pip"),
    "go": ("go", "golang"),
    "generic": ("cran", "hackage", "ghc", "android", "gsd", "uvi", "bitnami", "minimos", "echo", "root", "cleanstart", "tuxcare"),
    "opaque": ("git", "oss-fuzz"),
}
#: Ecosystems that repack others; what follows their colon tells the order.
REISSUERS = {"tuxcare", "root", "bitnami", "minimos", "echo", "cleanstart"}

TYPE_SCHEME = {t: s for s, names in RANGE_TYPES.items() for t in names}
ECOSYSTEM_SCHEME = {e: s for s, names in ECOSYSTEMS.items() for e in names}


class Answer(NamedTuple):
    """cmp -1, 0 or 1; exact is False where a convention and not the scheme decided."""

    cmp: int
    exact: bool


def clean(text: str | None) -> str:
    """Trimmed, and without matching quotes around it."""
    s = (text or "").strip()
    while len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'":
        s = s[1:-1].strip()
    return s


def sentinel(text: str | None) -> str:
    """``empty``, ``all``, ``unknown`` or ``zero``; ``""`` for what may be a version."""
    s = clean(text).lower()
    return "empty" if not s else "all" if s in ALL_WORDS else "unknown" if s in UNKNOWN_WORDS else "zero" if s == "0" else ""


def is_commit(text: str | None) -> bool:
    """7 to 64 hexadecimal digits with a letter, or at least 32 of them."""
    s = clean(text)
    return bool(re.fullmatch(r"[0-9a-fA-F]{7,64}", s)) and (len(s) >= 32 or not s.isdigit())


def scheme_for(range_type: str | None, ecosystem: str | None) -> str:
    """By declared type, else by ecosystem, else generic. Of a reissuer's ecosystem the part after the colon counts."""
    if s := TYPE_SCHEME.get((range_type or "").strip().upper()):
        return s
    parts = [p.strip().lower() for p in (ecosystem or "").split(":")]
    if parts[0] in ECOSYSTEM_SCHEME and parts[0] not in REISSUERS:
        return ECOSYSTEM_SCHEME[parts[0]]
    for name in (*parts[1:2], parts[0]):
        if name in ECOSYSTEM_SCHEME:
            return ECOSYSTEM_SCHEME[name]
    return "generic"


def number(digits: str) -> tuple:
    """Key of a digit string of any length; leading zeros do not matter."""
    t = digits.lstrip("0")
    return (len(t), t)


ZERO = number("0")


def _without_v(s: str) -> str:
    return s[1:] if re.match(r"[vV]\d", s) else s


def _release(parts: list[str]) -> tuple:
    """Key of numbers that are padded with zeros when compared."""
    keys = [number(p) for p in parts]
    while keys and keys[-1] == ZERO:
        keys.pop()
    return tuple(keys)


def _digits(s: str) -> bool:
    return s.isascii() and s.isdigit()


def semver_key(s: str) -> tuple[tuple, bool] | None:
    s = _without_v(clean(s).removeprefix("=")).split("+", 1)[0]
    core, dash, pre = s.partition("-")
    exact = not (dash and not pre)
    parts = core.split(".")
    if m := next((i for i, p in enumerate(parts) if i and not dash and re.match("[A-Za-z]", p)), None):
        parts, pre, exact = parts[:m], ".".join(parts[m:]), False
    if not all(_digits(p) for p in parts):
        return None
    exact = exact and len(parts) <= 3 and not any(len(p) > 1 and p[0] == "0" for p in parts)
    ids = tuple((0, number(p)) if _digits(p) else (1, p) for p in pre.split(".")) if pre else ()
    return (_release(parts), (0, ids) if ids else (1, ())), exact


def _run_key(s: str) -> tuple:
    weight = {"~": -1}
    return (*(weight.get(c, ord(c) if c.isascii() and c.isalpha() else ord(c) + 256) for c in s), 0)


def _debian_part(s: str) -> tuple:
    runs = re.findall(r"(\D*)(\d*)", s)
    return (*((_run_key(a), number(d)) for a, d in runs if a or d), (_run_key(""), ZERO))


def debian_key(s: str) -> tuple[tuple, bool]:
    head, colon, rest = s.partition(":")
    exact = True
    if not colon:
        head, rest = "0", s
    elif not _digits(head):
        head, rest, exact = "0", s, False
    upstream, _, revision = rest.rpartition("-") if "-" in rest else (rest, "", "")
    exact = exact and bool(re.fullmatch(r"\d[A-Za-z0-9.+:~-]*", upstream, re.A)) and bool(re.fullmatch(r"[A-Za-z0-9.+~]*", revision))
    return (number(head), _debian_part(upstream), _debian_part(revision)), exact


def _rpm_part(s: str) -> tuple:
    def segment(t: str) -> tuple:
        return (0,) if t == "~" else (2,) if t == "^" else (4, number(t)) if _digits(t) else (3, t)

    return (*map(segment, re.findall(r"~|\^|[0-9]+|[A-Za-z]+", s)), (1,))


def rpm_key(s: str) -> tuple[tuple, bool]:
    head, colon, rest = s.partition(":")
    if not colon or not _digits(head):
        head, rest = "0", s
    version, _, release = rest.rpartition("-") if "-" in rest else (rest, "", "")
    return (number(head), _rpm_part(version), _rpm_part(release)), True


_APK = re.compile(r"(\d+(?:\.\d+)*)([A-Za-z]?)((?:_[A-Za-z]+\d*)*)(?:-r(\d+))?", re.A)


def alpine_key(s: str) -> tuple[tuple, bool] | None:
    m = _APK.fullmatch(_without_v(s))
    if not m:
        return None
    suffixes = []
    for word, n in re.findall(r"_([A-Za-z]+)(\d*)", m[3]):
        if word.lower() not in APK_SUFFIXES:
            return None
        suffixes.append((APK_SUFFIXES[word.lower()], (1, number(n)) if n else (0,)))
    first, *more = m[1].split(".")
    zeros = lambda p: len(p) - len(p.lstrip("0"))
    numbers = (number(first), *((0, -zeros(p), number(p)) if zeros(p) else (1, 0, number(p)) for p in more))
    return (numbers, m[2].lower(), (*suffixes, (0,)), (1, number(m[4])) if m[4] else (0,)), True


_PEP440 = re.compile(
    r"v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?"
    r"((?:-(\d+))|(?:[-_.]?(?:post|rev|r)[-_.]?(\d+)?))?([-_.]?dev[-_.]?(\d+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?",
    re.A,
)


def python_key(s: str) -> tuple[tuple, bool] | None:
    m = _PEP440.fullmatch(clean(s).lower())
    if not m:
        return None
    epoch, release, pre, pre_n, post, post_a, post_b, dev, dev_n, local = m.groups()
    stage = {"a": 0, "b": 1}.get(pre[0], 2) if pre else -1 if dev and not post else 3
    marks = tuple((1, number(p)) if _digits(p) else (0, p) for p in re.split(r"[-_.]", local)) if local else ()
    return (
        number(epoch or "0"), _release(release.split(".")), stage, number(pre_n or "0"),
        (1, number(post_a or post_b or "0")) if post else (0,), (0, number(dev_n or "0")) if dev else (1,), marks,
    ), True


KEYS = {"semver": semver_key, "go": semver_key, "debian": debian_key, "rpm": rpm_key, "alpine": alpine_key, "python": python_key}


def maven_tree(s: str) -> list:
    """Nested lists of numbers and qualifiers, split at hyphens and between digits and letters, null ends removed."""
    root: list = []
    levels = [root]

    def deeper() -> None:
        levels[-1].append(inner := [])
        levels.append(inner)

    tokens = re.findall(r"[0-9]+|[^0-9.\-]+|[.\-]", s.lower())
    previous = "."
    for i, t in enumerate(tokens):
        following = tokens[i + 1] if i + 1 < len(tokens) else ""
        if t in ".-":
            if previous in ".-":
                levels[-1].append(ZERO)
            if t == "-":
                deeper()
        elif _digits(t):
            if previous not in ".-":
                deeper()
            levels[-1].append(number(t))
        else:
            glued = _digits(following)
            if previous not in ".-" or ((glued or not following) and levels[-1]):
                deeper()
            word = MAVEN_SHORT.get(t, t) if glued else t
            levels[-1].append(MAVEN_SPELLINGS.get(word, word))
        previous = t
    for level in reversed(levels):
        for i in range(len(level) - 1, -1, -1):
            if level[i] in (ZERO, "", []):
                del level[i]
            elif not isinstance(level[i], list):
                break
    return root


def _qualifier(word: str) -> tuple:
    return (MAVEN_QUALIFIERS.index(word), "") if word in MAVEN_QUALIFIERS else (len(MAVEN_QUALIFIERS), word)


def _cmp(a, b) -> int:
    return (a > b) - (a < b)


def maven_compare(a, b) -> int:
    """Order of two tree items; None stands for a missing one."""
    if a is None:
        return 0 if b is None else -maven_compare(b, None)
    kind = lambda x: 2 if isinstance(x, tuple) else 1 if isinstance(x, list) else 0  # noqa: E731  word < list < number
    if b is None:
        if isinstance(a, list):
            return next((c for x in a if (c := maven_compare(x, None))), 0)
        return _cmp(a, ZERO) if isinstance(a, tuple) else _cmp(_qualifier(a), _qualifier(""))
    if kind(a) != kind(b):
        return _cmp(kind(a), kind(b))
    if isinstance(a, list):
        return next((c for x, y in zip_longest(a, b) if (c := maven_compare(x, y))), 0)
    return _cmp(a, b) if isinstance(a, tuple) else _cmp(_qualifier(a), _qualifier(b))


class _Token(NamedTuple):
    text: str
    sep: str  # the separator just before it, or ""


def _generic(s: str) -> tuple[list[str], list[_Token]] | None:
    s = _without_v(s)
    m = re.match(r"\d+(?:\.\d+)*", s, re.A)
    if not m or re.match(r"\d+:", s):
        return None  # no numeric core, or an epoch
    tail = [_Token(t, sep[-1:]) for sep, t in re.findall(r"([^0-9A-Za-z]*)([0-9]+|[A-Za-z]+)", s[m.end() :])]
    return m[0].split("."), tail


def _tail_side(rest: list[_Token]) -> Answer | None:
    """Order of a version with this further tail against one without it."""
    first = rest[0]
    if first.sep == "~" or first.text.lower() in PRE_WORDS:
        return Answer(-1, False)
    if any(t.sep in ("-", "_", "+", "~") and t.sep for t in rest) or not _digits(first.text):
        return None
    return Answer(1, not (first.sep == "" or (len(rest) > 1 and rest[1].sep == "")))


def generic_compare(a: str, b: str) -> Answer | None:
    """Partial order for versions of no known scheme; None refuses."""
    x, y = _generic(a), _generic(b)
    if x is None or y is None:
        return None
    (core_a, tail_a), (core_b, tail_b) = x, y
    exact = True
    beside = lambda tail: not tail or tail[0].sep in ("-", "~")
    for i, (p, q) in enumerate(zip_longest(core_a, core_b, fillvalue="0")):
        if c := _cmp(number(p), number(q)):
            past = (i >= len(core_a) and not beside(tail_a)) or (i >= len(core_b) and not beside(tail_b))
            return None if past else Answer(c, exact)
        exact = exact and p == q
    if not tail_a and not tail_b:
        return Answer(0, exact)
    if len(core_a) != len(core_b):
        return None
    glued = lambda tail, i: tail[i].sep == "" or (i + 1 < len(tail) and tail[i + 1].sep == "")
    for i in range(max(len(tail_a), len(tail_b))):
        if i >= len(tail_a) or i >= len(tail_b):
            side = _tail_side((tail_a or tail_b)[i:] if i < len(tail_a) else tail_b[i:])
            return side and Answer(side.cmp if i < len(tail_a) else -side.cmp, exact and side.exact)
        p, q = tail_a[i], tail_b[i]
        if (p.sep == "~") != (q.sep == "~"):
            return Answer(-1 if p.sep == "~" else 1, False)
        if p.sep != q.sep or _digits(p.text) != _digits(q.text):
            return None
        if _digits(p.text):
            exact = exact and not glued(tail_a, i) and not glued(tail_b, i)
            if c := _cmp(number(p.text), number(q.text)):
                return Answer(c, exact)
            exact = exact and p.text == q.text
        elif p.text.lower() != q.text.lower():
            ranks = PRE_WORDS.get(p.text.lower()), PRE_WORDS.get(q.text.lower())
            if None in ranks:
                return None
            exact = False
            if c := _cmp(*ranks):
                return Answer(c, False)
    return Answer(0, exact)


@lru_cache(maxsize=200_000)
def version_key(scheme: str, text: str) -> tuple[tuple, bool] | None:
    """Key and certainty, or None where the scheme cannot read the text or has no key."""
    return KEYS[scheme](text) if scheme in KEYS else None


def compare(scheme: str, a: str | None, b: str | None) -> Answer | None:
    """Order of two versions, or None where they are not comparable.

    Sentinels but zero, and commits, are no versions. Equal texts are equal before anything is read. Where a scheme
    cannot read an operand the generic order decides, and then never exactly.
    """
    if scheme == "opaque" or any(sentinel(t) in ("empty", "all", "unknown") or is_commit(t) for t in (a, b)):
        return None
    x, y = clean(a), clean(b)
    if x == y:
        return Answer(0, True)
    if scheme == "maven":
        return Answer(maven_compare(maven_tree(x), maven_tree(y)), True)
    if scheme in KEYS:
        p, q = version_key(scheme, x), version_key(scheme, y)
        if p and q:
            return Answer(_cmp(p[0], q[0]), p[1] and q[1])
        rough = generic_compare(x, y)
        return rough and Answer(rough.cmp, False)
    return generic_compare(x, y)


def sort_text(key) -> str:
    """A key as a string whose order by code points is the order of the key."""
    if isinstance(key, tuple):
        return "".join("\x02" + sort_text(k) for k in key) + "\x01"
    return f"{key + 50_000:07d}" if isinstance(key, int) else key + "\x00"
