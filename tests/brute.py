"""Plain Python versions of the operators, row by row, to compare with."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
MON = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ABBR = {"z": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cet": 1, "cest": 2}
STAND_INS = {"", "-", "?", "n/a", "none", "null", "unknown", "tbd", "not assigned", "cve-0000-0000"}


def norm_id(text):
    if text is None:
        return None
    t = text.strip()
    if t.lower() in STAND_INS:
        return None
    if re.match(r"(?i)^(cve|euvd|gcve)-", t):
        return t.upper()
    if re.match(r"(?i)^ghsa-", t):
        return "GHSA-" + t[5:].lower()
    return t


def us(dt):
    return (dt - EPOCH) // timedelta(microseconds=1)


def read_time(text, zone):
    """(instant in microseconds, calendar day) or None."""
    if text is None:
        return None
    t = re.sub(r"\s+", " ", text.strip())
    if re.fullmatch(r"\d{10}", t):
        return int(t) * 10**6, None
    if re.fullmatch(r"\d{13}", t):
        return int(t) * 1000, None
    t = re.sub(r"\[.*\]$", "", t)
    off = None
    if m := re.search(r"(\d\d?:\d\d(?::\d\d)?(?:[.,]\d+)?(?: ?[AP]M\b)?|T\d{6}) ?(Z|[A-Za-z]+/[A-Za-z_]+|[A-Z]{3,4}|[+-]\d\d(?::?\d\d)?)$", t, re.I):
        if not re.fullmatch("[AP]M", m[2], re.I):
            off, t = m[2], t[: m.start(2)].strip()
    day = None
    clock = None
    if m := re.match(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](.*))?$", t, re.I):
        day, clock = (int(m[1]), int(m[2]), int(m[3])), m[4]
    elif m := re.match(r"(\d{4})(\d\d)(\d\d)(?:T(\d\d)(\d\d)(\d\d))?$", t, re.I):
        day, clock = (int(m[1]), int(m[2]), int(m[3])), m[4] and f"{m[4]}:{m[5]}:{m[6]}"
    elif m := re.match(r"([A-Za-z]+) (\d\d?),? (\d{4})(?:,? (.*))?$", t):
        if m[1][:3].lower() in MON:
            day, clock = (int(m[3]), MON.index(m[1][:3].lower()) + 1, int(m[2])), m[4]
    elif m := re.match(r"(?:[A-Za-z]{3}, )?(\d\d?)[ -]([A-Za-z]{3})[ -](\d{4})(?: (.*))?$", t):
        if m[2].lower() in MON:
            day, clock = (int(m[3]), MON.index(m[2].lower()) + 1, int(m[1])), m[4]
    if not day:
        return None
    try:
        date = datetime(*day)
    except ValueError:
        return None
    if not clock:
        return us(date), date.date()
    m = re.fullmatch(r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?(?: ?([AP]M))?", clock, re.I)
    if not m:
        return None
    h = int(m[1])
    if m[5]:
        h = h % 12 + (12 if m[5].upper() == "PM" else 0)
    try:
        wall = date.replace(hour=h, minute=int(m[2]), second=int(m[3] or 0), microsecond=int((m[4] or "0")[:6].ljust(6, "0")))
    except ValueError:
        return None
    if off is None or "/" in off:
        # fold=0 reads a repeated time as its first and a skipped one by the offset before
        return us(wall.replace(tzinfo=ZoneInfo(off or zone), fold=0).astimezone(timezone.utc).replace(tzinfo=None)), date.date()
    if off.lower() in ABBR:
        shift = ABBR[off.lower()] * 60
    elif off[0] in "+-":
        digits = off[1:].replace(":", "").ljust(4, "0")
        shift = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if off[0] == "-" else 1)
    else:
        return None
    return us(wall - timedelta(minutes=shift)), date.date()


ALIAS_SEP = re.compile(r"\s|[,;|]|\\n|<br\s*/?>")


def split_list(text, references):
    """Pieces by a hand-written scanner."""
    if text is None:
        return []
    out, i, t = [], 0, text.strip()
    if t.startswith("["):
        import json

        try:
            return [p.strip() for p in json.loads(t) if p.strip()]
        except ValueError:
            t = t.strip("[]")
    starts = re.compile(r"https?://|ftp://")
    while i < len(t):
        if m := ALIAS_SEP.match(t, i):
            i = m.end()
            continue
        if t[i] in "\"'":
            q, j, buf = t[i], i + 1, ""
            while j < len(t):
                if t[j] == "\\" and j + 1 < len(t):
                    buf, j = buf + t[j + 1], j + 2
                elif t[j] == q and t[j + 1 : j + 2] == q:
                    buf, j = buf + q, j + 2
                elif t[j] == q:
                    break
                else:
                    buf, j = buf + t[j], j + 1
            out.append(buf.strip())
            i = j + 1
            continue
        j = i
        while j < len(t):
            if m := ALIAS_SEP.match(t, j):
                if not references:
                    break
                k = m.end()
                while n := ALIAS_SEP.match(t, k):
                    k = n.end()
                if k >= len(t) or starts.match(t, k) or (t[k] in "\"'" and starts.match(t, k + 1)):
                    break
                j = k
            else:
                j += 1
        out.append(t[i:j])
        i = j
    return [p for p in out if p and p.lower() not in STAND_INS and (not references or starts.match(p))]
