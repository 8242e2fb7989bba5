"""Collectors of the public feeds: how each walks its pages, archives and logs, and where its cursor stands afterwards.

A collector is a generator over a ``Run``: it asks for addresses through ``run.fetch`` (recorded downloads, or whatever
client the caller has), yields ``Raw`` records, and leaves the cursor of the next run in ``run.cursor``. It moves the
cursor only over what was whole: a walk that is cut off raises ``WalkError`` and the cursor stays where it was.
Parsing is left to Spark, which reads what lands.
"""

from __future__ import annotations

import io
import json
import lzma
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import NamedTuple
from urllib.parse import urljoin

from advisorium.sources.feeds import OVERLAP_HOURS, zip_members
from advisorium.sources.recorded import baseline_cut, delta_runs, page_watermark, page_windows, resumed_walk


class WalkError(Exception):
    """A page, archive or record that should be there is not, or is not whole."""


class Raw(NamedTuple):
    source: str
    record_id: str
    content: str


@dataclass
class Run:
    """One run of a collector: ``fetch`` gives an address's bytes or raises, ``cursor`` is read and then moved."""

    fetch: Callable[[str], bytes]
    now: datetime
    cursor: dict[str, str] = field(default_factory=dict)
    backfill: bool = False

    def json(self, url: str):
        try:
            return json.loads(self.fetch(url))
        except ValueError as e:
            raise WalkError(f"{url}: no JSON") from e

    def since(self, key: str, hours: float = 0.0) -> datetime | None:
        """The cursor's time, less the margin by which windows overlap."""
        at = instant(self.cursor.get(key))
        return at - timedelta(hours=hours) if at else None


def instant(text: str | None) -> datetime | None:
    try:
        at = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def stamp(at: datetime) -> str:
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


# Public addresses.
CVELIST_RAW = "https://raw.githubusercontent.com/CVEProject/cvelistV5/main/cves/"
CVELIST_RELEASE = "https://api.github.com/repos/CVEProject/cvelistV5/releases/latest"
VULNRICHMENT_ZIP = "https://codeload.github.com/cisagov/vulnrichment/zip/refs/heads/develop"
NVD = "https://services.nvd.nist.gov/rest/json/cves/2.0"
FKIE = "https://github.com/fkie-cad/nvd-json-data-feeds/releases/latest/download/"
OSV = "https://osv-vulnerabilities.storage.googleapis.com/"
GHSA_ZIP = "https://codeload.github.com/github/advisory-database/zip/refs/heads/main"
EUVD = "https://euvdservices.enisa.europa.eu/api/"
GCVE = "https://vulnerability.circl.lu/api/vulnerability/"

NVD_PAGE, EUVD_PAGE, GCVE_PAGE, GCVE_PAGES = 2_000, 100, 25, 40
BASELINE_AFTER = timedelta(days=15)
FIRST_EUVD, FIRST_GCVE = timedelta(days=90), timedelta(days=92)
OSV_MANY = 20_000


def archive_records(run: Run, url: str, source: str, accept: str, id_of: Callable[[str], str]) -> Iterator[Raw]:
    """Records of an archive, archives inside it included; none at all, or a broken member, is an error."""
    n = 0
    for name, text, error in zip_members(run.fetch(url), accept):
        if error:
            raise WalkError(f"{name}: {error}")
        n += 1
        yield Raw(source, id_of(name), text)
    if not n:
        raise WalkError(f"{url}: no records")


def _stem(name: str) -> str:
    return name.rsplit("/", 1)[-1].removesuffix(".json")


def cvelist(run: Run) -> Iterator[Raw]:
    """The release archive at first and when the cursor is older than its log reaches, else what the log names: run by
    run, oldest first, up to the first one that is not whole."""
    since = run.since("since")
    if run.backfill or since is None or run.now - since > BASELINE_AFTER:
        release = run.json(CVELIST_RELEASE)
        asset = next((a for a in release.get("assets") or [] if "all_CVEs" in a.get("name", "")), None)
        if asset is None:
            raise WalkError("the release has no archive of all records")
        day = re.search(r"\d{4}-\d\d-\d\d", asset["name"])
        yield from archive_records(run, asset["browser_download_url"], "cvelist", r"CVE-[^/]*\.json$", _stem)
        cut = baseline_cut(instant(release.get("published_at")), instant(day[0]) if day else None)
        if cut:
            run.cursor["since"] = stamp(cut)
        return
    log = [run.json(CVELIST_RAW + "delta.json")]
    if (instant(log[0].get("fetchTime")) or run.now) - since > timedelta(minutes=1):
        log = run.json(CVELIST_RAW + "deltaLog.json")
    times = {stamp(at): e for e in log if (at := instant(e.get("fetchTime")))}
    for at in sorted(t for t in times if t > stamp(since)):
        runs, _ = delta_runs([times[at] | {"fetchTime": at}], stamp(since))
        links = {x["cveId"]: x.get("githubLink") for k in ("new", "updated") for x in times[at].get(k) or []}
        whole = []
        for i in (i for ids in runs for i in ids):
            year, number = i.split("-")[1:3]
            whole.append(Raw("cvelist", i, run.fetch(links[i] or f"{CVELIST_RAW}{year}/{number[:-3]}xxx/{i}.json").decode()))
        yield from whole
        run.cursor["since"] = at


def vulnrichment(run: Run) -> Iterator[Raw]:
    yield from archive_records(run, VULNRICHMENT_ZIP, "vulnrichment", r"CVE-[^/]*\.json$", _stem)
    run.cursor["since"] = stamp(run.now)


def nvd(run: Run) -> Iterator[Raw]:
    """Changed records in windows of at most 110 days, or all by index, which resumes where it was cut off."""
    since = run.since("last_mod", OVERLAP_HOURS["nvd"])
    if run.backfill or since is None:
        started = run.cursor.setdefault("resume_started", stamp(run.now))
        for at, records, _ in _nvd_pages(run, "", int(run.cursor.get("resume", 0))):
            yield from records
            run.cursor["resume"] = str(at)
        run.cursor.pop("resume", None), run.cursor.pop("resume_started", None)
        run.cursor["last_mod"] = started
        return
    for a, b in page_windows(since, run.now):
        newest = None
        for _, records, seen in _nvd_pages(run, f"&lastModStartDate={stamp(a)}&lastModEndDate={stamp(b)}", 0):
            yield from records
            newest = max(filter(None, (newest, seen)), default=None)
        run.cursor["last_mod"] = stamp(page_watermark(b, newest))


def _nvd_pages(run: Run, window: str, at: int) -> Iterator[tuple[int, list[Raw], datetime | None]]:
    while True:
        page = run.json(f"{NVD}?resultsPerPage={NVD_PAGE}&startIndex={at}{window}")
        items, total = page.get("vulnerabilities") or [], page.get("totalResults", 0)
        if not items and at < total:
            raise WalkError(f"page at {at} of {total} is empty")
        at += len(items)
        newest = max((t for i in items if (t := instant(i["cve"].get("lastModified")))), default=None)
        yield at, [Raw("nvd", i["cve"]["id"], json.dumps(i["cve"])) for i in items], newest
        if at >= total:
            return


def stream_array(stream: io.TextIOBase, name: str, chunk: int = 1 << 20) -> Iterator:
    """Elements of one named array of a JSON object, one at a time; no more than an element is held."""
    decode, text = json.JSONDecoder(), ""
    head = re.compile(rf'"{re.escape(name)}"\s*:\s*\[')
    while not (m := head.search(text)):
        more = stream.read(chunk)
        if not more:
            raise WalkError(f"no array {name}")
        text = text[-len(name) - 64 :] + more
    text = text[m.end() :]
    while True:
        text = text.lstrip(" \t\r\n,")
        if text.startswith("]"):
            return
        try:
            item, end = decode.raw_decode(text)
            if end == len(text) and not isinstance(item, (dict, list)):
                raise ValueError  # a number may go on in the next chunk
        except ValueError:
            more = stream.read(chunk)
            if not more:
                raise WalkError(f"array {name} is cut off") from None
            text += more
            continue
        yield item
        text = text[end:]


def fkie(run: Run) -> Iterator[Raw]:
    """All years at first, then the feed of modified records; each is read element by element."""
    names = [str(y) for y in range(1999, run.now.year + 1)] if run.backfill or not run.cursor.get("since") else ["Modified"]
    for name in names:
        with lzma.open(io.BytesIO(run.fetch(f"{FKIE}CVE-{name}.json.xz")), "rt", encoding="utf-8") as f:
            for item in stream_array(f, "cve_items"):
                yield Raw("fkie", item["id"], json.dumps(item))
    run.cursor["since"] = stamp(run.now)


def osv(run: Run) -> Iterator[Raw]:
    """Records that the list of changes names, one by one; the full archive at first and when they are too many."""
    since = run.since("last_mod", OVERLAP_HOURS["osv"])
    changed: list[tuple[datetime, str]] = []
    if not run.backfill and since:
        for line in run.fetch(OSV + "modified_id.csv").decode().splitlines():  # newest first
            text, _, name = line.partition(",")
            at = instant(text)
            if at is None or at > run.now:
                continue
            if at <= since or len(changed) >= OSV_MANY:
                break
            changed.append((at, name))
    if run.backfill or since is None or len(changed) >= OSV_MANY:
        newest = None
        for raw in archive_records(run, OSV + "all.zip", "osv", r"\.json$", _stem):
            newest = max(filter(None, (newest, instant(json.loads(raw.content).get("modified")))), default=None)
            yield raw
        run.cursor["last_mod"] = stamp(min(filter(None, (newest, run.now, changed[0][0] if changed else None))))
        return
    for _, name in sorted(changed):
        yield Raw("osv", name.rsplit("/", 1)[-1], run.fetch(f"{OSV}{name}.json").decode())
    if changed:
        run.cursor["last_mod"] = stamp(max(changed)[0])


def ghsa(run: Run) -> Iterator[Raw]:
    """The advisory database's archive; a record says by its folder whether it was reviewed."""
    n = 0
    for name, text, error in zip_members(run.fetch(GHSA_ZIP), r"GHSA-[^/]*\.json$"):
        if error:
            raise WalkError(f"{name}: {error}")
        n += 1
        doc = json.loads(text)
        doc["database_specific"] = (doc.get("database_specific") or {}) | {"tag": "github-unreviewed" if "/unreviewed/" in name else "github-reviewed"}
        yield Raw("ghsa", _stem(name), json.dumps(doc))
    if not n:
        raise WalkError("the archive has no records")
    run.cursor["since"] = stamp(run.now)


def euvd(run: Run) -> Iterator[Raw]:
    """The search by day of update, page by page; a page that is not full before the end is an error."""
    since = run.since("last_run", OVERLAP_HOURS["euvd"]) or run.now - FIRST_EUVD
    seen = page = 0
    while True:
        window = f"fromUpdatedDate={since:%Y-%m-%d}&toUpdatedDate={run.now:%Y-%m-%d}"
        got = run.json(f"{EUVD}search?{window}&size={EUVD_PAGE}&page={page}")
        items, total = got.get("items") or [], got.get("total", 0)
        seen += len(items)
        if len(items) < EUVD_PAGE and seen < total:
            raise WalkError(f"page {page} has {len(items)} items, {seen} of {total} so far")
        yield from (Raw("euvd", i["id"], json.dumps(i)) for i in items)
        page += 1
        if seen >= total:
            break
    run.cursor["last_run"] = stamp(run.now)


def page_items(page) -> tuple[list, int | None]:
    """(records, total) of a page that is an array, or an object with one under data, vulnerabilities or results."""
    if isinstance(page, list):
        return page, None
    if isinstance(page, dict):
        for name in ("data", "vulnerabilities", "results"):
            if isinstance(page.get(name), list):
                return page[name], page.get("total") or page.get("count")
    raise WalkError("a page without records")


def gcve(run: Run) -> Iterator[Raw]:
    """Up to 40 pages a run; a walk that is not at its end goes on in the next run where it stopped."""
    since, page, started = resumed_walk(run.cursor) or (stamp(run.since("since") or run.now - FIRST_GCVE), 1, stamp(run.now))
    seen = 0
    for _ in range(GCVE_PAGES):
        items, total = page_items(run.json(f"{GCVE}?since={since}&per_page={GCVE_PAGE}&page={page}"))
        seen += len(items)
        if not items and total is not None and (page - 1) * GCVE_PAGE < total:
            raise WalkError(f"page {page} is empty before {total}")
        for i in items:
            name = i.get("id") or (i.get("cveMetadata") or {}).get("cveId") or ((i.get("document") or {}).get("tracking") or {}).get("id")
            if name:
                yield Raw("gcve", name, json.dumps(i))
        page += 1
        if len(items) < GCVE_PAGE:
            for k in ("vl_since", "vl_page", "vl_started"):
                run.cursor.pop(k, None)
            run.cursor["since"] = started
            return
        run.cursor |= {"vl_since": since, "vl_page": str(page), "vl_started": started}


def rolie_links(run: Run, url: str) -> dict[str, datetime]:
    """Documents of a ROLIE feed with their times; relative links are resolved against the feed."""
    out = {}
    for e in (run.json(url).get("feed") or {}).get("entry") or []:
        at = instant(e.get("updated"))
        hrefs = [x.get("href") for x in e.get("link") or [] if x.get("rel") in (None, "self")] or [(e.get("content") or {}).get("src")]
        for h in hrefs:
            if h and at and h.endswith(".json"):
                full = urljoin(url, h)
                out[full] = max(at, out.get(full, at))
    return out


def directory_links(run: Run, url: str, since: datetime | None) -> dict[str, datetime]:
    """Documents of a directory: by its list of changes, or else all of its index, which tells no times."""
    base = url if url.endswith("/") else url + "/"
    try:
        rows = run.fetch(base + "changes.csv").decode().splitlines()
    except (KeyError, OSError):
        names = run.fetch(base + "index.txt").decode().split()
        return {urljoin(base, n): run.now for n in names if n.endswith(".json")}
    out = {}
    for row in rows:
        name, _, text = (p.strip().strip('"') for p in row.partition(","))
        at = instant(text)
        if name.endswith(".json") and at and (since is None or at > since):
            out[urljoin(base, name)] = at
    return out


def csaf_provider(run: Run, metadata_url: str) -> Iterator[Raw]:
    """One provider's documents, oldest first; its cursor stops before the first one that cannot be had."""
    key = f"provider:{metadata_url}"
    since = run.since(key)
    links: dict[str, datetime] = {}
    for d in run.json(metadata_url).get("distributions") or []:
        for feed in (d.get("rolie") or {}).get("feeds") or []:
            links |= rolie_links(run, urljoin(metadata_url, feed["url"]))
        if d.get("directory_url"):
            links |= directory_links(run, urljoin(metadata_url, d["directory_url"]), since)
    for url, at in sorted(links.items(), key=lambda x: (x[1], x[0])):
        if since is None or at > since:
            yield Raw("csaf", _stem(url), run.fetch(url).decode())
            run.cursor[key] = stamp(at)


def csaf(providers: tuple[str, ...]) -> Callable[[Run], Iterator[Raw]]:
    """A collector over several providers; one that fails ends its own walk, and the run after all others were walked."""

    def walk(run: Run) -> Iterator[Raw]:
        failed = []
        for p in providers:
            try:
                yield from csaf_provider(run, p)
            except (WalkError, KeyError, OSError) as e:
                failed.append(f"{p}: {e}")
        if failed:
            raise WalkError("; ".join(failed))

    return walk


COLLECTORS: dict[str, Callable[[Run], Iterator[Raw]]] = {
    "cvelist": cvelist, "vulnrichment": vulnrichment, "nvd": nvd, "fkie": fkie, "euvd": euvd, "gcve": gcve, "ghsa": ghsa, "osv": osv,
}
#: Collectors whose cursor stops exactly where their records end, so that what a failed run took up counts.
PARTIAL = ("cvelist", "gcve", "nvd", "csaf")
# Whom the data is owed to and under what terms: source, owner, terms.
ATTRIBUTIONS = (
    ("cvelist", "CVE Program", "CVE Terms of Use"), ("vulnrichment", "CISA", "CC0-1.0"), ("nvd", "NIST National Vulnerability Database", "public domain"), ("fkie", "Fraunhofer FKIE", "public domain"),
    ("euvd", "ENISA", "CC-BY-4.0"), ("gcve", "CIRCL", "CC-BY-4.0"), ("ghsa", "GitHub Advisory Database", "CC-BY-4.0"), ("osv", "OSV.dev contributors", "CC-BY-4.0 and others by record"),
    ("csaf", "the issuing vendors", "by document"), ("kev", "CISA", "CC0-1.0"), ("epss", "FIRST.org", "freely usable with attribution"),
)
