"""Inventories as components: bills of materials, package-URL lists, package databases and recorded service scans.

Each reader takes a table of whole documents (path, content) and gives one row per component with the document's
path. Line formats are split in Catalyst; nested ones are read in Arrow batches.
"""

from __future__ import annotations

import gzip
import io
import json
import lzma
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions.packages import FAMILY_OF, Purl, folded_name, parse_purl
from advisorium.functions.text import as_column, tokens
from advisorium.schemas import COMPONENT
from advisorium.session import ship_package

FIELDS = [c.split()[0] for c in COMPONENT.split(", ")]
MAX_BYTES = 512 * 1024 * 1024
MAX_LAYERS = 2
MAX_DEPTH = 64
# Ecosystem named by the type of a package URL.
PURL_ECOSYSTEMS = {
    "deb": "Debian", "rpm": "Red Hat", "apk": "Alpine", "npm": "npm", "maven": "Maven", "pypi": "PyPI", "golang": "Go", "gem": "RubyGems", "cargo": "crates.io",
    "nuget": "NuGet", "composer": "Packagist", "hex": "Hex", "pub": "Pub", "cran": "CRAN", "swift": "SwiftURL", "hackage": "Hackage", "github": "GitHub Actions",
}
DISTRO_TYPES = {"debian": "deb", "ubuntu": "deb", "alpine": "apk"}
# Vendor and product in platform names, by the name a service gives itself in lower case; ``False`` where
# what follows the name is no version.
SSH_NAMES = {"openssh": ("openbsd", "openssh", True), "dropbear": ("dropbear_ssh_project", "dropbear_ssh", True)}
HTTP_NAMES = {
    "apache": ("apache", "http_server", True),
    "nginx": ("f5", "nginx", True),
    "microsoft-iis": ("microsoft", "internet_information_services", True),
    "lighttpd": ("lighttpd", "lighttpd", True),
    "openresty": ("openresty", "openresty", True),
    "jetty": ("eclipse", "jetty", True),
    "php": ("php", "php", True),
}
GREETING_NAMES = {
    "vsftpd": ("vsftpd_project", "vsftpd", True),
    "proftpd": ("proftpd", "proftpd", True),
    "pure-ftpd": ("pureftpd", "pure-ftpd", False),
    "filezilla": ("filezilla-project", "filezilla_server", True),
    "postfix": ("postfix", "postfix", False),
    "exim": ("exim", "exim", True),
    "sendmail": ("sendmail", "sendmail", True),
    "dovecot": ("dovecot", "dovecot", False),
    "cyrus": ("cyrus", "imap", True),
}
REDIS, MYSQL = ("redis", "redis"), ("oracle", "mysql")
KNOWN_SERVICES = sorted({(v, p) for names in (SSH_NAMES, HTTP_NAMES, GREETING_NAMES) for v, p, _ in names.values()} | {REDIS, MYSQL})

# Products told by a word of their certificate's subject (word, vendor, product), in order of trial.
CERTIFICATES = (
    ("syncthing", "syncthing", "syncthing"), ("docker", "docker", "docker"), ("kubernetes", "kubernetes", "kubernetes"), ("elasticsearch", "elastic", "elasticsearch"),
    ("rabbitmq", "pivotal_software", "rabbitmq"), ("grafana", "grafana", "grafana"), ("jenkins", "jenkins", "jenkins"), ("vmware", "vmware", "vmware"), ("ubiquiti", "ui", "unifi"),
    ("pfsense", "netgate", "pfsense"), ("synology", "synology", "diskstation_manager"), ("qnap", "qnap", "qts"), ("plex", "plex", "plex_media_server"), ("minio", "minio", "minio"),
)


class Refused(ValueError):
    """A document that is recognised and not supported, or too large."""


def opened(raw: bytes, layers: int = MAX_LAYERS) -> bytes:
    """Without gzip or xz around it, up to two layers and a fixed size."""
    for _ in range(layers + 1):
        if raw[:2] == b"\x1f\x8b":
            stream: io.IOBase = gzip.GzipFile(fileobj=io.BytesIO(raw))
        elif raw[:6] == b"\xfd7zXZ\x00":
            stream = lzma.LZMAFile(io.BytesIO(raw))
        else:
            if len(raw) > MAX_BYTES:
                raise Refused("document too large")
            return raw
        raw = stream.read(MAX_BYTES + 1)
        if len(raw) > MAX_BYTES:
            raise Refused("document too large")
    raise Refused("too many layers of compression")


def component(**known) -> dict:
    text = lambda x: str(x).strip() or None if x is not None else None
    return {k: text(known.get(k)) for k in FIELDS}


def package_name(p: Purl) -> str:
    """Name as the ecosystem writes it: Maven ``group:artifact``, scoped npm, Go with its path, distributions bare."""
    if p.type in ("deb", "rpm", "apk", "alpm") or not p.namespace:
        return p.name
    return f"{p.namespace}:{p.name}" if p.type == "maven" else f"{p.namespace}/{p.name}"


def purl_ecosystem_name(p: Purl) -> str | None:
    """Ecosystem of a package URL; distributions by namespace, Ubuntu without a release."""
    if p.type in ("deb", "rpm", "apk") and p.namespace:
        names = {"debian": "Debian", "ubuntu": "Ubuntu", "redhat": "Red Hat", "alpine": "Alpine", "fedora": "Fedora", "rocky": "Rocky Linux", "almalinux": "AlmaLinux", "suse": "SUSE", "opensuse": "openSUSE"}
        return names.get(FAMILY_OF.get(p.namespace, p.namespace), p.namespace)
    return PURL_ECOSYSTEMS.get(p.type)


def from_purl(text: str, origin: str | None = None, version: str | None = None) -> dict | None:
    p = parse_purl(text)
    if p is None:
        return None
    return component(name=package_name(p), version=version or p.version, vendor=p.namespace if p.type not in ("deb", "rpm", "apk", "npm", "golang") else None, ecosystem=purl_ecosystem_name(p), purl=text.strip(), origin=origin)


def cyclonedx(doc: dict) -> list[dict]:
    """Components of a CycloneDX document at any depth, the described one first."""
    described = (doc.get("metadata") or {}).get("component")
    stack = [(c, 0) for c in reversed([*([described] if described else []), *(doc.get("components") or [])])]
    out = []
    while stack:
        c, depth = stack.pop()
        if depth < MAX_DEPTH:
            stack += [(x, depth + 1) for x in reversed(c.get("components") or [])]
        evidence = {i.get("field"): i.get("concludedValue") for i in _listed((c.get("evidence") or {}).get("identity"))}
        purl, cpe = c.get("purl") or evidence.get("purl"), c.get("cpe") or evidence.get("cpe")
        base = from_purl(purl) if purl else None
        vendor = next((v for v in (c.get("group"), (c.get("supplier") or {}).get("name"), c.get("publisher"), c.get("author"), base and base["vendor"]) if v and str(v).strip()), None)
        name = (base or {}).get("name") or c.get("name")
        if name or purl or cpe:
            out.append(component(name=name, version=c.get("version") or (base or {}).get("version"), vendor=vendor, ecosystem=(base or {}).get("ecosystem"), purl=purl, cpe=cpe, origin=c.get("bom-ref")))
    return out


def _listed(x) -> list:
    return x if isinstance(x, list) else [x] if x else []


def spdx(doc: dict) -> list[dict]:
    """Packages of an SPDX 2.2 or 2.3 document; other versions are refused."""
    if doc.get("spdxVersion") not in ("SPDX-2.2", "SPDX-2.3"):
        raise Refused(f"{doc.get('spdxVersion')} is not supported")
    stated = lambda x: None if x in (None, "", "NOASSERTION", "NONE") else x
    out = []
    for p in doc.get("packages") or []:
        refs = p.get("externalRefs") or []
        by_type = lambda *t: next((r.get("referenceLocator") for k in t for r in refs if r.get("referenceType") == k), None)
        managed = next((r.get("referenceLocator") for r in refs if r.get("referenceType") == "purl" and (r.get("referenceCategory") or "").replace("_", "-") == "PACKAGE-MANAGER"), None)
        purl = managed or by_type("purl")
        base = from_purl(purl) if purl else None
        by = stated(p.get("supplier")) or stated(p.get("originator"))
        vendor = re.sub(r"^(?:Organization|Person):\s*|\s*\([^)]*\)\s*$", "", by) if by else base and base["vendor"]
        out.append(component(name=(base or {}).get("name") or p.get("name"), version=stated(p.get("versionInfo")) or (base or {}).get("version"), vendor=vendor, ecosystem=(base or {}).get("ecosystem"), purl=purl, cpe=by_type("cpe23Type", "cpe22Type"), origin=p.get("SPDXID")))
    return out


def purl_list(lines: list[str]) -> list[dict]:
    """One package URL per line, ``#`` begins a comment line; more than one bad line and a tenth of all refuses the list."""
    wanted = [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]
    read = [from_purl(x) for x in wanted]
    bad = read.count(None)
    if bad > 1 and bad * 10 > len(wanted) or (wanted and bad == len(wanted)):
        raise Refused(f"{bad} of {len(wanted)} lines are no package URL")
    return [r for r in read if r]


def parse_document(raw: bytes) -> list[dict]:
    """Components of a document in any of the supported formats, told by its content."""
    text = opened(raw).decode("utf-8-sig")
    head = text.lstrip()[:1]
    if head == "<":
        raise Refused("XML is not supported")
    if head == "[":
        return purl_list([x for x in json.loads(text) if isinstance(x, str)])
    if head != "{":
        return purl_list(text.splitlines())
    doc = json.loads(text)
    if doc.get("bomFormat") == "CycloneDX":
        return cyclonedx(doc)
    if "spdxVersion" in doc:
        return spdx(doc)
    raise Refused("neither CycloneDX nor SPDX 2 in JSON")


def read_inventories(files: DataFrame) -> DataFrame:
    """Components of many inventories: path, comp_no, the component's fields, and ``refused`` with the reason where a
    document gives none. ``files`` is as ``spark.read.format('binaryFile')`` gives it (path, content)."""
    ship_package(files.sparkSession)
    schema = f"path string, comp_no int, {COMPONENT}, refused string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = parse_document(raw or b"")
                    rows += [{"path": path, "comp_no": i, **c, "refused": None} for i, c in enumerate(found, 1)]
                except (ValueError, TypeError, AttributeError, OSError, EOFError, lzma.LZMAError) as e:
                    rows.append({"path": path, "comp_no": 0, **dict.fromkeys(FIELDS), "refused": str(e)[:200] or type(e).__name__})
            types = [("path", pa.string()), ("comp_no", pa.int32()), *((f, pa.string()) for f in FIELDS), ("refused", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))

    return files.select("path", "content").mapInArrow(run, schema)


def _components(df: DataFrame, **known: Column) -> DataFrame:
    return df.select("path", *[known.get(f, F.lit(None).cast("string")).cast("string").alias(f) for f in FIELDS])


def _stanzas(files: DataFrame, key: str):
    """Blank-line separated stanzas as maps; of a repeated key the first counts."""
    blocks = files.select("path", F.posexplode(F.split("content", r"\n[ \t]*\n")).alias("at", "block"))
    pairs = F.filter(F.transform(F.split("block", r"\n(?=\S)"), lambda l: F.struct(F.regexp_extract(l, key, 1).alias("k"), F.regexp_extract(l, key, 2).alias("v"))), lambda p: p["k"] != "")
    value = lambda k: F.get(F.filter("pairs", lambda p: p["k"] == k), F.lit(0))["v"]
    out = blocks.select("path", "at", pairs.alias("pairs"))
    return out, value


def read_dpkg_status(files: DataFrame, ecosystem: str = "Debian") -> DataFrame:
    """Installed packages of a dpkg status file, the source package beside the binary one."""
    out, value = _stanzas(files, r"(?s)^([A-Za-z-]+):\s*(.*)$")
    rows = out.select("path", value("Package").alias("name"), value("Version").alias("version"), value("Status").alias("status"), value("Source").alias("src"))
    return _with_source(rows.filter("name is not null and version is not null and status like '% installed'"), ecosystem)


def read_dpkg_query(files: DataFrame, ecosystem: str = "Debian") -> DataFrame:
    """``dpkg-query`` lines: state, package, version, architecture, source, source version, tab separated."""
    lines = files.select("path", F.explode(F.split("content", r"\R")).alias("line"))
    f = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    rows = lines.select("path", F.trim(f(0)).alias("state"), f(1).alias("name"), f(2).alias("version"), F.when(F.trim(f(4)) != "", F.concat(f(4), F.lit(" ("), f(5), F.lit(")"))).alias("src"))
    return _with_source(rows.filter(F.col("state").startswith("ii") & (F.col("name") != "")), ecosystem)


def purl_text(c: Column | str) -> Column:
    """A name or version as it stands in a package URL: all but letters, digits and ``.-_~`` percent-encoded, colons kept."""
    return F.replace(F.replace(F.replace(F.url_encode(as_column(c)), F.lit("+"), F.lit("%20")), F.lit("%3A"), F.lit(":")), F.lit("%7E"), F.lit("~"))


def _with_source(rows: DataFrame, ecosystem: str) -> DataFrame:
    name = F.regexp_extract("src", r"^(\S+)", 1)
    version = F.regexp_extract("src", r"\(([^)]*)\)", 1)
    own = F.struct("name", "version")
    source = F.struct(name.alias("name"), F.when(version != "", version).otherwise(F.col("version")).alias("version"))
    both = F.when(F.coalesce(name, F.lit("")) != "", F.array_distinct(F.array(own, source))).otherwise(F.array(own))
    kind = DISTRO_TYPES.get(ecosystem.split(":")[0].lower(), "deb")
    exploded = rows.select("path", F.inline(both))
    purl = F.concat(F.lit(f"pkg:{kind}/{ecosystem.split(':')[0].lower()}/"), purl_text("name"), F.lit("@"), purl_text("version"))
    return _components(exploded, name=F.col("name"), version=F.col("version"), ecosystem=F.lit(ecosystem), purl=purl)


def read_rpm_query(files: DataFrame, ecosystem: str = "Red Hat") -> DataFrame:
    """``rpm -qa`` lines: name, epoch, version, release, architecture, source package, tab separated; keys are left out."""
    lines = files.select("path", F.explode(F.split("content", r"\R")).alias("line"))
    f = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    epoch = F.when(~F.coalesce(f(1), F.lit("")).isin("", "0", "(none)"), F.concat(f(1), F.lit(":"))).otherwise("")
    rows = lines.select("path", f(0).alias("name"), F.concat(epoch, f(2), F.lit("-"), f(3)).alias("version")).filter("name != '' and name != 'gpg-pubkey' and version is not null")
    return _components(rows, name=F.col("name"), version=F.col("version"), ecosystem=F.lit(ecosystem))


def read_apk_installed(files: DataFrame, ecosystem: str = "Alpine") -> DataFrame:
    """An apk database: ``P:``, ``V:`` and the origin ``o:`` of each stanza."""
    out, value = _stanzas(files, r"^([A-Za-z]):(.*)$")
    rows = out.select("path", value("P").alias("name"), value("V").alias("version"), value("o").alias("origin_name")).filter("name is not null and version is not null")
    names = F.explode(F.array_distinct(F.filter(F.array("name", "origin_name"), lambda x: F.coalesce(x, F.lit("")) != "")))
    return _components(rows.select("path", "version", names.alias("name")), name=F.col("name"), version=F.col("version"), ecosystem=F.lit(ecosystem))


def read_apk_info(files: DataFrame, ecosystem: str = "Alpine") -> DataFrame:
    """``apk info -v`` lines: name-version-rN."""
    lines = files.select("path", F.explode(F.split("content", r"\R")).alias("line")).withColumn("line", F.trim("line"))
    part = lambda i: F.regexp_extract("line", r"^(.+)-(\d[^-]*-r\d+)$", i)
    return _components(lines.select("path", part(1).alias("name"), part(2).alias("version")).filter("name != ''"), name=F.col("name"), version=F.col("version"), ecosystem=F.lit(ecosystem))


def os_release(text: str) -> dict[str, str]:
    """Key and value pairs of an os-release file, quotes removed; later keys count."""
    out = {}
    for line in text.splitlines():
        k, eq, v = line.strip().partition("=")
        if eq and re.fullmatch(r"[A-Z_0-9]+", k):
            v = v.strip()
            out[k] = re.sub(r"\\(.)", r"\1", v[1:-1]) if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    return out


def _told_by(names: dict, name: Column, version: Column) -> Column:
    """vendor, product, version of a service by the name it gives itself; null for a name that is not listed."""
    known = F.create_map(*[x for n, (v, p, numbered) in names.items() for x in (F.lit(n), F.struct(F.lit(v).alias("vendor"), F.lit(p).alias("product"), F.lit(numbered).alias("numbered")))])
    found = F.try_element_at(known, F.lower(name))
    return F.when(found.isNotNull(), F.struct(found["vendor"].alias("vendor"), found["product"].alias("product"), F.when(found["numbered"], version).otherwise("").alias("version")))


def _header(banner: Column, field: str) -> tuple[Column, Column]:
    """(name, version) of the first product token of an HTTP header: ``name/version`` or ``name(version)``."""
    token = rf"(?im)^{field}:[ \t]*([a-z][a-z0-9.-]*)(?:[/(]([^\s/()]+))?"
    return F.regexp_extract(banner, token, 1), F.regexp_extract(banner, token, 2)


def identify_banners(services: DataFrame) -> DataFrame:
    """Services told by their banner: the columns of ``services`` (banner), vendor, product, version. One row per
    product; banners that tell nothing known, blank and null ones give none.

    Each protocol's greeting is read by its grammar: SSH's identification string, HTTP's product tokens, the words of
    the first line of FTP, SMTP, POP and IMAP servers with the number that follows, the fields of redis, and MySQL's
    handshake, which begins with its version and names its authentication.
    """
    b = F.trim("banner")
    software = F.regexp_extract(b, r"(?i)^SSH-[\d.]+-(\S+)", 1)
    first_line = F.regexp_extract(b, r"(?i)^(?:220[ -]|\+OK\b|\* OK )([^\r\n]*)", 1)
    words = F.filter(F.split(first_line, r"[\s()\[\]<>;,]+"), lambda w: w != "")
    listed = F.transform(words, lambda w: F.lower(w).isin(*GREETING_NAMES))
    at = F.coalesce(F.array_position(listed, True), F.lit(0)).cast("int")
    numbers = F.filter(F.slice(words, F.greatest(at, F.lit(1)) + 1, 2), lambda w: w.rlike(r"^\d+\."))
    greeting = F.when(at > 0, _told_by(GREETING_NAMES, F.get(words, at - 1), F.regexp_extract(F.coalesce(F.get(numbers, F.lit(0)), F.lit("")), r"^\d[\w.-]*", 0)))
    named = lambda pair, version: F.struct(F.lit(pair[0]).alias("vendor"), F.lit(pair[1]).alias("product"), version.alias("version"))
    redis, mysql = F.regexp_extract(b, r"(?im)^redis_version:(\d[\w.]*)", 1), F.regexp_extract(b, r"(\d+\.\d+\.\d+)[^\x00]*\x00", 1)
    hits = [
        _told_by(SSH_NAMES, F.regexp_extract(software, r"^[A-Za-z]+", 0), F.regexp_extract(software, r"^[A-Za-z]+[_-](\d[\w.]*)", 1)),
        _told_by(HTTP_NAMES, *_header(b, "Server")), _told_by(HTTP_NAMES, *_header(b, "X-Powered-By")), greeting,
        F.when(redis != "", named(REDIS, redis)), F.when((mysql != "") & F.contains(b, F.lit("mysql_native_password")), named(MYSQL, mysql)),
    ]
    found = F.filter(F.array(*hits), lambda h: h.isNotNull())
    once = F.filter(found, lambda h, i: ~F.exists(F.slice(found, 1, i), lambda o: (o["product"] == h["product"]) & (o["vendor"] == h["vendor"])))
    out = services.select("*", F.inline(once))
    return out.withColumn("version", F.when(F.col("version").rlike(r"^\d"), F.col("version")))


def cpe_value(c: Column | str) -> Column:
    """A value as it stands in a formatted platform name: lower case, blanks as underscores, signs escaped; ``*`` for none."""
    t = F.regexp_replace(F.lower(F.trim(as_column(c))), r"\s+", "_")
    return F.when(F.coalesce(t, F.lit("")) == "", "*").otherwise(F.regexp_replace(t, r"([^a-z0-9_.\-])", r"\\$1"))


def service_components(services: DataFrame) -> DataFrame:
    """Services (ip, port, vendor, product, version) as components; one without product or version is none. The origin
    tells address and port."""
    known = services.filter("trim(coalesce(product, '')) != '' and trim(coalesce(version, '')) != ''")
    where = F.concat(F.when(F.contains("ip", F.lit(":")), F.concat(F.lit("["), "ip", F.lit("]"))).otherwise(F.col("ip")), F.lit(":"), F.col("port").cast("string"))
    return known.select(*[{
        "name": F.trim("product"), "version": F.trim("version"), "vendor": F.trim("vendor"), "origin": where, "cpe": service_cpe(F.col("vendor"), F.col("product"), F.col("version"))
    }.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])


#: Forms in which a service names itself: pattern, group of the product, group of the version.
NAMING_FORMS = (
    (r"(?i)^\d+/(?:tcp|udp)\s+open\s+([a-z][\w.-]*)\s+(\d[\w.-]*)", 1, 2),
    (r"(?i)^SSH-[\d.]+-([a-z]\w*?)_(\d[\w.-]*)", 1, 2),
    (r"(?i)^Server:\s*([a-z][\w-]*)/(\d[\w.-]*)", 1, 2),
    (r"(?i)^220[ -]\S+\s+([a-z][\w ]*?)\s+(\d[\w.-]*)(?:\s+ready)?\s*$", 1, 2),
)


def named_services(lines: DataFrame) -> DataFrame:
    """Services that name themselves in a common form, whatever they are called: the columns of ``lines`` (banner),
    product (folded), version. Lines of no such form, blank and null ones give no row."""
    b = F.trim("banner")
    told = F.coalesce(*[F.when(b.rlike(p), F.struct(folded_name(F.regexp_extract(b, p, i)).alias("product"), F.regexp_extract(b, p, j).alias("version"))) for p, i, j in NAMING_FORMS])
    return lines.select("*", F.inline(F.filter(F.array(told), lambda t: t.isNotNull())))


def identify_certificates(services: DataFrame) -> DataFrame:
    """Services told by a whole word of their certificate's subject: the columns of ``services`` (subject), vendor, product."""
    words = tokens("subject")
    told = F.coalesce(*[F.when(F.array_contains(words, w), F.struct(F.lit(v).alias("vendor"), F.lit(p).alias("product"))) for w, v, p in CERTIFICATES])
    return services.withColumn("__told", told).filter("__told is not null").select("*", "__told.vendor", "__told.product").drop("__told")


def service_cpe(vendor: Column, product: Column, version: Column) -> Column:
    """Platform name of a service, its values escaped."""
    return F.concat(F.lit("cpe:2.3:a:"), cpe_value(vendor), F.lit(":"), cpe_value(product), F.lit(":"), cpe_value(version), F.lit(":*:*:*:*:*:*:*"))


def read_masscan(files: DataFrame) -> DataFrame:
    """Open tcp ports per address of masscan's JSON: ip, ports (sorted, distinct). A trailing comma does not matter."""
    text = F.regexp_replace("content", r",\s*\]\s*$", "]")
    rows = files.select(F.inline(F.from_json(text, "array<struct<ip:string,ports:array<struct<port:int,proto:string,status:string>>>>")))
    open_ports = rows.select("ip", F.inline("ports")).filter("proto = 'tcp' and status = 'open' and port between 1 and 65535")
    return open_ports.groupBy("ip").agg(F.array_sort(F.collect_set("port")).alias("ports"))


NMAP = "host array<struct<address:array<struct<_addr:string,_addrtype:string>>,ports:struct<port:array<struct<_protocol:string,_portid:int,state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string,cpe:array<string>>>>>>>"


def _nmap_ports(files: DataFrame) -> DataFrame:
    hosts = files.select(F.from_xml("content", NMAP).alias("d")).select(F.explode("d.host").alias("h"))
    return hosts.select(F.get(F.filter("h.address", lambda a: a["_addrtype"].isin("ipv4", "ipv6")), F.lit(0))["_addr"].alias("ip"), F.explode("h.ports.port").alias("p"))


def read_nmap(files: DataFrame) -> DataFrame:
    """Open ports of nmap's XML with what it tells of the service: ip, port, service, product, version, cpe."""
    ports = _nmap_ports(files)
    return ports.filter("p.state._state = 'open'").select("ip", F.col("p._portid").alias("port"), F.col("p.service._name").alias("service"), F.col("p.service._product").alias("product"), F.col("p.service._version").alias("version"), F.get("p.service.cpe", F.lit(0)).alias("cpe"))


def nmap_states(files: DataFrame) -> DataFrame:
    """How many ports of each host are open and how many are not, in the order of addresses: ip, n_open, n_closed."""
    is_open = F.col("p.state._state") == "open"
    counted = _nmap_ports(files).groupBy("ip").agg(F.count(F.when(is_open, 1)).alias("n_open"), F.count(F.when(~F.coalesce(is_open, F.lit(False)), 1)).alias("n_closed"))
    return counted.orderBy(address_order("ip"))


def address_order(ip: Column | str) -> Column:
    """Sorts addresses as numbers, version 4 before version 6."""
    c = as_column(ip)
    four = F.transform(F.split(c, r"\."), lambda x: F.lpad(x, 3, "0"))
    return F.when(F.contains(c, F.lit(":")), F.concat(F.lit("6"), c)).otherwise(F.concat(F.lit("4"), F.array_join(four, ".")))


def flat_ports(files: DataFrame) -> list[int]:
    """All ports that masscan found open on any host, sorted; there are at most 65,535."""
    return [r.port for r in read_masscan(files).select(F.explode("ports").alias("port")).distinct().orderBy("port").collect()]


def frequent_ports(text: str, n: int) -> list[int]:
    """The ``n`` most frequent tcp ports of an nmap-services table (name, port/protocol, frequency), ties by number."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    seen = {int(r[1].split("/")[0]): float(r[2]) for r in rows if len(r) > 2 and r[1].endswith("/tcp") and re.fullmatch(r"[0-9.]+", r[2])}
    return sorted(seen, key=lambda p: (-seen[p], p))[:n]


def parse_ports(spec: str, frequent: list[int] | None = None) -> list[int]:
    """Ports of a list such as ``80,443,8000-8010``, ``top:100`` of the frequent ones, or ``all``; sorted and distinct."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        if part == "all":
            out |= set(range(1, 65536))
        elif m := re.fullmatch(r"top:(\d+)", part):
            out |= set((frequent or [])[: int(m[1])])
        elif m := re.fullmatch(r"(\d+)(?:-(\d+))?", part):
            low, high = int(m[1]), int(m[2] or m[1])
            if not 1 <= low <= high <= 65535:
                raise ValueError(f"no port range: {part}")
            out |= set(range(low, high + 1))
        else:
            raise ValueError(f"no port: {part}")
    return sorted(out)


def expand_network(text: str) -> Iterator[str]:
    """Addresses of a network; network and broadcast address are left out where it has both."""
    import ipaddress

    net = ipaddress.ip_network(text, strict=False)
    yield from (str(a) for a in (net.hosts() if net.num_addresses > 2 else net))
