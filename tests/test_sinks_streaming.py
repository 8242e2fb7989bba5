"""Exports, bundles, the ledger of live runs, versioned tables, streams and the command line."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from advisorium.__main__ import main
from advisorium.operators import history, ledger, merge, snapdiff, zones
from advisorium.plans import problems, reference
from advisorium.sinks import exports
from advisorium.sources import bundle, documents
from advisorium.sources.shared import SharedFolder, StaleState
from advisorium.sources.versioned import VersionedTable
from advisorium.streaming import ingest


def test_exports(spark, sf, tmp_path):
    corpus = reference.corpus(spark, sf)
    exports.write_csv(corpus, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(exports.CSV_COLUMNS) and back.count() >= corpus.count()
    lines = list(exports.stream_ndjson(corpus.select("id", "modified", "primary_score")))
    assert len(lines) == corpus.count() and json.loads(lines[0])["modified"]
    feed = ET.fromstring(exports.atom_feed(corpus, "a & b", 5))
    assert len(feed.findall("{http://www.w3.org/2005/Atom}entry")) == 5
    odd = spark.createDataFrame([("=1+1",), ("a",), (None,), ("@x",)], "t string")
    assert [r[0] for r in odd.select(exports.csv_safe(F.col("t"))).collect()] == ["'=1+1", "a", None, "'@x"]
    assert exports.truncated("éé", 3) == "é…" and exports.truncated(None, 3) == ""
    bad = corpus.select("id", F.lit(None).cast("timestamp_ntz").alias("modified"), F.expr("raise_error('boom')").alias("x"))
    assert json.loads(list(exports.stream_ndjson(bad))[-1])["error"]


def test_bundle(spark, tmp_path):
    rec = bundle.Recorder(str(tmp_path / "b"))
    for day, at in (("01", 1.0), ("10", 2.0), ("20", 3.0)):
        rec.record(f"https://x/api?from=2024-01-{day}T00:00:00Z&n=1", day.encode(), captured_at=at)
    rec.record("https://x/plain", b"p", captured_at=1.0)
    known = bundle.manifest(spark, str(tmp_path / "b"))
    asked = spark.createDataFrame([("https://x/api?from=2024-01-12T00:00:00Z&n=1",), ("https://x/plain",), ("https://y/none",)], "url string")
    got = {r.url: (r.recorded_url, r.exact) for r in bundle.lookup(asked, known).collect()}
    assert got == {"https://x/api?from=2024-01-12T00:00:00Z&n=1": ("https://x/api?from=2024-01-10T00:00:00Z&n=1", False), "https://x/plain": ("https://x/plain", True), "https://y/none": (None, None)}
    assert bundle.pack(str(tmp_path / "b"), str(tmp_path / "b.tgz")) == 5 and bundle.unpack(str(tmp_path / "b.tgz"), str(tmp_path / "c")) == 5
    digest = known.filter("url = 'https://x/plain'").first().sha256
    assert bundle.read_blob(str(tmp_path / "c"), digest) == b"p"
    (tmp_path / "c" / "blobs" / digest).write_bytes(b"q")
    with pytest.raises(ValueError):
        bundle.read_blob(str(tmp_path / "c"), digest)
    assert bundle.query_window("https://x?a=1&b=2024-01-01") == {"b": "2024-01-01"}
    assert main(["bundle", "info", str(tmp_path / "b")]) == 0 and main(["version"]) == 0


def test_work_ledger(spark, tmp_path):
    now = [0.0]
    book = ledger.WorkLedger(spark, f"file://{tmp_path}/l", 10, lambda: now[0])
    assert book.add("a") and not book.add("a") and book.items() == {"a": "pending"}
    first = book.lease("a")
    assert book.state("a") == "leased" and book.lease("a") is None
    now[0] = 11
    assert book.state("a") == "pending"
    second = book.lease("a")
    assert second.token == first.token + 1
    with pytest.raises(ledger.StaleLease):
        book.process(first, spark.range(3))
    book.process(second, spark.range(5))
    book.finish(second)
    assert book.state("a") == "done" and book.lease("a") is None
    assert spark.read.parquet(*book.done_paths()).count() == 5
    book.add("b")
    third = book.lease("b")
    book.fail(third)
    assert book.state("b") == "pending" and book.lease("b").token == 2


def test_replay_on_odd_input(spark, tmp_path):
    log = spark.sql("select * from values ('s', 1L, timestamp '2024-01-01 10:00:00', timestamp '2024-01-01 11:00:00', cast(null as string)), ('s', 2L, timestamp '2024-01-02 10:00:00', null, null), ('s', 3L, timestamp '2024-01-03 10:00:00', timestamp '2024-01-03 11:00:00', 'err'), ('s', 3L, timestamp '2024-01-03 10:00:00', timestamp '2024-01-03 12:00:00', null), (null, 4L, null, null, null) as t(source_name, run_no, started_at, finished_at, error_text)")
    items = spark.sql("select * from values ('s','e',1L,timestamp '2023-01-01 00:00:00',5L), ('s','e',2L,timestamp '2024-01-01 10:00:00',5L), ('s','e',3L,timestamp '2024-01-01 10:00:01',4L), ('s','e',4L,timestamp '2024-01-03 09:00:00',9L), ('s','f',5L,timestamp '2024-02-01 00:00:00',9L), ('s','g',6L,timestamp '2024-01-01 00:00:00',null), ('s',null,7L,timestamp '2024-01-01 00:00:00',1L), ('s','h',8L,null,1L), ('x','e',9L,timestamp '2024-01-01 00:00:00',1L) as t(source_name, entity, row_no, landed_at, time_us)")
    run = lambda name, i, g: sorted(tuple(r) for r in ledger.new_or_changed(ledger.replay(i, g, f"file://{tmp_path}/{name}")).collect())
    assert run("a", items, log) == [("s", 1, 1), ("s", 3, 4)]
    assert run("b", items.limit(0), log) == [] and run("c", items, log.limit(0)) == []
    book = ledger.WorkLedger(spark, f"file://{tmp_path}/a/ledger-{ledger.item_name('s', 0)}")
    leases = {n: book.files.names(f"leases/{ledger.item_name('s', n)}") for n in (1, 2, 3)}
    assert leases == {1: ["00000001"], 2: ["00000001", "00000002"], 3: ["00000001"]}  # the second run's lease expired
    assert set(book.items().values()) == {"done"} and len(book.done_paths()) == 3


def test_history_store(spark, tmp_path, sf):
    spec = problems.snapshot_spec()
    raw = spark.read.parquet(f"{sf}/vuln_snapshots.parquet").select(*problems.SNAPSHOT_COLUMNS)
    days = [r[0] for r in raw.select("snapshot_at").distinct().orderBy("snapshot_at").collect()]
    old = F.col("snapshot_at") <= F.lit(days[40])
    regular = F.col("loaded_at") <= F.col("snapshot_at") + F.expr("INTERVAL 1 DAY")
    store = history.HistoryStore(spark, f"file://{tmp_path}/h", spec, 8)
    store.apply(raw.filter(old & regular))
    store.apply(raw.filter(old & ~regular))
    final = store.apply(raw.filter(~old))
    key = lambda df: sorted((r.entity, str(r.valid_from), str(r.valid_to)) for r in df.collect())
    assert key(final) == key(history.build_chains(raw, spec))
    one = raw.filter(F.col("vuln_id") == raw.first().vuln_id).limit(1)
    before = store.pointer.read()[1]["chains"]
    again = store.apply(one)
    after = store.pointer.read()[1]["chains"]
    assert key(again) == key(final) and sum(before[b] != after[b] for b in before) == 1  # one bucket was replaced
    assert history.history_with_late_rows(raw.limit(0), F.lit(False), spec, f"file://{tmp_path}/e").count() == 0


def test_snapshot_index(spark, tmp_path):
    index = snapdiff.SnapshotIndex(spark, f"file://{tmp_path}/i", "k", ["v"], "no", 4)
    rows = [(1, 1, "a", "x"), (1, 2, "b", None), (1, 3, "b", "late"), (1, 4, None, "z"), (2, 1, "b", ""), (2, 2, "c", "x"), (4, 1, "b", ""), (4, 2, "c", "x"), (None, 1, "d", "x")]
    assert index.land(spark.createDataFrame(rows, "seq long, no int, k string, v string")) == [1, 2, 4]
    got = lambda paths: sorted((r.to_seq, r.k, r.change_kind, r.old and r.old.v, r.new and r.new.v) for r in index.changes(paths).collect())
    first = [(1, "a", "added", None, "x"), (1, "b", "added", None, None)]
    second = [(2, "a", "removed", "x", None), (2, "b", "changed", None, ""), (2, "c", "added", None, "x")]
    assert got(index.deliver(1)) == first
    assert got(index.deliver(2)) == second and got(index.deliver(2)) == second
    assert got(index.deliver(1)) == first and index.pointer.read()[1]["seq"] == 2  # an old delivery moves nothing
    assert got(index.deliver(3)) == [(3, "b", "removed", "", None), (3, "c", "removed", "x", None)]
    assert got(index.deliver(4)) == [(4, "b", "added", None, ""), (4, "c", "added", None, "x")]
    with pytest.raises(StaleState):
        index.deliver(0)


def test_found_queries_stand_on_their_stores(spark, sf, monkeypatch):
    def refuse(*_, **__):
        raise RuntimeError("store")

    for owner, method, query in (
        (snapdiff.SnapshotIndex, "deliver", problems.p5_found), (ledger.WorkLedger, "lease", problems.p7_found), (ledger.WorkLedger, "done_paths", problems.p7_found),
        (history.HistoryStore, "apply", problems.p4_found), (zones.TimeNormalizer, "estimate", problems.p1_found),
    ):
        with monkeypatch.context() as m:
            m.setattr(owner, method, refuse)
            with pytest.raises(RuntimeError, match="store"):
                query(spark, sf)


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError):
        t.read()
    t.replace(spark.range(3))
    staged = t.stage(spark.range(9))
    assert t.read().count() == 3
    began = t.number()
    t.swap(staged, began)
    assert t.read().count() == 9
    with pytest.raises(StaleState):  # another writer that began from the same state
        t.swap(t.stage(spark.range(1)), began)
    assert t.read().count() == 9 and len(t.vacuum(1)) == 2 and t.read().count() == 9


def test_writers_race_and_die(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    files = SharedFolder(spark, f"file://{tmp_path}/m")
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda i: files.create_once("done/x", {"token": i}), range(32))) == 1
    hadoop = SharedFolder(spark, f"file://{tmp_path}/m")
    disk, hadoop._disk = hadoop._disk, None  # the way of other file systems
    assert hadoop.create_once("done/y", {"token": 1}) and not hadoop.create_once("done/y", {"token": 2})
    assert hadoop.load("done/y") == {"token": 1} and hadoop.names("done") == ["x", "y"] and hadoop.load("done/none") is None
    assert files.load("done/y") == {"token": 1} and disk
    # A writer that dies between writing and naming leaves the name free; a file without content is no marker.
    book = ledger.WorkLedger(spark, f"file://{tmp_path}/l", 10, lambda: 0.0)
    book.add("a")
    (tmp_path / "l" / "done").mkdir()
    (tmp_path / "l" / "done" / ".half").write_text("")
    (tmp_path / "l" / "done" / "b").write_text("")
    assert book.state("a") == "pending" and book.done_paths() == []
    book.process(book.lease("a"), spark.range(2))
    assert spark.read.parquet(*book.done_paths()).count() == 2


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    put = lambda name, *ids: (tmp_path / "landing" / name).write_text("".join(json.dumps({"source": "osv", "record_id": i, "content": json.dumps({"id": i, "summary": s}), "landed_at": "2024-01-01T00:00:00Z"}) + "\n" for i, s in ids))
    where = ingest.Landing("osv", *(f"file://{tmp_path}/{x}" for x in ("landing", "archive", "records", "checkpoint")))
    put("a.json", ("X-1", "one"), ("X-2", "two"), ("X-2", "two"))
    ingest.start(spark, where, documents.parse_osv).awaitTermination()
    put("b.json", ("X-1", "one"), ("X-2", "changed"))
    ingest.start(spark, where, documents.parse_osv).awaitTermination()
    got = sorted((r.batch, r.id, r.title) for r in ingest.read_records(spark, where).collect())
    assert got == [(0, "X-1", "one"), (0, "X-2", "two"), (1, "X-2", "changed")]


def test_guarded_stream_equals_batch(spark, sf, tmp_path):
    rows = reference.record_stream(spark, sf).filter("seq <= 3000").select("source", "record_id", "seq", F.col("modified").cast("timestamp").alias("modified"))
    rows.filter("seq <= 1500").coalesce(1).write.parquet(f"file://{tmp_path}/in/a")
    for part in ("a", "b"):
        if part == "b":
            rows.filter("seq > 1500").coalesce(1).write.parquet(f"file://{tmp_path}/in/b")
        stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in/*")
        q = ingest.guarded_stream(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.source, r.record_id, r.seq): r.stale for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    full = reference.record_stream(spark, sf).filter("seq <= 3000")
    want = {(r.source, r.record_id, r.seq): r.stale for r in merge.accepted_records(full).collect()}
    assert got == want


def test_landing_rates(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("landed_at"), F.col("event_type").alias("source"))
    assert ingest.landing_rates(rows).agg(F.sum("n")).first()[0] == rows.count()


def test_clusters_match_union_find(spark, sf):
    pairs = reference.names(spark, sf).select(F.col("alias").alias("a"), F.col("vuln_id").alias("b"))
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs.collect():
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert {r.name: r.cluster for r in merge.alias_clusters(pairs).collect()} == {n: find(n) for n in up}


def test_clusters_around_a_hot_name(spark, monkeypatch):
    monkeypatch.setattr(merge, "HOT_LEAST", 20)
    star = [("hub", f"x{i:03}") for i in range(200)] + [(f"x{i:03}", f"y{i:03}") for i in range(0, 200, 2)] + [("z1", "z2"), ("z3", "z3"), (None, "z4"), ("z5", None)]
    got = {r.name: r.cluster for r in merge.alias_clusters(spark.createDataFrame(star, "a string, b string")).collect()}
    assert len(got) == 301 + 5 and {c for n, c in got.items() if n[0] != "z"} == {"hub"}
    assert {n: c for n, c in got.items() if n[0] == "z"} == {"z1": "z1", "z2": "z1", "z3": "z3", "z4": "z4", "z5": "z5"}


def test_command_line(tmp_path):
    with pytest.raises(SystemExit):
        main(["what"])
