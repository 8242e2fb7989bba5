"""The merging store: identity, folding, precedence, late records, retirement and writers that race."""

import threading
from datetime import datetime

import pytest

from advisorium.operators import store
from advisorium.plans.merged import _records
from advisorium.sources.bucketed import BucketedTables
from advisorium.sources.shared import StaleState

FIELDS = "seq long, source string, record_id string, names array<string>, modified timestamp_ntz, withdrawn timestamp_ntz, title string, description string, statements array<struct<key:string,body:string>>"


def batch(spark, *rows):
    return _records(spark.createDataFrame([tuple(r.get(f.split()[0]) for f in FIELDS.split(", ")) for r in rows], FIELDS))


def record(seq, source, record_id, names, **more):
    return {"seq": seq, "source": source, "record_id": record_id, "names": names} | more


def docs(s):
    return {r.doc_id: r for r in s.documents().collect()}


def test_documents_are_folded_and_renamed(spark, tmp_path):
    s = store.RecordStore(spark, f"file://{tmp_path}/s", 4)
    first = s.apply(batch(
        spark, record(1, "osv", "o1", ["GHSA-aaaa-bbbb-cccc"], title="from osv", description="long"), record(2, "nvd", "n1", ["cve-2024-1000 "], title="from nvd"),
        record(3, "nvd", "n2", ["N/A", None]), record(4, None, "x", ["CVE-2024-1"]), record(5, "csaf", "c", ["VENDOR-7"], title="alone"),
    ))
    assert first == store.Counts(5, 2, 0, 3, 0)
    assert {k: r.title for k, r in docs(s).items()} == {"GHSA-aaaa-bbbb-cccc": "from osv", "CVE-2024-1000": "from nvd", "VENDOR-7": "alone"}
    # A record that names both makes them one, under the name of the best namespace; the better source speaks.
    second = s.apply(batch(spark, record(6, "ghsa", "g1", ["GHSA-AAAA-bbbb-cccc", "CVE-2024-1000"], title="from ghsa")))
    assert (second.seen, second.written, second.folded) == (1, 1, 1)
    d = docs(s)
    assert set(d) == {"CVE-2024-1000", "VENDOR-7"} and d["CVE-2024-1000"].title == "from nvd"
    assert d["CVE-2024-1000"].description == "long" and d["CVE-2024-1000"].aliases == ["GHSA-aaaa-bbbb-cccc"] and d["CVE-2024-1000"].source == "nvd"
    assert {r.name: r.doc_id for r in s.names().collect()}["GHSA-aaaa-bbbb-cccc"] == "CVE-2024-1000"
    # A name of the folded document still leads to it.
    s.apply(batch(spark, record(7, "cvelist", "k", ["GHSA-aaaa-bbbb-cccc"], title="from cvelist")))
    assert docs(s)["CVE-2024-1000"].title == "from cvelist" and len(docs(s)) == 2


def test_late_records_and_retirement(spark, tmp_path):
    at = lambda d: datetime(2024, 1, d)
    said = lambda *keys: [(k, k) for k in keys]
    s = store.RecordStore(spark, f"file://{tmp_path}/s", 4)
    one = "CVE-2024-1000"
    s.apply(batch(spark, record(1, "nvd", "n", [one], modified=at(5), title="new", statements=said("a", "b")), record(2, "osv", "o", [one], statements=said("b"))))
    assert sorted(r.key for r in s.statements().collect()) == ["a", "b"]
    assert [r.key for r in s.claimed_by_others("nvd", "n").collect()] == ["b"]
    late = s.apply(batch(spark, record(3, "nvd", "n", [one, "X-1"], modified=at(4), title="old", statements=said("z"))))
    assert late.stale == 1 and docs(s)[one].title == "new" and docs(s)[one].aliases == ["X-1"]
    assert sorted(r.key for r in s.statements().collect()) == ["a", "b"]
    s.apply(batch(spark, record(4, "nvd", "n", [one], modified=at(6), title="newest", statements=said("c"))))
    assert sorted(r.key for r in s.statements().collect()) == ["b", "c"]  # a is gone, b is claimed by another
    s.apply(batch(spark, record(5, "nvd", "n", [one], modified=None), record(6, "nvd", "n", [one], modified=at(1), title="after", withdrawn=at(9))))
    assert docs(s)[one].title == "after" and docs(s)[one].withdrawn == at(9)
    s.apply(batch(spark, record(7, "osv", "o", [one], title="osv")))
    assert docs(s)[one].withdrawn == at(9) and docs(s)[one].title == "after"
    s.apply(batch(spark, record(8, "nvd", "n", [one], modified=at(2))))
    assert docs(s)[one].withdrawn is None
    empty = s.apply(batch(spark, record(9, None, None, None)))
    assert (empty.seen, empty.failed, empty.written) == (1, 1, 0) and len(docs(s)) == 1


def test_of_two_transactions_one_is_refused(spark, tmp_path):
    from pyspark.sql.types import StructType

    tables = BucketedTables(spark, f"file://{tmp_path}/t", {"t": ["k"]}, {"t": StructType.fromDDL("k long, v string")}, 4)
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    a, b = tables.begin(), tables.begin()
    a.replace("t", rows(*((i, "a") for i in range(20))))
    b.replace("t", rows((1, "b")))
    a.commit()
    with pytest.raises(StaleState):
        b.commit()
    before = tables.pointer.read()[1]["t"]
    c = tables.begin()
    c.replace("t", rows((1, "c")), spark.createDataFrame([(2,)], "k long"))
    c.commit()
    after = tables.pointer.read()[1]["t"]
    got = {r.k: r.v for r in tables.read("t").collect()}
    assert got == {i: "c" if i == 1 else "a" for i in range(20) if i != 2}
    assert 1 <= sum(before[x] != after[x] for x in before) <= 2  # other buckets stay where they are


def test_racing_batches_are_both_merged(spark, tmp_path):
    s = store.RecordStore(spark, f"file://{tmp_path}/s", 2)
    work = [threading.Thread(target=s.apply, args=(batch(spark, record(i, "nvd", str(i), [f"CVE-2024-{1000 + i}"], title="t")),)) for i in (1, 2)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert set(docs(s)) == {"CVE-2024-1001", "CVE-2024-1002"}


def test_a_stream_is_merged(spark, tmp_path):
    import json

    from advisorium.sources import documents
    from advisorium.streaming import ingest

    (tmp_path / "landing").mkdir()
    doc = lambda i, **more: {"id": i, "modified": "2024-05-01T00:00:00Z", "affected": [{"package": {"ecosystem": "npm", "name": "tinymd"}}]} | more
    put = lambda name, *docs: (tmp_path / "landing" / name).write_text("".join(json.dumps({"source": "osv", "record_id": x["id"], "content": json.dumps(x), "landed_at": "2024-01-01T00:00:00Z"}) + "\n" for x in docs))
    where = ingest.Landing("osv", *(f"file://{tmp_path}/{x}" for x in ("landing", "archive", "records", "checkpoint")))
    s = store.RecordStore(spark, f"file://{tmp_path}/s", 4)
    put("a.json", doc("GHSA-aaaa-bbbb-cccc", summary="one"), doc("X-9", summary="other"))
    ingest.start(spark, where, documents.parse_osv, store=s).awaitTermination()
    assert {k: (r.title, r.modified) for k, r in docs(s).items()} == {"GHSA-aaaa-bbbb-cccc": ("one", datetime(2024, 5, 1)), "X-9": ("other", datetime(2024, 5, 1))}
    put("b.json", doc("GHSA-aaaa-bbbb-cccc", summary="two", aliases=["CVE-2024-1000"], modified="2024-05-02T00:00:00Z", affected=[]), doc("X-9", summary="other"))
    ingest.start(spark, where, documents.parse_osv, store=s).awaitTermination()
    assert {k: r.title for k, r in docs(s).items()} == {"CVE-2024-1000": "two", "X-9": "other"}
    assert [(r.doc_id, r.key.split(":")[0]) for r in s.statements().collect()] == [("X-9", "affected")]
    number = s.tables.pointer.read()[0]
    assert s.apply(store.records_of(spark.read.parquet(f"file://{tmp_path}/records/batch=1"), 1)).written == 1  # once more changes nothing
    assert docs(s)["CVE-2024-1000"].title == "two" and s.tables.pointer.read()[0] == number + 1
