"""The training-data problems against plain Python versions, and their behaviour on odd input."""

import base64
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from advisorium.llm import components, encode, lookalike, packing, queries, survivor


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def norm(text):
    import brute

    return brute.norm_id(text)


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return sorted((n, find(n)) for n in nodes)


def test_p6_found(spark, sf, duck):
    pairs = [(norm(a), norm(b)) for a, b in duck.execute("select alias, vuln_id from vuln_aliases").fetchall()]
    for i, aliases in duck.execute("select id, aliases from vulnerabilities").fetchall():
        pairs += [(norm(i), norm(a)) for a in aliases or [None]]
    nodes = {x for p in pairs for x in p if x}
    assert rows(queries.p6_found(spark, sf)) == union_find(nodes, [p for p in pairs if all(p)])


@pytest.mark.parametrize("kind", ["path", "star", "empty", "random"])
def test_components_shapes(spark, kind):
    rng = np.random.default_rng(3)
    n = 300
    order = [f"n{i:04d}" for i in rng.permutation(n)]
    pairs = {
        "path": list(zip(order, order[1:])),
        "star": [(order[0], x) for x in order[1:]] * 2,
        "empty": [],
        "random": [tuple(order[i] for i in rng.integers(0, n, 2)) for _ in range(200)],
    }[kind]
    df = spark.createDataFrame([*pairs, (None, "n0001"), ("n0002", None), ("n0003", "n0003")], "a string, b string")
    nodes = df.select(F.explode(F.array("a", "b")).alias("identifier"))
    got = rows(components.groups(nodes, components.links(df, "a", "b")))
    assert got == union_find({x for p in [*pairs, ("n0001", "n0002"), ("n0003", "n0003")] for x in p}, pairs)


def test_hot_nodes_take_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_SHARE", 0.05)
    monkeypatch.setattr(components, "max", lambda *_: 20, raising=False)
    pairs = [("hub", f"x{i:03d}") for i in range(200)] + [(f"x{i:03d}", f"y{i:03d}") for i in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = rows(components.groups(df.select(F.explode(F.array("a", "b")).alias("identifier")), components.links(df, "a", "b")))
    assert {g for _, g in got} == {"hub"} and len(got) == 401


def test_survivor_cases(spark):
    t = "timestamp '2024-01-0{} 00:00:00'"
    values = [
        f"(1, 'CVE-2024-0001', 'tbd.', array('NVD '), {t.format(1)}, {t.format(2)}, {t.format(3)}, 'x')",
        f"(2, ' cve-2024-0001', 'cut sho', array('osv'), timestamp '1970-01-01 00:00:00', {t.format(9)}, {t.format(3)}, 'x')",
        f"(3, 'CVE-2024-0001', 'whole text', array('osv', null), null, {t.format(3)}, {t.format(3)}, 'x')",
        f"(4, 'CVE-2024-0001', 'whole text', array('osv'), null, {t.format(3)}, {t.format(3)}, 'x')",
        "(5, 'CVE-2024-0002', null, null, null, null, null, 'x')",
        "(6, 'CVE-2024-0002', '', array(), null, null, null, 'x')",
        "(7, 'CVE-2024-0003', 'alone', array('nvd'), null, null, null, 'x')",
        "(8, null, 'no id', array('nvd'), null, null, null, 'x')",
    ]
    df = spark.sql("select * from values " + ", ".join(values) + " as t(record_no, id, description, sources, published, modified, updated_at, n)")
    from advisorium.functions.ids import identifier

    got = rows(survivor.survivors(df, identifier("id"), {"nvd": 2, "osv": 8}))
    assert got == [("CVE-2024-0001", 3, 1, 3, "nvd,osv"), ("CVE-2024-0002", 0, 0, 0, "")]
    assert survivor.survivors(df.limit(0), identifier("id"), {}).count() == 0


@pytest.fixture(scope="module")
def rank_encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_p8_ids(spark, sf, duck, rank_encoding):
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, sf).collect()}
    docs = duck.execute("select doc_id, text from documents").fetchall()
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i] == rank_encoding.encode_ordinary(t or "")


def test_encode_odd_texts(spark):
    texts = [None, "", " ", "<|endoftext|>", "a" * 50_000, "👩‍💻 é é", "\x00\x01", "日本語"]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "k long, text string, ids string")
    both = encode.encode_with_offsets(df, "k", "text").orderBy("k").collect()
    assert both[0].ids == [] and both[1].ids == [] and 50256 not in both[3].ids
    back = {r.k: r.text for r in encode.decode(spark.createDataFrame([(r.k, r.ids) for r in both] + [(99, None)], "k long, ids array<int>"), "k").collect()}
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts] and back[99] == ""
    for r, t in zip(both, texts):
        assert max(r.ends, default=0) == len(t or "")
    assert rows(encode.count_tokens(df, "k", "text")) == [(r.k, len(r.ids)) for r in both]


def test_p8_round_trip(spark, sf):
    df = queries.p8_round_trip(spark, sf)
    assert df.filter("not same or not whole").count() == 0 and df.count() == 1000


def test_p9_containers(spark, sf, duck, rank_encoding):
    got = queries.p9_containers(spark, sf).collect()
    sizes = {i: len(rank_encoding.encode_ordinary(t or "")) for i, t in duck.execute("select doc_id, text from documents").fetchall()}
    pieces, load = defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r.doc_id].append((r.start_token, r.n_tokens))
        load[r.container_id] += r.n_tokens
    assert set(pieces) == {i for i, n in sizes.items() if n}
    for i, p in pieces.items():
        p.sort()
        assert [s for s, _ in p] == [2048 * k for k in range(len(p))] and sum(n for _, n in p) == sizes[i]
        assert len(p) == 1 or sizes[i] > 2048
    assert max(load.values()) <= 2048
    assert len(load) <= 1.01 * -(-sum(sizes.values()) // 2048) + 1


def test_pack_limits_and_cases(spark):
    items = [(i, n, n and n // 2) for i, n in enumerate([0, None, 5, 5, 5, 9, 10, 11, 25, 1, 1, 1, 1])] + [(2, 5, 2), (None, 3, 1)]
    df = spark.createDataFrame(items, "k long, n_tokens long, loss_tokens long").withColumn("copy", F.lit("clash"))
    limits = packing.Limits(tokens=10, segments=3, loss_tokens=10)
    got = packing.pack(df.select("k", "n_tokens", "loss_tokens"), "k", limits).collect()
    load = defaultdict(list)
    for r in got:
        load[r.container_id].append((r.n_tokens, r.loss_tokens))
    assert all(sum(t for t, _ in v) <= 10 and sum(x for _, x in v) <= 10 and len(v) <= 3 for v in load.values())
    assert sum(r.n_tokens for r in got) == sum(n or 0 for k, n, _ in items if k is not None)
    assert sum(r.loss_tokens for r in got) == sum(x or 0 for k, n, x in items if k is not None and n)
    assert {r.k for r in got if r.part_no} == {7, 8}
    assert packing.pack(df.limit(0).select("k", "n_tokens", "loss_tokens"), "k", limits).count() == 0


def test_fill_is_near_the_bound():
    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 900, 3000)
    number = packing.fill(tokens, tokens, np.ones(3000, dtype=int), packing.Limits())
    load = np.bincount(number, weights=tokens)
    assert load.max() <= 2048 and len(load) <= -(-tokens.sum() // 2048) + 2


def test_fill_under_three_limits():
    """Vectors that are nearly all different: every limit holds, and in time that does not grow with their number."""
    rng = np.random.default_rng(2)
    tokens = np.minimum(rng.lognormal(5, 1.2, 30_000).astype(int) + 1, 2047)
    loss, segments = (tokens * rng.random(len(tokens))).astype(int), rng.integers(1, 5, len(tokens))
    limits = packing.Limits()
    number = packing.fill(tokens, loss, segments, limits)
    loads = [np.bincount(number, weights=x) for x in (tokens, segments, loss)]
    assert [x.max() <= top for x, top in zip(loads, (2048, 256, 2048))] == [True] * 3 and loads[0].min() > 0
    assert len(loads[0]) <= 1.01 * tokens.sum() / 2048
    # Each limit binds in turn.
    for t, s, x in ((1000, 1, 1), (1, 128, 1), (1, 1, 1000)):
        n = packing.fill(np.full(100, t), np.full(100, x), np.full(100, s), limits)
        assert n.max() + 1 == 50 and np.bincount(n).max() == 2


def test_pack_counts_segments(spark):
    df = spark.createDataFrame([(i, 10, 10, 3) for i in range(10)] + [(10, 10, 0, None)], "k long, n_tokens long, loss_tokens long, n_segments int")
    got = packing.pack(df, "k", packing.Limits(100, 7, 100)).collect()
    load = defaultdict(int)
    for r in got:
        load[r.container_id] += r.n_segments
    assert len(got) == 11 and max(load.values()) <= 7 and len(load) == 5
    with pytest.raises(ValueError, match="segments"):
        packing.pack(df, "k", packing.Limits(100, 2, 100))


def test_hot_spelling_is_spread(spark, monkeypatch):
    """A third of all documents share one spelling: pairs are whole and each once."""
    monkeypatch.setattr(lookalike, "PER_SALT", 50)
    texts = [(i, "admin" if i % 3 else "\u0430dmin" if i % 2 else f"other {i}") for i in range(600)]
    prints = lookalike.fingerprints(spark.createDataFrame(texts, "k long, text string"), "k", "text")
    latin, mixed = ([i for i, t in texts if t == x] for x in ("admin", "\u0430dmin"))
    assert rows(lookalike.look_pairs(prints, "k")) == sorted((min(a, b), max(a, b)) for a in latin for b in mixed)


def test_stand_ins_by_their_words(spark):
    nothing = [None, "", " ", "N/A", "??", "No description available.", "TBD", "** RESERVED ** Details follow once the vendor has published.", "See references…", "Placeholder entry, text will be supplied later", "no " * 50_000]
    something = ["A flaw in x", "Details: buffer", "no auth", "緩衝", "cve in parser", "to be published by acme", "the " * 50_000 + "x"]
    df = spark.createDataFrame([(t,) for t in nothing + something], "t string")
    assert [r[0] for r in df.select(survivor.says_something("t")).collect()] == [False] * len(nothing) + [True] * len(something)


def plain_form(t):
    """The one form by Python alone: character by character."""
    singles, several = lookalike.single_map(), {**lookalike.LIGATURES, **lookalike.several_map()}
    t = unicodedata.normalize("NFC", t)
    out = []
    for i, c in enumerate(t):
        o = ord(c)
        if o == 0x200D and 0 < i < len(t) - 1 and all(0x1F000 <= ord(x) <= 0x1FAFF or 0x2190 <= ord(x) <= 0x2BFF or ord(x) == 0xFE0F for x in (t[i - 1], t[i + 1])):
            out.append(c)
        elif o in (0xAD, 0x34F, 0x61C, 0x180E, 0xFEFF) or 0x200B <= o <= 0x200F or 0x2060 <= o <= 0x2064 or 0xFE00 <= o <= 0xFE0D:
            continue
        else:
            out.append(several.get(c) or singles.get(c, c))
    return unicodedata.normalize("NFC", "".join(out)).replace("\r\n", "\n")


def test_p10_found(spark, sf, duck):
    groups = defaultdict(list)
    for i, t in duck.execute("select doc_id, text from documents where text is not null").fetchall():
        groups[plain_form(t)].append((i, t))
    want = set()
    for form, docs in groups.items():
        if any(not c.isspace() and unicodedata.category(c)[0] not in "ZC" for c in form):
            want |= {(min(a, b), max(a, b)) for a, x in docs for b, y in docs if x != y}
    assert rows(queries.p10_found(spark, sf)) == sorted(want)
    forms = {r.doc_id: r.one_form for r in queries.p10_texts(spark, sf).collect()}
    assert all(forms[i] == form for form, docs in groups.items() for i, _ in docs)


def test_lookalike_cases(spark):
    same = [
        ("résumé", "résumé"), ("a b", "a b"), ("admin", "аdmin"), ("ＡＢＣ１", "ABC1"), ("file", "ﬁle"),
        ("no-op", "no‑op"), ("pass​word", "password"), ("ό", "ό"), ("ё", "ё"), ("カ", "ｶ"),
        ("ガ", "ｶﾞ"), ("a\r\nb", "a\nb"), ("Ἀx", "Ἀx"), ("so­ft", "soft"),
    ]
    apart = [
        ("e", "é"), ("A", "a"), ("10", "1⁰"), ("½", "1/2"), ("a b", "a  b"), ("–", "-"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), (None, ""), ("", " "),
    ]
    texts = [t for p in same + apart for t in p]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k long, text string, one string")
    forms = {r.k: r.one_form for r in lookalike.in_one_form(df, "text").collect()}
    assert len(forms) == len(texts) and set(lookalike.in_one_form(df, "text").columns) == {"k", "one", "one_form"}
    for i in range(len(same)):
        assert forms[2 * i] == forms[2 * i + 1], same[i]
    for i in range(len(same), len(same) + len(apart)):
        assert forms[2 * i] != forms[2 * i + 1], apart[i - len(same)]
    pairs = rows(lookalike.look_pairs(lookalike.fingerprints(df, "k", "text"), "k"))
    assert set(pairs) >= {(2 * i, 2 * i + 1) for i in range(len(same))}
    big = spark.createDataFrame([(1, "x" * 3_000_000 + "é"), (2, None)], "k long, text string")
    assert {r.k: r.one_form and len(r.one_form) for r in lookalike.in_one_form(big, "text").collect()} == {1: 3_000_001, 2: None}
    assert lookalike.look_pairs(lookalike.fingerprints(df.limit(0), "k", "text"), "k").count() == 0
