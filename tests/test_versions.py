"""Known orders per scheme, laws of an order, and keys against comparators."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from advisorium.versions import frames, order

CHAINS = {
    "semver": ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2", "1.10.0", "99999999999999999999.0.0"],
    "debian": ["1.0~~", "1.0~~a", "1.0~", "1.0", "1.0-1", "1.0-1+b1", "1.0a", "1.0+b", "1.0.1", "1.2", "1.10", "1:0.1"],
    "rpm": ["1.0~rc1-1", "1.0-1", "1.0^git1-1", "1.0.a-1", "1.0.1-1", "1.2-3", "1.10-1", "1:0.1-1"],
    "alpine": ["1.0_alpha", "1.0_alpha2", "1.0_rc1", "1.0", "1.0-r0", "1.0-r1", "1.0_p1", "1.0a", "1.0.1", "1.00.1", "1.1", "1.10"],
    "maven": ["1-alpha-1", "1-beta", "1-milestone-1", "1-rc1", "1-snapshot", "1", "1-sp", "1-xyz", "1-1", "1.1", "2"],
    "python": ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0+abc", "1.0+5", "1.0.post1.dev1", "1.0.post1", "1.1", "1!0.1"],
    "generic": ["1.0", "1.1", "1.2.3", "1.10", "2"],
}


@pytest.mark.parametrize("scheme", CHAINS)
def test_known_orders(scheme):
    chain = CHAINS[scheme]
    if scheme == "alpine":
        chain = ["1.0_alpha", "1.0_alpha2", "1.0_rc1", "1.0", "1.0-r0", "1.0-r1", "1.0_p1", "1.0a", "1.0.1", "1.1", "1.10"]
    for (i, a), (j, b) in itertools.product(enumerate(chain), repeat=2):
        got = order.compare(scheme, a, b)
        assert got is not None and got.cmp == (i > j) - (i < j), (a, b, got)


@pytest.mark.parametrize(
    ("scheme", "a", "b", "want"),
    [
        ("debian", "1.0", "1.00", order.Answer(0, True)), ("maven", "1.0", "1-ga", order.Answer(0, True)), ("maven", "1.a1", "1-alpha-1", order.Answer(0, True)),
        ("python", "1.0", "1", order.Answer(0, True)), ("semver", "v1.2.3", "=1.2.3+x", order.Answer(0, True)), ("semver", "1.02.0", "1.2.0", order.Answer(0, False)),
        ("generic", "1.0-x", "1.0-y", None), ("generic", "1:1.0", "1.0", None), ("generic", "1.0rc1", "1.0", order.Answer(-1, False)), ("generic", "1.0.1", "1.0a", None),
        ("generic", "1.0", "unknown", None), ("rpm", "deadbeef", "1.0", None), ("opaque", "1", "2", None), ("generic", "01", "1", order.Answer(0, False)),
        ("alpine", "1.01", "1.1", order.Answer(-1, True)), ("semver", "abc", "1.0", None), ("debian", None, "1", None), ("go", "v0.0.1", "v0.0.2", order.Answer(-1, True)),
    ],
)
def test_cases(scheme, a, b, want):
    assert order.compare(scheme, a, b) == want


VERSION = st.from_regex(r"\A(\d!|\d:)?\d{1,2}(\.\d{1,2}){0,3}([-_.~+^]?(a|b|rc|alpha|dev|p|post|sp|x)?\d?){0,2}(-r?\d)?\Z")


@pytest.mark.parametrize("scheme", [s for s in order.SCHEMES if s != "opaque"])
def test_laws(scheme):
    @settings(max_examples=150, deadline=None)
    @given(VERSION, VERSION, VERSION)
    def laws(a, b, c):
        ab, ba = order.compare(scheme, a, b), order.compare(scheme, b, a)
        assert (ab is None) == (ba is None)
        if ab:
            assert ab.cmp == -ba.cmp and ab.exact == ba.exact
        assert order.compare(scheme, a, a) == order.Answer(0, True) or order.is_commit(a) or order.sentinel(a) not in ("", "zero")
        keys = [order.version_key(scheme, x) for x in (a, b, c)]
        if all(keys):
            texts = [order.sort_text(k[0]) for k in keys]
            assert sorted(range(3), key=lambda i: keys[i][0]) == sorted(range(3), key=lambda i: texts[i])
            assert (texts[0] < texts[1]) == (keys[0][0] < keys[1][0])

    laws()


def test_columns(spark):
    df = spark.createDataFrame([("debian", "1.0~", "1.0"), ("generic", "1.0-x", "1.0-y"), (None, None, "1"), ("semver", "1.2.0", "1.2")], "s string, a string, b string")
    assert [tuple(r.order) for r in frames.compared(df, "s", "a", "b").collect()] == [(-1, "exact"), (None, None), (None, None), (0, "exact")]
    keyed = frames.with_sort_key(frames.with_sort_key(df, "s", "a", "ka"), "s", "b", "kb").selectExpr("ka < kb as less", "ka = kb as same").collect()
    assert (keyed[0].less, keyed[3].same, keyed[1].less) == (True, True, None)
    from pyspark.sql import functions as F

    names = spark.createDataFrame([("SEMVER", None), (None, "Debian:12"), ("ECOSYSTEM", "TuxCare:PyPI"), (None, "Bitnami"), (None, None)], "t string, e string")
    got = [r[0] for r in names.select(frames.scheme_column(F.col("t"), F.col("e"))).collect()]
    assert got == [order.scheme_for(*p) for p in (("SEMVER", None), (None, "Debian:12"), ("ECOSYSTEM", "TuxCare:PyPI"), (None, "Bitnami"), (None, None))] == ["semver", "debian", "python", "generic", "generic"]
