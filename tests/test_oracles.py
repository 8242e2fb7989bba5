"""Every query that has SQL against DuckDB, compared as the driver does: columns by name, rows in any order."""

import math

import __spark_entry__ as entry
import pytest


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else f"{v:.6f}"
        if isinstance(v, (list, tuple)):
            return tuple(value(x) for x in v)
        if isinstance(v, bool):
            return str(v)
        return None if v is None else str(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = canonical(df.columns, got), canonical(names, want)
    assert len(a) == len(b)
    assert a == b
