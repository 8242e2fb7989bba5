"""Version orders over columns: Arrow batches in, structs or sort keys out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.session import ship_package
from advisorium.versions import order

KEYED = tuple(order.KEYS)


def compared(df: DataFrame, scheme: str, a: str, b: str, out: str = "order") -> DataFrame:
    """``df`` with ``out``: struct of cmp (-1, 0, 1; null: not comparable) and certainty (exact, heuristic)."""
    ship_package(df.sparkSession)

    @F.pandas_udf("cmp int, certainty string")
    def run(s: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        answers = [order.compare(i or "generic", j, k) for i, j, k in zip(s, x, y)]
        return pd.DataFrame({"cmp": pd.array([r and r.cmp for r in answers], "Int32"), "certainty": [r and ("exact" if r.exact else "heuristic") for r in answers]})

    return df.withColumn(out, run(scheme, a, b))


def with_sort_key(df: DataFrame, scheme: str, text: str, out: str = "sort_key") -> DataFrame:
    """``df`` with a string that sorts as the scheme orders; null where there is none.

    Written once beside the versions, it turns range tests and sorts into comparisons that stay in the JVM.
    """
    ship_package(df.sparkSession)

    @F.pandas_udf("string")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        keys = [None if order.sentinel(x) in ("empty", "all", "unknown") or order.is_commit(x) else order.version_key(i, order.clean(x)) for i, x in zip(s, t)]
        return pd.Series([k and order.sort_text(k[0]) for k in keys], dtype=object)

    return df.withColumn(out, run(scheme, text))


def scheme_column(range_type: Column, ecosystem: Column) -> Column:
    """Scheme of a range, as a plain expression."""
    types = F.create_map(*[F.lit(x) for p in order.TYPE_SCHEME.items() for x in p])
    ecosystems = F.create_map(*[F.lit(x) for p in order.ECOSYSTEM_SCHEME.items() for x in p])
    head = F.lower(F.trim(F.split_part(ecosystem, F.lit(":"), F.lit(1))))
    tail = F.lower(F.trim(F.split_part(ecosystem, F.lit(":"), F.lit(2))))
    by_head, by_tail = F.try_element_at(ecosystems, head), F.try_element_at(ecosystems, tail)
    eco = F.when(by_head.isNotNull() & ~head.isin(*order.REISSUERS), by_head).otherwise(F.coalesce(by_tail, by_head))
    return F.coalesce(F.try_element_at(types, F.upper(F.trim(range_type))), eco, F.lit("generic"))
