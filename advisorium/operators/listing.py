"""Filtered, ordered and paged lists of the corpus, as column predicates that Catalyst pushes down."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advisorium.functions.text import tokens

ORDERINGS = ("modified", "published", "score", "epss", "id")
DEFAULT_LIMIT, MAX_LIMIT = 100, 1_000
RATINGS = ("NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
STATES = ("PUBLISHED", "REJECTED", "RESERVED", "WITHDRAWN")


@dataclass(frozen=True)
class ListFilter:
    """What a list asks for; all conditions hold together. ``kev=False`` asks for nothing."""

    modified_since: datetime | None = None
    published_since: datetime | None = None
    min_score: float | None = None
    max_score: float | None = None
    min_epss: float | None = None
    kev: bool = False
    ratings: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    cwes: tuple[str, ...] = ()
    text: str = ""
    cpe: str = ""
    purl: str = ""
    product: str = ""
    vendor: str = ""
    ecosystem: str = ""
    order_by: str = "modified"
    limit: int | None = None
    offset: int = 0
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.extra:
            raise ValueError(f"unknown parameters: {sorted(self.extra)}")
        if any("\x00" in v for f in fields(self) if isinstance(v := getattr(self, f.name), str)):
            raise ValueError("a parameter holds a NUL character")
        if self.order_by not in ORDERINGS:
            raise ValueError(f"order_by is one of {ORDERINGS}")
        for name, top in (("min_score", 10), ("max_score", 10), ("min_epss", 1)):
            v = getattr(self, name)
            if v is not None and not 0 <= v <= top:
                raise ValueError(f"{name} lies between 0 and {top}")
        if None not in (self.min_score, self.max_score) and self.min_score > self.max_score:
            raise ValueError("min_score exceeds max_score")
        if self.limit is not None and not 1 <= self.limit <= MAX_LIMIT or self.offset < 0:
            raise ValueError(f"limit lies between 1 and {MAX_LIMIT}, offset is not negative")
        for name, known in (("ratings", RATINGS), ("states", STATES)):
            if bad := [v for v in getattr(self, name) if v.upper() not in known]:
                raise ValueError(f"{name}: unknown {bad}")


def predicates(f: ListFilter) -> list[Column]:
    """Conditions on the corpus itself. A null score, time or array never passes a condition on it."""
    any_of = lambda c, values: F.upper(c).isin(*[v.upper() for v in values])
    overlap = lambda c, values: F.arrays_overlap(c, F.array(*[F.lit(v) for v in values]))
    words = F.concat_ws(" ", "id", "title", "description", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    asked = f.text.strip()
    given = [
        (f.modified_since, lambda: F.col("modified") >= F.lit(f.modified_since).cast("timestamp_ntz")),
        (f.published_since, lambda: F.col("published") >= F.lit(f.published_since).cast("timestamp_ntz")),
        (f.min_score is not None, lambda: F.col("primary_score") >= f.min_score),
        (f.max_score is not None, lambda: F.col("primary_score") <= f.max_score),
        (f.min_epss is not None, lambda: F.col("epss_score") >= f.min_epss),
        (f.kev, lambda: F.col("in_kev")),
        (f.ratings, lambda: any_of("primary_rating", f.ratings)),
        (f.states, lambda: any_of("state", f.states)),
        (f.sources, lambda: overlap("sources", f.sources)),
        (f.cwes, lambda: overlap("cwes", f.cwes)),
        (asked, lambda: F.size(F.array_except(tokens(F.lit(asked)), tokens(words))) == 0),
    ]
    return [make() for wanted, make in given if wanted]


def child_predicates(f: ListFilter) -> list[Column]:
    """Conditions that some statement of the flaw meets; each may be met by another statement."""
    same = lambda c, v: F.lower(c) == v.lower()
    given = [(f.cpe, lambda: F.array_contains("cpes", f.cpe)), (f.purl, lambda: F.col("purl") == f.purl)]
    given += [(v, lambda c=c, v=v: same(c, v)) for c, v in (("product", f.product), ("vendor", f.vendor), ("ecosystem", f.ecosystem))]
    return [make() for wanted, make in given if wanted]


def filtered(corpus: DataFrame, f: ListFilter, statements: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows of the corpus that meet the filter; one left-semi join per condition on statements."""
    own = predicates(f)
    out = corpus.filter(reduce(lambda a, b: a & b, own)) if own else corpus
    for condition in child_predicates(f):
        if statements is None:
            raise ValueError("the filter asks for statements")
        out = out.join(statements.filter(condition).select(F.col("vuln_id").alias(key)), key, "left_semi")
    return out


def order_columns(order_by: str) -> list[Column]:
    """The five orderings: newest or highest first, nulls last, always closed by the identifier."""
    column = {"modified": "modified", "published": "published", "score": "primary_score", "epss": "epss_score"}.get(order_by)
    return ([F.col(column).desc_nulls_last()] if column else []) + [F.col("id").asc()]


def effective_limit(requested: int | None) -> int:
    return DEFAULT_LIMIT if not requested or requested < 1 else min(requested, MAX_LIMIT)


def page(corpus: DataFrame, f: ListFilter, statements: DataFrame | None = None, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """The page a list asks for; sorts only the best ``offset + limit`` rows of each task."""
    rows = filtered(corpus, f, statements).orderBy(*order_columns(f.order_by), *tiebreak)
    return rows.offset(f.offset).limit(effective_limit(f.limit)) if f.offset else rows.limit(effective_limit(f.limit))


def total(corpus: DataFrame, f: ListFilter, statements: DataFrame | None = None) -> DataFrame:
    """Number of rows a list has over all its pages, as one row: total."""
    return filtered(corpus, f, statements).agg(F.count("*").alias("total"))
