"""Records of many sources merged into documents in order of arrival, with identity by shared names.

Gap filling depends on arrival; what it depends on is reduced to one first arrival per document and rank, so documents
are folded by aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from advisorium.functions.ids import namespace_rank
from advisorium.functions.severity import source_rank
from advisorium.session import Workspace

SCALARS = ("title", "description", "assigner", "state")
SETS = ("aliases", "related", "cwes", "tags")
MAX_ROUNDS = 60
#: A name with more than this share of all edges is hot; there are at most 1 / share such names.
HOT_SHARE = 1 / 2000
HOT_LEAST = 100_000


def accepted_records(records: DataFrame) -> DataFrame:
    """``records`` with ``stale``: whether a record is older than the newest of the same (source, record_id) before it.

    A record without modified is always accepted and clears the mark, so what came before it no longer counts.
    """
    own = Window.partitionBy("source", "record_id").orderBy("seq")
    epoch = F.sum(F.col("modified").isNull().cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    marked = records.withColumn("__epoch", epoch)
    newest = F.max("modified").over(Window.partitionBy("source", "record_id", "__epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("stale", F.coalesce(F.col("modified") < newest, F.lit(False))).drop("__epoch")


def last_contributions(records: DataFrame) -> DataFrame:
    """The last accepted record of each (source, record_id): what it no longer states is retired with the rest."""
    fresh = records.filter(~F.col("stale"))
    last = fresh.groupBy("source", "record_id").agg(F.max("seq").alias("seq"))
    return fresh.join(last, ["source", "record_id", "seq"], "left_semi")


def folded_documents(records: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One document per ``key`` from records in arrival order (seq, or ``order``).

    Scalars: a non-empty incoming value counts where the document has none or the record's source is at least as
    trusted as the best source so far; ties go to the later. published is the earliest, modified the latest, sets
    are united. Stale records add names only. A record's withdrawal counts until the same record returns without
    it; another record sets it where none is, or with at least the authority of the owner.

    A record may speak until the first one of a better rank arrives, so what is needed of the order is one first
    arrival per document and rank; with those at hand every field is an aggregate with partial results, and no
    document's records are ever held together. Only those of records that withdraw are replayed in sequence. Beside
    the fields come ``best`` (rank of the best source), and ``owner`` and ``owner_rank`` of the withdrawal; records
    that stand for documents may bring such columns, null elsewhere.
    """
    given = records.columns
    me = F.concat_ws("\x1f", "source", "record_id")
    rank = source_rank(F.col("source"))
    rows = records.withColumns({
        "__o": order if order is not None else F.col("seq"), "__rank": F.coalesce("best", rank) if "best" in given else rank,
        "__me": F.coalesce("owner", me) if "owner" in given else me, "__owner_rank": F.coalesce("owner_rank", rank) if "owner_rank" in given else rank,
    })
    live = rows.filter(~F.col("stale"))
    firsts = live.groupBy(key, "__rank").agg(F.min("__o").alias("first"))
    cuts = firsts.groupBy(key).agg(F.collect_list(F.struct(F.col("__rank").alias("rank"), "first")).alias("__firsts"))  # one per rank of a source
    better = F.array_min(F.transform(F.filter("__firsts", lambda x: x["rank"] < F.col("__rank")), lambda x: x["first"]))
    marked = rows.join(cuts, key, "left").withColumn("__strong", better.isNull() | (F.col("__o") < better))
    when_live = lambda c: F.when(~F.col("stale"), c)

    def scalar(s: str) -> Column:
        said = ~F.col("stale") & (F.coalesce(F.trim(s), F.lit("")) != "")
        last, first = F.max_by(s, F.when(said & F.col("__strong"), F.col("__o"))), F.min_by(s, F.when(said, F.col("__o")))
        return F.coalesce(last, first).alias(s)

    united = lambda s: F.coalesce(s, F.array().cast("array<string>"))
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(united(s) if s in ("aliases", "related") else when_live(united(s)))))).alias(s) for s in SETS]
    out = marked.groupBy(key).agg(
        *[scalar(s) for s in SCALARS], F.min_by("source", when_live(F.struct("__rank", "__o"))).alias("source"), F.coalesce(F.min(when_live(F.col("__rank"))), F.lit(1_000)).alias("best"),
        F.min(when_live(F.col("published"))).alias("published"), F.max(when_live(F.col("modified"))).alias("modified"), *sets,
    )
    return out.join(_withdrawals(live, key), key, "left").select(key, *SCALARS, "source", "published", "modified", "withdrawn", *SETS, "best", "owner", "owner_rank")


def _withdrawals(live: DataFrame, key: str) -> DataFrame:
    """The withdrawal of each document that ever had one: key, withdrawn, owner, owner_rank."""
    setters = live.filter("withdrawn is not null").select(key, "__me").distinct()
    row = F.struct(F.col("__o").alias("o"), F.col("__me").alias("me"), F.col("__owner_rank").alias("rank"), "withdrawn")
    chains = live.join(setters, [key, "__me"], "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.struct(F.lit(None).cast(live.schema["withdrawn"].dataType).alias("withdrawn"), F.lit("").alias("owner"), F.lit(1_000).alias("owner_rank"))

    def take(doc: Column, r: Column) -> Column:
        sets_it = r["withdrawn"].isNotNull() & (doc["withdrawn"].isNull() | (doc["owner"] == r["me"]) | (r["rank"] <= doc["owner_rank"]))
        clears = r["withdrawn"].isNull() & (doc["owner"] == r["me"])
        return F.struct(
            F.when(sets_it, r["withdrawn"]).when(clears, F.lit(None)).otherwise(doc["withdrawn"]).alias("withdrawn"),
            F.when(sets_it, r["me"]).when(clears, "").otherwise(doc["owner"]).alias("owner"), F.when(sets_it, r["rank"]).when(clears, 1_000).otherwise(doc["owner_rank"]).alias("owner_rank"),
        )

    return chains.withColumn("d", F.aggregate("rows", empty, take)).select(key, "d.*").filter("withdrawn is not null")


def merged_children(children: DataFrame, keys: list[str]) -> DataFrame:
    """Union of child rows by key, the latest in arrival standing."""
    w = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return children.withColumn("__at", F.row_number().over(w)).filter("__at = 1").drop("__at")


def canonical_ids(members: DataFrame, group: str, name: str) -> DataFrame:
    """The name a cluster goes by: best namespace, then smallest: group, canonical_id."""
    best = F.min(F.struct(namespace_rank(name).alias("r"), F.col(name).alias("n"))).alias("b")
    return members.groupBy(group).agg(best).select(group, F.col("b.n").alias("canonical_id"))


def _renamed(edges: DataFrame, moved: DataFrame, side: str, n_edges: int) -> DataFrame:
    """``edges`` with the names of one side replaced by the places they moved to.

    Names with more than ``HOT_SHARE`` of the edges are looked up by a broadcast, of which there are at most
    ``1 / HOT_SHARE``; all others are joined by name.
    """
    threshold = max(HOT_LEAST, int(n_edges * HOT_SHARE))
    to = moved.select(F.col("a").alias(side), F.col("to").alias("__to"), "degree")
    if n_edges <= threshold:
        return edges.join(to.drop("degree"), side).drop(side).withColumnRenamed("__to", side)
    hot = F.broadcast(to.filter(F.col("degree") > threshold).select(side, F.col("__to").alias("__hot")))
    marked = edges.join(hot, side, "left")
    rest = marked.filter("__hot is null").drop("__hot").join(to.filter(F.col("degree") <= threshold).drop("degree"), side)
    both = marked.filter("__hot is not null").withColumnRenamed("__hot", "__to").unionByName(rest)
    return both.drop(side).withColumnRenamed("__to", side)


def alias_clusters(pairs: DataFrame) -> DataFrame:
    """Clusters of names that share a record, by contraction: name, cluster (the smallest name of the cluster).

    Each round every name moves to the neighbour that comes first in an order drawn anew by hash, and edges are drawn
    between the places moved to. Random orders leave no long chains, so a constant share of the names goes in every
    round, on paths as on stars. Rounds are written to the shared folder, of which the last of each kind stay.
    """
    work = {k: Workspace(pairs.sparkSession, f"clusters-{k}") for k in ("edges", "labels", "moves")}
    store = lambda df, kind: work[kind].store(df, kind, keep=2)
    known = pairs.filter("a is not null and b is not null and a != b").select("a", "b")
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).filter("name is not null").distinct()
    edges = store(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(names.select("name", F.col("name").alias("label")), "labels")
    for r in range(MAX_ROUNDS):
        n_edges = edges.count()
        if not n_edges:
            return labels.join(labels.groupBy("label").agg(F.min("name").alias("cluster")), "label").select("name", "cluster")
        drawn = lambda c: F.struct(F.xxhash64(F.lit(r), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        first = edges.groupBy("a").agg(F.min(drawn("b")).alias("m"), F.count("*").alias("degree")).select("a", F.least(drawn("a"), F.col("m"))["n"].alias("to"), "degree")
        moved = store(first, "moves")
        whole = _renamed(_renamed(edges, moved, "a", n_edges), moved, "b", n_edges)
        edges = store(whole.select("a", "b").filter("a != b").distinct(), "edges")
        labels = store(labels.join(moved.select(F.col("a").alias("label"), "to"), "label", "left").select("name", F.coalesce("to", "label").alias("label")), "labels")
    raise RuntimeError(f"names still move after {MAX_ROUNDS} rounds")
