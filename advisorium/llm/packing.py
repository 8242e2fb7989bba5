"""Containers of fixed capacity filled with texts, by vector bin packing.

An item is a vector (tokens, segments, loss-bearing tokens). A container is filled one item at a time with the item
of the largest dot product between its demand and what the container has left, each dimension weighed by how scarce
it is over all items of the task. Items longer than the capacity are split into full containers and one rest.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advisorium.session import Workspace, ship_package


@dataclass(frozen=True)
class Limits:
    """Capacity of a container in each dimension."""

    tokens: int = 2_048
    segments: int = 256
    loss_tokens: int = 2_048


#: A task packs about so many items; what its last containers leave unused is packed again with that of others.
ITEMS_PER_TASK = 25_000
#: A container filled less than this in the first round is opened again and packed with those of other tasks.
WELL_FILLED = 0.98
#: Cells of the grid of demands: levels of tokens, quantiles of segments and of the share of tokens that bear loss.
GRID = (64, 4, 6)


def fill(tokens: np.ndarray, loss: np.ndarray, segments: np.ndarray, limits: Limits) -> np.ndarray:
    """Container number of each item, from 0. No item exceeds a limit on its own.

    Items lie in the cells of a coarse grid of their demands, in each cell by tokens. A step scores the largest item of
    every cell, and where only smaller ones of a cell fit the tokens left the largest of those, by the dot product with
    what the container still lacks of its fair share in each dimension, and places the best that fits. So items that
    are long in one dimension and short in another are mixed from the first container to the last, and a step costs one
    pass over the cells, however many items and different vectors there are. A container in which nothing fits any more
    is closed.
    """
    n = len(tokens)
    out = np.empty(n, dtype=np.int64)
    if not n:
        return out
    demand = np.stack([tokens, segments, loss], axis=1).astype(np.int64)
    capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.int64)
    share = demand / capacity
    need = share.sum(axis=0)
    fair = capacity * need / need.max()  # what a container holds of each dimension if all are filled alike
    weight = np.divide(1.0, fair**2, out=np.zeros(3), where=fair > 0)
    level = np.minimum((share[:, 0] * GRID[0]).astype(np.int64), GRID[0] - 1)
    code = (level * GRID[1] + _quantile(demand[:, 1], GRID[1])) * GRID[2] + _quantile(share[:, 2] / np.maximum(share[:, 0], 1e-12), GRID[2])
    order = np.lexsort((tokens, code))
    codes, starts = np.unique(code[order], return_index=True)
    held = [part.tolist() for part in np.split(order, starts[1:])]
    sizes = [np.asarray(tokens)[part].tolist() for part in held]
    by_level: dict[int, list[int]] = {}
    for c, x in enumerate(codes // (GRID[1] * GRID[2])):
        by_level.setdefault(int(x), []).append(c)
    beyond = np.array([limits.tokens + 1, 0, 0], dtype=np.int64)  # what an empty cell shows
    top = np.stack([demand[part[-1]] for part in held])
    left = capacity.copy()
    container = placed = 0
    while placed < n:
        wanted = np.maximum(fair - (capacity - left), 0.0) * weight
        score = top @ wanted
        score[(top > left).any(axis=1)] = -1.0
        cell = int(score.argmax())
        best, at = score[cell], -1
        for c in by_level.get(min(int(left[0] * GRID[0] // capacity[0]), GRID[0] - 1), ()):
            if top[c, 0] > left[0] and sizes[c] and sizes[c][0] <= left[0]:
                i = bisect_right(sizes[c], left[0]) - 1
                item = demand[held[c][i]]
                if (item <= left).all() and (value := item @ wanted) > best:
                    best, cell, at = value, c, i
        if best < 0:
            container += 1
            left = capacity.copy()
            continue
        item = held[cell].pop(at)
        sizes[cell].pop(at)
        out[item] = container
        left -= demand[item]
        top[cell] = demand[held[cell][-1]] if held[cell] else beyond
        placed += 1
    return out


def _quantile(values: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` quantiles of all values each belongs to; equal values share one."""
    edges = np.unique(np.quantile(values, np.arange(1, n) / n))
    return np.searchsorted(edges, values, side="left")


def split_items(sizes: DataFrame, key: str, limits: Limits) -> DataFrame:
    """Pieces to pack: key, part_no, start_token, n_tokens, loss_tokens, n_segments.

    An item counts as ``n_segments`` of its container, 1 where ``sizes`` has no such column, and so does each of its
    pieces. Only what exceeds the capacity is split, into full pieces and a rest; items without tokens give no piece. The
    loss-bearing tokens of a split item are spread over its pieces in proportion, earlier pieces rounded up.
    """
    cap = min(limits.tokens, limits.loss_tokens)
    segments = F.greatest(F.coalesce(F.col("n_segments"), F.lit(1)), F.lit(1)).cast("int") if "n_segments" in sizes.columns else F.lit(1)
    parts = F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / cap).cast("int") - 1)
    at = F.col("part_no").cast("bigint") * cap
    held = sizes.filter(F.col(key).isNotNull() & (F.col("n_tokens") > 0)).select(key, "n_tokens", F.explode(parts).alias("part_no"), F.col("loss_tokens").alias("all_loss"), F.col("n_tokens").alias("whole"), segments.alias("n_segments"))
    n = F.least(F.lit(cap), F.col("whole") - at)
    upto = lambda end: F.ceil(F.col("all_loss") * end / F.col("whole"))
    return held.select(key, "part_no", at.alias("start_token"), n.cast("bigint").alias("n_tokens"), (upto(at + n) - upto(at)).cast("bigint").alias("loss_tokens"), "n_segments")


def _pack_task(limits: Limits, columns: list[str]):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(columns[:2] + ["copy"], kind="stable", ignore_index=True)
        number = fill(items["n_tokens"].to_numpy(), items["loss_tokens"].to_numpy(), items["n_segments"].to_numpy(), limits)
        items["container_id"] = f"{items['task'].iat[0]}-" + pd.Series(number).astype(str)
        return items[[*columns, "container_id"]]

    return run


def _round(items: DataFrame, n_items: int, limits: Limits, salt: str, label: str, schema: str) -> DataFrame:
    """Items spread by a hash over tasks of bounded size, each packed on its own."""
    tasks = max(1, -(-n_items // ITEMS_PER_TASK))
    columns = items.columns
    spread = items.withColumn("task", F.pmod(F.xxhash64(F.lit(salt), *columns[:2], "copy"), F.lit(tasks)).cast("int"))
    packed = spread.groupBy("task").applyInPandas(_pack_task(limits, columns), schema)
    return packed.withColumn("container_id", F.concat(F.lit(label), "container_id"))


def pack(sizes: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """Every item in a container: key, part_no, start_token, n_tokens, loss_tokens, n_segments, container_id.

    ``sizes``: key, n_tokens, loss_tokens and perhaps n_segments. An item of more segments than a container may hold is
    an error. First all pieces are packed in tasks of bounded size; the containers
    that a task could not fill well are opened again and their items packed together, in tasks of the same bound.
    Full pieces are containers of their own and never meet Python. Items of size 0 and null keys take no space and
    give no row; repeated keys are packed each on its own.
    """
    ship_package(sizes.sparkSession)
    work = Workspace(sizes.sparkSession, "packing")
    pieces = split_items(sizes, key, limits)
    kind = sizes.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, part_no int, start_token bigint, n_tokens bigint, loss_tokens bigint, n_segments int, container_id string"
    pieces = work.store(pieces.withColumn("copy", F.monotonically_increasing_id()), "pieces")
    schema_items = schema.replace(", container_id", ", copy bigint, container_id")
    whole = lambda c, limit: F.col(c) >= limit
    full = whole("n_tokens", limits.tokens) | whole("loss_tokens", limits.loss_tokens) | whole("n_segments", limits.segments)
    if not pieces.filter(F.col("n_segments") > limits.segments).isEmpty():
        raise ValueError(f"an item has more than {limits.segments} segments")
    alone = pieces.filter(full).withColumn("container_id", F.concat(F.lit("f"), F.col("copy").cast("string")))
    rest = pieces.filter(~full)
    first = work.store(_round(rest, rest.count(), limits, "first", "a", schema_items), "first")
    load = first.groupBy("container_id").agg(F.sum("n_tokens").alias("held"), F.sum("loss_tokens").alias("held_loss"), F.sum("n_segments").alias("held_items"))
    poor = load.filter(
        (F.col("held") < WELL_FILLED * limits.tokens) & (F.col("held_loss") < WELL_FILLED * limits.loss_tokens) & (F.col("held_items") < limits.segments)
    ).select("container_id")
    again = first.join(poor, "container_id", "left_semi").drop("container_id")
    n_again = again.count()
    second = _round(again.select(*rest.columns), n_again, limits, "second", "b", schema_items)
    kept = first.join(poor, "container_id", "left_anti")
    return alone.unionByName(kept).unionByName(second).drop("copy")


def fill_report(packed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """How well the containers are used: n_containers, n_pieces, n_tokens, unused_share, most_tokens, most_segments, most_loss, least_possible."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p"), F.sum("n_segments").alias("s"), F.sum("loss_tokens").alias("l"))
    total = each.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_tokens"),
        F.max("t").alias("most_tokens"), F.max("s").alias("most_segments"), F.max("l").alias("most_loss"),
    )
    unused = 1 - F.col("n_tokens") / (F.col("n_containers") * limits.tokens)
    return total.select("n_containers", "n_pieces", "n_tokens", F.round(unused, 6).alias("unused_share"), "most_tokens", "most_segments", "most_loss", F.ceil(F.col("n_tokens") / limits.tokens).alias("least_possible"))
