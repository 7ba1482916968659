"""Distributed union-find: local forests, merged hierarchically.

Edges are dealt evenly over partitions of at most ``EDGES`` each, without regard to their ends, so that a node with a tenth
of all edges is no hot key.  Every partition reduces its edges to a spanning forest (one edge per node that is not a root).
Forests are then merged, a few partitions into one, level by level.  One task never holds more than ``bound`` forest edges:
while the forests hold more, rounds of alternating large and small stars shrink them first, and if they alone reach the
fixed point, no merge in one task happens at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.staging import stage

BOUND, FAN, EDGES = 1_000_000, 8, 500_000


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Node to the least node of its component, for all nodes that are in a pair."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (parent := up.setdefault(root, root)) != root:
            root = parent
        while (parent := up[x]) != root:
            up[x], x = root, parent
        return root

    for a, b in pairs:
        if a is None or b is None:
            continue
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = forest((a, b) for t in batches for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
    out = [(x, r) for x, r in found.items() if x != r]
    for i in range(0, len(out), 65536):
        part = out[i : i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], ["a", "b"])


def _forests(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_local, "a long, b long")


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; (a, b) with b < a."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    return large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()


def components(edges: DataFrame, bound: int = BOUND, partitions: int | None = None) -> DataFrame:
    """(node, root): the least node of the component of each node that is in an edge (a, b).

    Null ends and loops are no edges; repeated and reversed edges count once; no edges give no rows.
    """
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b"), "edges")
    size, before = e.count(), None
    n = partitions or max(1, -(-size // EDGES))
    now = stage(_forests(e.repartition(n)), "forest")
    size = now.count()
    while size > bound:
        now = stage(_stars(now), "stars")
        size, mark = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if (size, mark) == before:
            return _finish(now)
        before = size, mark
        if size > bound:
            now = stage(_forests(now.repartition(max(1, -(-size // EDGES)))), "forest")
            size = now.count()
    while n > 1:
        n = -(-n // FAN)
        now = stage(_forests(now.repartition(n)), "forest")
    return _finish(now)


def _finish(stars: DataFrame) -> DataFrame:
    stars = stage(stars, "components")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
