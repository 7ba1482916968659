"""Problem 3: splits that keep related records together.

Records of one author, or of same or near-same text, are one component: authors and text classes are the nodes of a
bipartite graph that :mod:`unionfind` resolves.  Components then go, largest first, to the split furthest below its target.

The greedy order is exact at any size without a driver loop over components: components of equal size are
interchangeable, so the greedy choice only needs the number of components of each size (at most sqrt(2 n) sizes for n
records).  How many of them each split gets follows from the largest deficits; numbering within a size is salted.

Defined results: a record without author or words stands alone, as far as its other link goes; null row ids are left out;
a record delivered twice is one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import neardup
from quillspark.llm.ids import person
from quillspark.llm.unionfind import components
from quillspark.sources.staging import stage

SALTS = 256


def related(records: DataFrame) -> DataFrame:
    """``records`` (row_id, author, text, others) as (row_id, others, component), staged.

    component is the least node id of the component: a 64-bit digest of an author or a text class.
    """
    kept = [c for c in records.columns if c not in ("author", "text")]
    base = records.where(F.col("row_id").isNotNull()).withColumn("owner", F.xxhash64(F.lit("author"), person(F.col("author")))).withColumn("owner", F.when(person(F.col("author")).isNotNull(), F.col("owner")))
    signed = stage(neardup.signed(base.select("row_id", "owner", "text")), "signed")
    rows = stage(signed.select("row_id", "owner", "node"), "rows")
    near = neardup.links(signed, base.select("row_id", "text"), "row_id", rows)
    # Only classes that tie authors together matter: linked ones, and those of several authors.
    shared = rows.groupBy("node").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.max(F.col("owner").isNull()).alias("open"))
    several = shared.where("open or lo <> hi").select("node")
    linked = near.select(F.col("a").alias("node")).union(near.select("b")).union(several).distinct()
    ties = rows.join(linked, "node", "left_semi").where("owner is not null").select(F.col("owner").alias("a"), F.col("node").alias("b")).distinct()
    roots = components(ties.union(near))
    mine = base.select(*kept, "owner").join(rows.join(linked, "node", "left_semi").groupBy("row_id").agg(F.min("node").alias("node")), "row_id", "left")
    key = F.coalesce("owner", "node", F.xxhash64(F.lit("row"), F.col("row_id")))
    return stage(mine.withColumn("key", key).join(roots.withColumnRenamed("node", "key"), "key", "left").select(*kept, F.coalesce("root", "key").alias("component")), "related")


def quotas(sizes: list[tuple[int, int]], shares: list[float]) -> list[tuple[int, int, int, int]]:
    """(size, split, from, to): which components of each size, numbered from 0, the greedy rule gives to each split.

    ``sizes``: (size, number of components).  Equals placing components one by one, largest first, into the split with
    the largest deficit (ties: the first split): each split offers the falling deficits D, D - size, ...; the greedy rule
    takes the largest offers of all splits.
    """
    total = sum(s * n for s, n in sizes)
    scale = sum(shares)
    deficit = [total * x / scale for x in shares]
    out = []
    for s, n in sorted(sizes, reverse=True):
        low, high = min(deficit) - s * (n + 1), max(deficit) + s
        for _ in range(200):  # the deficit down to which offers are taken
            mid = (low + high) / 2
            if sum(max(0, int((d - mid) // s) + 1) for d in deficit if d >= mid) > n:
                low = mid
            else:
                high = mid
        take = [max(0, int((d - high) // s) + 1) if d >= high else 0 for d in deficit]
        while sum(take) < n:
            i = max(range(len(shares)), key=lambda f: (deficit[f] - s * take[f], -f))
            take[i] += 1
        at = 0
        for f, k in enumerate(take):
            if k:
                out.append((s, f, at, at + k))
            at += k
            deficit[f] -= s * k
    return out


def assign(members: DataFrame, shares: list[float]) -> DataFrame:
    """(row_id, component, split): ``members`` (row_id, component) with the number of the split they fall to."""
    spark = members.sparkSession
    distinct = members.select("row_id", "component").distinct()
    groups = stage(distinct.groupBy("component").agg(F.count("*").alias("size")), "sizes").withColumn("salt", F.pmod(F.hash("component"), F.lit(SALTS)))
    counts = groups.groupBy("size", "salt").agg(F.count("*").alias("n"))
    plan = quotas([(r[0], r[1]) for r in counts.groupBy("size").agg(F.sum("n")).toLocalIterator()], shares)
    ranges = spark.createDataFrame(plan, "size long, split int, low long, high long")
    before = counts.withColumn("base", F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).select("size", "salt", "base")
    number = F.row_number().over(Window.partitionBy("size", "salt").orderBy("component")) - 1
    placed = groups.withColumn("k", number).join(before, ["size", "salt"]).withColumn("k", F.col("k") + F.col("base")).alias("g").join(ranges.alias("r"), (F.col("g.size") == F.col("r.size")) & (F.col("k") >= F.col("low")) & (F.col("k") < F.col("high"))).select("component", "split")
    return distinct.join(placed, "component").select("row_id", "component", "split")


def train_records(posts: DataFrame) -> DataFrame:
    """Train posts as the records of :func:`related`."""
    return posts.where("split = 'train'").select("row_id", F.col("anon_user_id").alias("author"), F.col("post_raw").alias("text"), "fold")


def torn(members: DataFrame) -> DataFrame:
    """(row_id): records of components that hold more than one stored fold; null folds aside."""
    bad = members.groupBy("component").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).where("lo <> hi").select("component")
    return members.join(bad, "component", "left_semi").select("row_id").distinct()
