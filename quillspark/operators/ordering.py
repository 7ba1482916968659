"""Numbers in a global order without one task for all rows, and neighbours by number.

Rows are ranged by the order over partitions, sorted within them and numbered from the partition's offset.  Only one row
per partition is ever brought together.  Equal keys are broken by the later columns of the order; give a unique last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.sources.staging import release, stage


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0 to n - 1 in the order of the columns; nulls first; an empty table stays empty."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    # A column of the table is not written twice.
    cols = [c if isinstance(c, str) else f"_ord_{i}" for i, c in enumerate(order)]
    made = [c for c, given in zip(cols, order, strict=True) if not isinstance(given, str)]
    d = df.withColumns({c: k for c, k in zip(cols, keys, strict=True) if c in made})
    parts = stage(d.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_ord_p", F.spark_partition_id()), "ranged")
    sizes = parts.groupBy("_ord_p").agg(F.count("*").alias("_ord_n"))
    base = sizes.select("_ord_p", (F.coalesce(F.sum("_ord_n").over(Window.orderBy("_ord_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_ord_b"))
    local = F.row_number().over(Window.partitionBy("_ord_p").orderBy(*cols)) - 1
    # One row per range partition: as many as the session has shuffle partitions.
    return parts.withColumn("_ord_i", local).join(F.broadcast(base), "_ord_p").withColumn(name, F.col("_ord_i") + F.col("_ord_b")).drop(*made, "_ord_p", "_ord_i", "_ord_b")


def positioned(df: DataFrame, group: str, order: list[str | Column], name: str = "position", count: str = "n_in_group", index: str = "_g") -> DataFrame:
    """``df`` with ``name`` (from 1) within its group, the group's ``count`` and the global number ``index``.

    A group may hold any share of the rows: its positions come from the global numbers, not from a window over the group.
    Rows of a null group are one group.  Order columns that are given as expressions are not kept.
    """
    n = numbered(df, [group, *order], index)
    d = stage(n, "numbered")
    release(n)
    per = d.groupBy(group).agg(F.min(index).alias("_first"), F.count("*").alias(count))
    j = d.withColumnRenamed(group, "_grp").join(per.withColumnRenamed(group, "_key"), F.col("_grp").eqNullSafe(F.col("_key")))
    return j.withColumn(name, (F.col(index) - F.col("_first") + 1).cast("int")).withColumnRenamed("_grp", group).drop("_key", "_first")


def neighbours(df: DataFrame, group: str, index: str, value: str, offsets: list[int]) -> DataFrame:
    """(index, near): for each row the values of the rows of its group at the offsets that exist, as a list of (offset, value).

    Every row sends its value to the numbers it is a neighbour of, so the shuffle is by number and knows no hot group.
    """
    sent = F.explode(F.array(*[F.struct((F.col(index) - k).alias("to"), F.lit(k).alias("offset")) for k in offsets]))
    s = df.select(F.col(group).alias("_from"), F.col(value).alias("_v"), sent.alias("_s"))
    j = df.select(index, F.col(group).alias("_own")).join(s.select("_from", "_v", F.col("_s.to").alias(index), F.col("_s.offset").alias("offset")), index, "left")
    hit = F.when(F.col("_own").eqNullSafe(F.col("_from")) & F.col("offset").isNotNull(), F.struct("offset", F.col("_v").alias("value")))
    return j.groupBy(index).agg(F.array_sort(F.collect_list(hit)).alias("near"))
