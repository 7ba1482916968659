"""Training files: model inputs from timelines, targets, usable written rows and their mixture with real ones.

A file holds out one fold; its real rows are those of the other folds, and written rows come up to a dose on top.  All files
are made in one plan with ``held_out`` as a column, so they can be written partitioned by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.config import CLASSES, CLIP_MARK, NEIGHBOUR_CLIP, TOKEN_BUDGET
from quillspark.functions.text import clip, stable_rank
from quillspark.operators import ordering, render, timeline
from quillspark.sources.staging import stage

FOCAL = "[focal]\n"
SPANS = "array<struct<start:int,end:int>>"


def model_input(position: Column, n: Column, near: Column, focal: Column) -> Column:
    """A timeline input: place, neighbours by distance, the focal text between those before and after it.

    ``near``: sorted array of (offset, value).
    """
    line = lambda x: F.concat(F.lit("["), F.when(x["offset"] > 0, "+").otherwise(""), x["offset"].cast("string"), F.lit("] "), x["value"])
    some = lambda keep: F.transform(F.filter(near, keep), line)
    head = F.concat(F.lit("Post "), position.cast("string"), F.lit(" of "), n.cast("string"))
    return F.array_join(F.concat(F.array(head), some(lambda x: x["offset"] < 0), F.array(F.concat(F.lit(FOCAL), focal)), some(lambda x: x["offset"] > 0)), "\n")


def focal_text(rendered: Column) -> Column:
    """The focal text of a :func:`model_input`."""
    t = F.substring_index(rendered, FOCAL, -1)
    return F.when(F.contains(rendered, F.lit(FOCAL)), F.regexp_replace(t, r"(?s)\n\[\+[0-9]+\] .*$", ""))


def inputs(df: DataFrame, user: str, order: str, key: str, text: str, cover: str, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``df`` with input, kept (ranges of the focal text that stay), position and n_posts.

    ``cover``: (start, end) spans of the text that it is cut around where it is beyond the budget.
    """
    # Keys alone are put in order; texts meet their places afterwards.
    d = ordering.positioned(df.select(user, order, key), user, [order, key], "position", "n_posts")
    clipped = d.select(user, "_g", key).join(df.select(key, clip(F.col(text), NEIGHBOUR_CLIP, CLIP_MARK).alias("_t")), key)
    near = stage(ordering.neighbours(clipped, user, "_g", "_t", [-2, -1, 1]).join(d.select("_g", key, "position", "n_posts"), "_g").drop("_g"), "near")
    cut = timeline.truncated(df, text, budget, cover)
    return cut.join(near, key).withColumn("input", model_input(F.col("position"), F.col("n_posts"), F.col("near"), F.coalesce("short_text", F.lit("")))).drop("near", "short_text", "n_ranges")


def training_rows(df: DataFrame, risk: str, spans: str, factors: str, classes: list[str] = CLASSES) -> DataFrame:
    """``df`` (with kept) as target and skipped: the rendered target of rows that can be learnt from.

    ``spans``: supervised (start, end, slice) of the focal text.  Only those inside what is kept are evidence, in order; the
    lowest class has none; another class without evidence is skipped: ``truncated_out`` if it had any, else ``unalignable``.
    """
    held = F.array_sort(F.filter(F.coalesce(F.col(spans), F.array().cast("array<struct<start:int,end:int,slice:string>>")), lambda s: timeline.inside(s, F.col("kept"))))
    low = F.col(risk) == classes[0]
    evidence = F.when(low, F.array().cast("array<string>")).otherwise(F.transform(held, lambda s: s["slice"]))
    reason = F.when(low | (F.size(held) > 0), F.lit(None)).when(F.size(spans) > 0, "truncated_out").otherwise("unalignable")
    return df.withColumn("skipped", reason.cast("string")).withColumn("target", F.when(F.col("skipped").isNull(), render.target_map(F.col(risk), evidence, F.col(factors))))


def usable(df: DataFrame, risk: str, ranges: str, classes: list[str] = CLASSES) -> Column:
    """Whether a written row can be trained on: of the lowest class, or with verbatim evidence (ranges not null nor empty)."""
    return F.coalesce((F.col(risk) == classes[0]) | (F.size(ranges) > 0), F.lit(False))


def dosed(df: DataFrame, group: list[str], order: str, dose: int) -> DataFrame:
    """The first ``dose`` rows of each group in order; the limit is the feature."""
    g = F.concat_ws("/", *[F.col(c).cast("string") for c in group])
    # No partition hands on more than the dose of a group.
    return df.withColumn("_grp", g).withColumn("_place", F.row_number().over(Window.partitionBy("_grp").orderBy(order))).where(F.col("_place") <= dose).drop("_grp", "_place")


def inserted(written: DataFrame, timelines: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """``written`` (case_id, held_out, host, gap, short_text) with input and exemplars: the row as post gap + 1 of its host.

    ``timelines``: held_out, user, position, n_posts, row_id, text.  Only the few positions around the gap are fetched, by an
    equi-join on (held_out, user, position).
    """
    want = F.explode(F.sequence(F.col("gap") - (before - 1), F.col("gap") + after)).alias("position")
    w = written.select("case_id", "held_out", F.col("host").alias("user"), "gap", want)
    j = w.join(timelines, ["held_out", "user", "position"])
    offset = F.when(F.col("position") <= F.col("gap"), F.col("position") - F.col("gap") - 1).otherwise(F.col("position") - F.col("gap"))
    cell = F.struct(offset.cast("int").alias("offset"), clip(F.col("text"), NEIGHBOUR_CLIP, CLIP_MARK).alias("value"))
    near = j.groupBy("case_id", "held_out").agg(F.array_sort(F.collect_list(cell)).alias("near"), F.array_sort(F.collect_list("row_id")).alias("exemplars"), (F.max("n_posts") + 1).alias("n_posts"))
    d = written.join(near, ["case_id", "held_out"])
    return d.withColumn("input", model_input(F.col("gap") + 1, F.col("n_posts"), F.col("near"), F.col("short_text"))).drop("near", "n_posts")


def mixed(real: DataFrame, written: DataFrame, group: list[str], seed: str) -> DataFrame:
    """Real and written rows of each file in one seeded order: the columns of both and position (from 0) within the group."""
    d = real.unionByName(written, allowMissingColumns=True)
    g = F.concat_ws("/", *[F.col(c).cast("string") for c in group])
    # The digest in bytes sorts as it does in letters.
    p = ordering.positioned(d.withColumn("_grp", g), "_grp", [F.unhex(stable_rank(F.lit(seed), g, F.col("row_id"))), "row_id"], "_place", "_size")
    return p.withColumn("position", F.col("_place") - 1).drop("_grp", "_place", "_size", "_g")


def run_grid(files: DataFrame, arm: str, fold: str, weight: str, seeds: list[int]) -> DataFrame:
    """(arm, fold, seed, run_id, n_rows, mean_weight, digest): one run per file and seed; the digest is free of order."""
    f = files.groupBy(arm, fold).agg(F.count("*").alias("n_rows"), F.avg(weight).alias("mean_weight"), F.sum(F.xxhash64("row_id", "input", "target").cast("decimal(38,0)")).alias("digest"))
    d = f.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    return d.withColumn("run_id", F.concat(F.col(arm), F.lit("-f"), F.col(fold).cast("string"), F.lit("-s"), F.col("seed").cast("string")))


def composition(files: DataFrame, by: list[str], risk: str, factors: str, spans: str, words: str, classes: list[str] = CLASSES) -> DataFrame:
    """(by, n, share_<class>, factors_per_row, spans_per_row, words_per_row): spans over rows above the lowest class."""
    share = [F.avg((F.col(risk) == c).cast("double")).alias(f"share_{c.lower()}") for c in classes]
    return files.groupBy(*by).agg(F.count("*").alias("n"), *share, F.avg(F.size(factors)).alias("factors_per_row"), F.avg(F.when(F.col(risk) != classes[0], F.size(spans))).alias("spans_per_row"), F.avg(words).alias("words_per_row"))


def within_budget(df: DataFrame, tokens: str, budget: int) -> DataFrame:
    """(key columns of ``df``, over): rows whose prompt is beyond the budget of tokens, by how many."""
    return df.where(F.col(tokens) > budget).withColumn("over", F.col(tokens) - budget)
