"""Integrity checks as queries: each returns the violations, or one row of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import FOLDS, RARE_MINIMUM
from quillspark.functions.text import official_match, parse_evidence, ws_count


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that stand more than once; null keys too."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def evidence_counts(df: DataFrame, spans: str, risk: str, lowest: str) -> DataFrame:
    """One row: spans, posts with and without evidence, lowest class with evidence, others without."""
    n = F.coalesce(F.size(spans), F.lit(0))
    c = lambda x: F.count(F.when(x, 1))
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.greatest(n, F.lit(0))).cast("long").alias("n_spans"), c(n > 0).alias("with_evidence"), c(n <= 0).alias("without_evidence"), c((n > 0) & (F.col(risk) == lowest)).alias("lowest_with_evidence"), c((n <= 0) & (F.col(risk) != lowest)).alias("others_without"))


def round_trip(df: DataFrame, key: str, spans: str) -> DataFrame:
    """(key): rows whose spans, joined by semicolons and parsed again, differ."""
    return df.where(F.col(spans).isNotNull()).where(parse_evidence(F.array_join(spans, "; ")) != F.col(spans)).select(key)


def slice_errors(spans: DataFrame, posts: DataFrame) -> DataFrame:
    """(row_id, span_idx): spans whose slice is not the text between their offsets."""
    j = spans.where("raw_slice is not null and raw_start >= 0").join(posts, "row_id")
    return j.where(F.substring(F.col("post_raw"), F.col("raw_start") + 1, F.col("raw_end") - F.col("raw_start")) != F.col("raw_slice")).select("row_id", "span_idx").distinct()


def unscored(spans: DataFrame) -> DataFrame:
    """(row_id, span_idx): spans kept for supervision whose slice the scorer does not match with the phrase."""
    return spans.where("use_for_supervision and raw_slice is not null").where(~official_match(F.col("raw_slice"), F.col("text_gold"))).select("row_id", "span_idx").distinct()


def rung_census(spans: DataFrame) -> DataFrame:
    return spans.groupBy("rung").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_occurrences") > 1, 1)).alias("n_repeated"))


def split_components(df: DataFrame, component: str, fold: str) -> DataFrame:
    """(component, n_folds): components in more than one fold."""
    return df.where(f"{fold} is not null").groupBy(component).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def leaked(exemplars: DataFrame, folds: DataFrame, key: str, held_out: str, fold: str) -> DataFrame:
    """(key, held_out): exemplars of each training file that lie in the fold it holds out.

    ``exemplars``: (key, held_out), ``folds``: (key, fold).
    """
    j = exemplars.join(folds.select(key, F.col(fold).alias("_fold")), key)
    return j.where(F.col("_fold") == F.col(held_out)).select(key, held_out).distinct()


def thin_folds(df: DataFrame, fold: str, label: str, value: str, least: int = RARE_MINIMUM, folds: int = FOLDS) -> DataFrame:
    """(fold, n): folds with fewer than ``least`` rows of the class, those with none too."""
    every = df.sparkSession.range(folds).select(F.col("id").cast("int").alias(fold))
    n = df.where(F.col(label) == value).groupBy(F.col(fold).cast("int").alias(fold)).agg(F.count("*").alias("n"))
    return every.join(n, fold, "left").select(fold, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def absent_items(df: DataFrame, fold: str, items: str, taxonomy: list[str], folds: int = FOLDS) -> DataFrame:
    """(item, fold): entries of the taxonomy that no row of the fold has."""
    spark = df.sparkSession
    every = spark.range(folds).select(F.col("id").cast("int").alias(fold), F.explode(F.array(*map(F.lit, taxonomy))).alias("item"))
    have = df.select(F.col(fold).cast("int").alias(fold), F.explode(items).alias("item")).distinct()
    return every.join(have, [fold, "item"], "left_anti").select("item", fold)


def novel_characters(new: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """(character, n): characters beyond ASCII in ``new`` that no text of ``known`` has, with the texts that have them."""
    chars = lambda d: d.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([^\\x00-\\x7f])"), 1))).alias("character"))
    return chars(new).groupBy("character").agg(F.count("*").alias("n")).join(chars(known).distinct(), "character", "left_anti")


def span_constraints(df: DataFrame, key: str, spans: str, most: int) -> DataFrame:
    """(key, reason): spans with a separator or line break, or with more than ``most`` tokens."""
    reason = lambda s: F.when(s.rlike("[;\n]"), "separator").when(ws_count(s) > most, "long")
    return df.select(key, F.explode(F.transform(spans, reason)).alias("reason")).where("reason is not null").distinct()


def overrides(df: DataFrame, key: str, given: str, resolved: str, flag: str) -> DataFrame:
    """(key, flagged): rows whose resolved label is not the given one."""
    return df.where(~F.col(given).eqNullSafe(F.col(resolved))).select(key, F.col(flag).alias("flagged"))


def expect(got: DataFrame, want: DataFrame, name: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """(name, got, want, ok): figures against the ones they must reproduce; a figure that one side lacks is not ok."""
    j = got.select(name, F.col(value).cast("double").alias("got")).join(want.select(name, F.col(value).cast("double").alias("want")), name, "full")
    return j.withColumn("ok", F.coalesce(F.abs(F.col("got") - F.col("want")) <= tolerance, F.lit(False)))


def demand(result: DataFrame) -> None:
    """Raises if any row of :func:`expect` is not ok; at most 20 of them are named."""
    bad = result.where("not ok").limit(20).collect()
    if bad:
        raise AssertionError("; ".join(f"{r[0]}: {r['got']} for {r['want']}" for r in bad))


def representatives(df: DataFrame, cluster: str, flag: str) -> DataFrame:
    """(cluster, n): clusters without exactly one representative."""
    return df.groupBy(cluster).agg(F.count(F.when(F.col(flag), 1)).alias("n")).where("n <> 1")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only one side has."""
    only = lambda x, y, name: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").select(F.lit(name).alias("side"), key)
    return only(a, b, "left").union(only(b, a, "right"))


def response_errors(annotations: DataFrame, classes: list[str], taxonomy: list[str]) -> DataFrame:
    """(case_id, annotator, reason): the first field of an answer that is out of range."""
    bad = lambda c, low, high: F.col(c).isNotNull() & ~F.col(c).between(low, high)
    label = F.initcap(F.regexp_replace("risk", "[^A-Za-z]+", ""))
    odd = F.coalesce(F.exists("factors", lambda f: ~F.coalesce(f.isin(taxonomy), F.lit(False))), F.lit(False))
    reason = F.when(F.col("risk").isNull(), "no risk").when(~label.isin([*classes, "Unclear"]), "risk").when(bad("naturalness", 1, 5), "naturalness").when(bad("confidence", 1, 3), "confidence").when(odd, "factors").when(~F.col("status").isin("complete", "in_progress"), "status")
    return annotations.select("case_id", "annotator", reason.alias("reason")).where("reason is not null").distinct()


def digest(df: DataFrame) -> DataFrame:
    """One row: n and an order-free digest of all rows, to compare two builds."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))
