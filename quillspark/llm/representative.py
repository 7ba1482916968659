"""Problem 2: the best representative of each group of same or near-same records, by iterative truth discovery.

Groups are connected components of verified near-same links.  Within the groups every record claims a value for each field
on behalf of its source (origin).  Two steps alternate until the reliabilities stand still: the weight of a value is the
sum of the reliabilities of the sources that claim it in the group, and the reliability of a source is the share of
support that its claims have, smoothed by a prior.  The value with the most support wins each field (golden record).  The
surviving record is the one that supports the group best: it claims something for the most fields, was updated last and
comes from the most trusted source; the support of its claims decides between equals, and the row id at last.

Defined results: entries that say nothing are no claims; a date that is missing or impossible (before 2000, after the
row's own delivery, or from 2100 on) counts as oldest; unknown origins have trust 0; a row delivered twice is one
record with the entries of all its deliveries; a group needs two records; no groups give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import neardup
from quillspark.llm.ids import said, slug, some
from quillspark.llm.unionfind import components
from quillspark.sources.staging import stage

FIELDS = ["title", "flair", "lang_hint", "risk_norm", "gold_eval_spans", "factors_set"]
ROUNDS, STILL, PRIOR = 10, 1e-3, 4.0


def possible(date: Column, delivered: Column) -> Column:
    """The date, or null where it is impossible."""
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("2000-01-01", "2100-01-01"))
    return F.when((date >= low) & (date < high) & ~F.coalesce(date > delivered, F.lit(False)), date)


def groups(posts: DataFrame) -> DataFrame:
    """(row_id, group_id) of train posts in groups of two or more same or near-same ones."""
    base = posts.where("split = 'train' and row_id is not null").select("row_id", F.col("post_raw").alias("text"))
    signed = stage(neardup.signed(base), "signed")
    rows = stage(signed.select("row_id", "node"), "rows")
    near = neardup.links(signed, base, "row_id", rows)
    roots = components(near)
    member = rows.select("row_id", "node").distinct().join(roots, "node", "left").select("row_id", F.coalesce("root", "node").alias("group_id"))
    large = member.groupBy("group_id").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).where("lo < hi").select("group_id")
    return stage(member.join(large, "group_id", "left_semi"), "groups")


def records(posts: DataFrame, gold: DataFrame, origins: DataFrame, member: DataFrame) -> DataFrame:
    """One record per row id of the groups: fields (null where nothing is said), updated_at, source, trust, label."""
    p = posts.join(member, "row_id")
    p = p.groupBy("group_id", "row_id").agg(*[F.max(said(F.col(c))).alias(c) for c in FIELDS[:3]], F.max(possible(F.col("updated_at"), F.col("ingested_at"))).alias("updated_at"), F.max(slug(F.col("origin"))).alias("source"))
    label = F.initcap(F.regexp_replace(said(F.col("risk_norm")), "[^\\p{L}]+", ""))
    listed = lambda c: F.when(some(F.col(c)), F.concat_ws("\x1f", F.array_sort(F.filter(c, lambda x: said(x).isNotNull()))))
    g = gold.join(member.select("row_id"), "row_id", "left_semi").groupBy("row_id").agg(F.max(F.when(label != "", label)).alias("risk_norm"), F.max(listed("gold_eval_spans")).alias("gold_eval_spans"), F.max(listed("factors_set")).alias("factors_set"))
    o = origins.select(slug(F.col("origin")).alias("source"), "trust").groupBy("source").agg(F.max("trust").alias("trust"))
    return p.join(g, "row_id", "left").join(o, "source", "left").withColumn("trust", F.coalesce("trust", F.lit(0)))


def discover(record: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(claims with their support, reliability per source) after the alternation.

    ``record``: group_id, row_id, source and ``fields``.  Claims: group_id, row_id, source, field, value, support (the
    share of the field's weight in the group that the value has).
    """
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields]))
    claims = stage(record.select("group_id", "row_id", F.coalesce("source", F.lit("")).alias("source"), value.alias("c")).select("group_id", "row_id", "source", "c.*").where("value is not null"), "claims")
    # Equal claims of one source in one group are one row with a count, so that hot groups stay small.
    votes = stage(claims.groupBy("group_id", "field", "value", "source").agg(F.count("*").alias("n")), "votes")
    trust = votes.select("source").distinct().withColumn("r", F.lit(0.8))
    before = trust.withColumnRenamed("r", "old")
    for _ in range(ROUNDS):
        weight = votes.join(trust, "source").groupBy("group_id", "field", "value").agg(F.sum(F.col("n") * F.col("r")).alias("w"))
        weight = weight.withColumn("support", F.col("w") / F.sum("w").over(Window.partitionBy("group_id", "field")))
        trust = stage(votes.join(weight, ["group_id", "field", "value"]).groupBy("source").agg(((F.sum(F.col("n") * F.col("support")) + F.lit(PRIOR * 0.8)) / (F.sum("n") + PRIOR)).alias("r")), "trust")
        # Sources are never collected: unlike the table of origins, what stands in the records is not bounded.
        moved = trust.join(before, "source").agg(F.max(F.abs(F.col("r") - F.col("old")))).first()[0]
        if moved is None or moved < STILL:
            break
        before = trust.withColumnRenamed("r", "old")
    weight = votes.join(trust, "source").groupBy("group_id", "field", "value").agg(F.sum(F.col("n") * F.col("r")).alias("w"))
    weight = weight.withColumn("support", F.col("w") / F.sum("w").over(Window.partitionBy("group_id", "field"))).select("group_id", "field", "value", "support")
    return claims.join(weight, ["group_id", "field", "value"]), trust


def survivors(record: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """``record`` with support, is_representative and, per group, best_<field> and is_label_conflict."""
    supported, _ = discover(record, fields)
    supported = stage(supported, "supported")
    support = supported.groupBy("group_id", "row_id").agg(F.sum("support").alias("support"))
    best = supported.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == c, F.struct("support", "value")))["value"].alias(f"best_{c}") for c in fields])
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    r = record.join(support, ["group_id", "row_id"], "left").withColumn("support", F.coalesce("support", F.lit(0.0))).withColumn("filled", filled)
    order = F.struct("filled", "updated_at", "trust", "support", F.struct(F.col("row_id")))
    top = r.groupBy("group_id").agg(F.max(order).alias("top"), (F.count_distinct("risk_norm") > 1).alias("is_label_conflict"))
    r = r.join(top.select("group_id", F.col("top.col5.row_id").alias("survivor"), "is_label_conflict"), "group_id")
    return r.withColumn("is_representative", F.col("row_id") == F.col("survivor")).drop("survivor").join(best, "group_id", "left")
