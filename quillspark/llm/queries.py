"""Queries of the problems: pN_found and reports.  Each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import charforms, consensus, crosssplit, leakage, mixing, pairs, representative, spans, splits, subjects
from quillspark.sources.staging import stage
from quillspark.sources.tables import table

FOLDS = [0.2] * 5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.consensus(table(spark, folder, "annotations"))


def p1_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.agreement(table(spark, folder, "annotations")).withColumn("majority_cases", F.array_join("majority_cases", ","))


def p1_reliability(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reliability(table(spark, folder, "annotations"))


def p2_survivors(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "posts")
    member = representative.groups(posts)
    record = representative.records(posts, table(spark, folder, "gold", "row_id", "risk_norm", "gold_eval_spans", "factors_set"), table(spark, folder, "origins"), member)
    return representative.survivors(stage(record, "records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_survivors(spark, folder).where("is_representative").select("row_id").distinct()


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign(splits.related(splits.train_records(table(spark, folder, "posts"))), FOLDS).withColumnRenamed("split", "fold")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.torn(splits.related(splits.train_records(table(spark, folder, "posts"))))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.pairs(table(spark, folder, "posts"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.counts(table(spark, folder, "posts"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(table(spark, folder, "outputs", "draft_id", "case_id", "text", "status", "stop_reason"), table(spark, folder, "prompts"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spans.post_and_draft_records(table(spark, folder, "posts", "row_id", "post_raw"), table(spark, folder, "outputs", "draft_id", "text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.pairs(_records(spark, folder))


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shares(_records(spark, folder))


def p6_removed(spark: SparkSession, folder: str) -> DataFrame:
    return spans.removed(_records(spark, folder))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return charforms.other_form_texts(table(spark, folder, "posts", "row_id", "post_raw"), table(spark, folder, "spans", "row_id", "span_idx", "text_gold", "raw_slice"))


def p7_found_spans(spark: SparkSession, folder: str) -> DataFrame:
    return charforms.found_spans(table(spark, folder, "posts", "row_id", "post_raw"), table(spark, folder, "spans", "row_id", "span_idx", "text_gold"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p8_clean_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    kept = leakage.clean(docs, stage(p8_found(spark, folder), "leaks"))
    return kept.groupBy("source").agg(F.count("*").alias("n_docs"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subjects(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "subject_labels"), table(spark, folder, "subjects"))


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(stage(p10_found(spark, folder), "subjects"), table(spark, folder, "documents", "doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1].isdigit()}


_AGREEMENT = """WITH a AS (SELECT case_id, lower(trim(annotator)) AS annotator, batch_id, coalesce(risk, '') AS risk, coalesce(submitted_at, TIMESTAMP '0001-01-01 00:00:00') AS sent FROM annotations WHERE case_id IS NOT NULL AND annotator IS NOT NULL AND lower(trim(status)) = 'complete'),
l AS (SELECT *, regexp_replace(risk, '[^\\p{L}]+', '', 'g') AS w, row_number() OVER (PARTITION BY case_id, annotator ORDER BY sent DESC, risk DESC, batch_id DESC NULLS LAST) AS i FROM a),
u AS (SELECT case_id, batch_id, list_position(['Indicator', 'Ideation', 'Behavior', 'Attempt'], upper(w[1]) || lower(w[2:])) AS k FROM l WHERE i = 1),
c AS (SELECT batch_id, case_id, count(*) AS m, count(*) FILTER (k = 1) AS c0, count(*) FILTER (k = 2) AS c1, count(*) FILTER (k = 3) AS c2, count(*) FILTER (k = 4) AS c3 FROM u WHERE k > 0 GROUP BY batch_id, case_id),
p AS (SELECT *, c0 * (c0 - 1) + c1 * (c1 - 1) + c2 * (c2 - 1) + c3 * (c3 - 1) AS pairs, CASE WHEN m >= 2 THEN (c0 * (c0 - 1) + c1 * (c1 - 1) + c2 * (c2 - 1) + c3 * (c3 - 1))::DOUBLE / (m * (m - 1)) END AS agree FROM c),
g AS (SELECT batch_id, count(*) AS n_cases, avg((agree = 1)::INT) AS exact, avg(agree) AS p, sum(pairs::DOUBLE / (m - 1)) FILTER (m >= 2) AS same, sum(m) FILTER (m >= 2) AS total, sum(c0) FILTER (m >= 2) AS t0, sum(c1) FILTER (m >= 2) AS t1, sum(c2) FILTER (m >= 2) AS t2, sum(c3) FILTER (m >= 2) AS t3, coalesce(string_agg(case_id, ',' ORDER BY case_id) FILTER (agree < 1), '') AS majority_cases FROM p GROUP BY batch_id),
f AS (SELECT *, (t0 * t0 + t1 * t1 + t2 * t2 + t3 * t3)::DOUBLE / (total * total) AS chance, 1 - (t0 * (t0 - 1) + t1 * (t1 - 1) + t2 * (t2 - 1) + t3 * (t3 - 1))::DOUBLE / (total * (total - 1)) AS off FROM g)
SELECT batch_id, n_cases, round(exact, 6) AS risk_exact_agreement, round(CASE WHEN chance < 1 THEN (p - chance) / (1 - chance) END, 6) AS risk_fleiss_kappa, round(CASE WHEN off > 0 THEN 1 - (1 - same / total) / off END, 6) AS risk_alpha, majority_cases FROM f"""


def oracle_sql() -> dict[str, str]:
    """Plain reports only: the other queries can't be put in SQL that is fast enough on whole tables."""
    return {"p1_agreement": _AGREEMENT}
