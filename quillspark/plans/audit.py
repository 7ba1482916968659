"""Queries of the audit: agreement of annotators, consensus, fidelity to assigned labels, reports per arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import CLASSES, FACTORS, RARE
from quillspark.functions.text import ws_count
from quillspark.operators import agreement
from quillspark.plans.base import DRAFTS, SQL_ASSIGNED, assigned, drafts, sql_count, sql_list
from quillspark.plans.catalog import query
from quillspark.sources.tables import table

_LAB = "regexp_replace(risk, '[^A-Za-z]+', '', 'g')"
_RATE = f"""ra AS (SELECT case_id, annotator, submitted_at, upper({_LAB}[1]) || lower({_LAB}[2:]) AS label FROM annotations WHERE status = 'complete' AND case_id IS NOT NULL AND annotator IS NOT NULL),
rr AS (SELECT case_id, annotator, label, row_number() OVER (PARTITION BY case_id, annotator ORDER BY submitted_at DESC NULLS LAST, label DESC NULLS LAST) AS i FROM ra), r AS (SELECT case_id, annotator, label FROM rr WHERE i = 1 AND label IS NOT NULL)"""
_TIDY = lambda c: f"list_sort(list_distinct(list_filter({c}, lambda x: x IS NOT NULL)))"
# The last complete answers with all their fields, as operators.agreement.answers orders them.
_ANSWERS = f"""aa AS (SELECT case_id, annotator, submitted_at, upper({_LAB}[1]) || lower({_LAB}[2:]) AS risk, {_TIDY('evidence')} AS evidence, {_TIDY('factors')} AS factors, {_TIDY('issue_tags')} AS issue_tags, CAST(naturalness AS INTEGER) AS naturalness, CAST(confidence AS INTEGER) AS confidence FROM annotations WHERE status = 'complete' AND case_id IS NOT NULL AND annotator IS NOT NULL),
ab AS (SELECT *, row_number() OVER (PARTITION BY case_id, annotator ORDER BY submitted_at DESC NULLS LAST, risk DESC NULLS LAST, evidence DESC NULLS LAST, factors DESC NULLS LAST, issue_tags DESC NULLS LAST, naturalness DESC NULLS LAST, confidence DESC NULLS LAST) AS i FROM aa), ans AS (SELECT * EXCLUDE (i, submitted_at) FROM ab WHERE i = 1)"""


def _label() -> F.Column:
    return F.initcap(F.regexp_replace("risk", "[^A-Za-z]+", ""))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return agreement.ratings(table(spark, d, "annotations"), _label())


def _answers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "annotations")
    return agreement.answers(a.withColumns({c: F.col(c).cast("int") for c in ("naturalness", "confidence")}), _label())


@query(f"WITH {_RATE}, j AS (SELECT x.annotator AS a, y.annotator AS b, x.label AS p, y.label AS q FROM r x JOIN r y ON x.case_id = y.case_id AND x.annotator < y.annotator WHERE x.label <> 'Unclear' AND y.label <> 'Unclear'), t AS (SELECT a, b, count(*) AS n, avg((p = q)::INT) AS o FROM j GROUP BY a, b), l AS (SELECT a, b, p AS label, count(*) AS l FROM j GROUP BY ALL), s AS (SELECT a, b, q AS label, count(*) AS r FROM j GROUP BY ALL), e AS (SELECT a, b, sum(l * r) AS lr FROM l JOIN s USING (a, b, label) GROUP BY a, b), z AS (SELECT t.*, coalesce(lr, 0)::DOUBLE / (n * n) AS e FROM t LEFT JOIN e USING (a, b)) SELECT a, b, n, round(o, 8) AS agreement, round(CASE WHEN e < 1 THEN (o - e) / (1 - e) WHEN o = 1 THEN 1.0 END, 8) AS kappa FROM z")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Of every two annotators, without unclear answers."""
    return agreement.cohen_kappa(_ratings(spark, d).where("label <> 'Unclear'"))


@query(f"""WITH {_ANSWERS}, j AS (SELECT x.annotator AS a, y.annotator AS b, x.risk AS p, y.risk AS q, x.factors AS f, y.factors AS g, x.naturalness AS m, y.naturalness AS n FROM ans x JOIN ans y ON x.case_id = y.case_id AND x.annotator < y.annotator),
t AS (SELECT a, b, count(*) AS n_cases, count(*) FILTER (p <> 'Unclear' AND q <> 'Unclear') AS risk_n, avg((p = q)::INT) FILTER (p <> 'Unclear' AND q <> 'Unclear') AS risk_exact, count(*) FILTER (f IS NOT NULL AND g IS NOT NULL) AS factor_n, avg((f = g)::INT) FILTER (f IS NOT NULL AND g IS NOT NULL) AS factor_exact,
sum(len(list_intersect(f, g))) FILTER (f IS NOT NULL AND g IS NOT NULL) AS tp, sum(len(f) - len(list_intersect(f, g))) FILTER (f IS NOT NULL AND g IS NOT NULL) AS fp, sum(len(g) - len(list_intersect(f, g))) FILTER (f IS NOT NULL AND g IS NOT NULL) AS fn, avg(m) AS naturalness_a, avg(n) AS naturalness_b FROM j GROUP BY a, b)
SELECT a, b, n_cases, risk_n, round(risk_exact, 8) AS risk_exact, factor_n, round(factor_exact, 8) AS factor_exact, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp::DOUBLE / nullif(tp + fp, 0), 8) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 8) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 8) AS f1, round(naturalness_a, 8) AS naturalness_a, round(naturalness_b, 8) AS naturalness_b FROM t""")
def annotator_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Classes, factor sets and naturalness of every two annotators."""
    r = agreement.pairwise_sets(_answers(spark, d))
    rounded = ("risk_exact", "factor_exact", "precision", "recall", "f1", "naturalness_a", "naturalness_b")
    return r.select("a", "b", "n_cases", "risk_n", "factor_n", "tp", "fp", "fn", *[F.round(c, 8).alias(c) for c in rounded])


@query()
def annotator_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Phrase F1 of both directions of every two annotators."""
    return agreement.pairwise_evidence(_answers(spark, d)).select("a", "b", "evidence_n", F.round("evidence_f1", 8).alias("evidence_f1"))


@query(f"WITH {_RATE}, c AS (SELECT case_id, label, count(*) AS c FROM r GROUP BY ALL), i AS (SELECT case_id, sum(c) AS m, sum(c * (c - 1)) AS s FROM c GROUP BY case_id HAVING sum(c) >= 2), p AS (SELECT count(*) AS n_items, avg(s::DOUBLE / (m * (m - 1))) AS p, sum(m) AS total FROM i), l AS (SELECT label, sum(c) AS n FROM c SEMI JOIN i USING (case_id) GROUP BY label), e AS (SELECT sum((n::DOUBLE / total) ** 2) AS e FROM l, p) SELECT n_items, round((p - e) / (1 - e), 8) AS kappa FROM p, e")
def fleiss_kappa(spark: SparkSession, d: str) -> DataFrame:
    """M11."""
    return agreement.fleiss_kappa(_ratings(spark, d))


@query(f"WITH {_RATE}, c AS (SELECT case_id, label, count(*) AS c FROM r GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, label DESC) AS i FROM c) SELECT case_id, CAST(n AS BIGINT) AS n_ratings, c AS top_votes, CASE WHEN 2 * c > n THEN label ELSE 'Unclear' END AS risk FROM t WHERE i = 1")
def consensus_majority(spark: SparkSession, d: str) -> DataFrame:
    """M16, risk."""
    return agreement.majority(_ratings(spark, d))


@query("WITH l AS (SELECT DISTINCT case_id, annotator, unnest(factors) AS item FROM annotations WHERE status = 'complete') SELECT case_id, item, count(DISTINCT annotator) AS votes FROM l WHERE item IS NOT NULL GROUP BY case_id, item HAVING count(DISTINCT annotator) >= 2")
def consensus_factors(spark: SparkSession, d: str) -> DataFrame:
    """M16, factors."""
    a = table(spark, d, "annotations").where("status = 'complete'").select("case_id", "annotator", F.explode("factors").alias("item")).where("item is not null")
    return agreement.voted_items(a, "case_id", "item")


@query("SELECT case_id, quantile_cont(naturalness::DOUBLE, 0.5) AS naturalness, CAST(min(confidence) AS INTEGER) AS confidence FROM annotations WHERE status = 'complete' AND case_id IS NOT NULL GROUP BY case_id")
def consensus_scales(spark: SparkSession, d: str) -> DataFrame:
    """M16, scales."""
    return agreement.medians(table(spark, d, "annotations")).withColumn("confidence", F.col("confidence").cast("int"))


@query()
def audit_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Class, factors, tags, evidence of the annotator of the majority who agrees best, least confidence, median naturalness."""
    c = agreement.consensus(_answers(spark, d), CLASSES)
    joined = lambda x: F.array_join(x, "|").alias(x)
    return c.select("case_id", "n_answers", "risk", "evidence_from", joined("evidence"), joined("factors"), joined("issue_tags"), "confidence", "naturalness", "source")


_FIDELITY = f"j AS (SELECT ans.*, a.risk AS gr, list_sort(a.factors) AS gf FROM ans JOIN assigned a USING (case_id))"


@query(f"""WITH {_ANSWERS}, {SQL_ASSIGNED}, {_FIDELITY}, g AS (SELECT annotator, count(*) AS n_cases, count(*) FILTER (NOT coalesce(risk <> 'Unclear', false)) AS unclear_risk, count(*) FILTER (factors IS NULL) AS unclear_factors, avg((risk = gr)::INT) FILTER (risk <> 'Unclear') AS risk_accuracy, avg((factors = gf)::INT) AS factor_exact, CAST(coalesce(sum(len(list_intersect(factors, gf))), 0) AS BIGINT) AS tp,
CAST(coalesce(sum(len(factors) - len(list_intersect(factors, gf))), 0) AS BIGINT) AS fp, CAST(coalesce(sum(CASE WHEN factors IS NOT NULL THEN len(gf) - len(list_intersect(factors, gf)) END), 0) AS BIGINT) AS fn, avg(naturalness) AS naturalness, avg(confidence) AS confidence, count(*) FILTER (len(issue_tags) > 0) AS n_flagged FROM j GROUP BY annotator)
SELECT annotator, n_cases, unclear_risk, unclear_factors, tp, fp, fn, n_flagged, round(risk_accuracy, 8) AS risk_accuracy, round(factor_exact, 8) AS factor_exact, round(tp::DOUBLE / nullif(tp + fn, 0), 8) AS affirmed, round(fp::DOUBLE / n_cases, 8) AS extra, round(naturalness, 8) AS naturalness, round(confidence, 8) AS confidence FROM g""")
def annotator_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Each annotator against the assigned labels."""
    f = agreement.fidelity(_answers(spark, d), assigned(spark, d))
    rounded = ("risk_accuracy", "factor_exact", "affirmed", "extra", "naturalness", "confidence")
    return f.select("annotator", "n_cases", "unclear_risk", "unclear_factors", "tp", "fp", "fn", "n_flagged", *[F.round(c, 8).alias(c) for c in rounded])


@query(f"WITH {_ANSWERS}, {SQL_ASSIGNED}, {_FIDELITY}, f AS (SELECT unnest({sql_list(FACTORS)}) AS factor), s AS (SELECT f.factor, count(*) FILTER (list_contains(gf, f.factor)) AS assigned, count(*) FILTER (list_contains(gf, f.factor) AND list_contains(factors, f.factor)) AS affirmed, count(*) FILTER (NOT list_contains(gf, f.factor) AND list_contains(factors, f.factor)) AS extra FROM f, j WHERE factors IS NOT NULL GROUP BY f.factor) SELECT *, round(affirmed::DOUBLE / nullif(assigned, 0), 8) AS rate FROM s")
def factor_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """How often each assigned factor is found."""
    return agreement.factor_fidelity(_answers(spark, d), assigned(spark, d), FACTORS).withColumn("rate", F.round("rate", 8))


@query(f"WITH {_ANSWERS} SELECT tag, count(*) AS n FROM (SELECT unnest(issue_tags) AS tag FROM ans) GROUP BY tag")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Issue tags over the answers."""
    return _answers(spark, d).select(F.explode("issue_tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_ARM = f"arms AS (SELECT DISTINCT case_id, arm FROM drafts), m AS (SELECT case_id, label FROM (SELECT case_id, label, c, sum(c) OVER (PARTITION BY case_id) AS n, row_number() OVER (PARTITION BY case_id ORDER BY c DESC, label DESC) AS i FROM (SELECT case_id, label, count(*) AS c FROM r GROUP BY ALL)) WHERE i = 1 AND 2 * c > n), fi AS (SELECT arm, a.risk AS gr, m.label AS pr FROM m JOIN assigned a USING (case_id) JOIN arms USING (case_id))"


@query(f"WITH {DRAFTS}, {_RATE}, {SQL_ASSIGNED}, {_ARM} SELECT arm, count(*) AS n, round(avg((gr = pr)::INT), 8) AS risk_agreement, round(avg((list_position({sql_list(CLASSES)}, pr) > list_position({sql_list(CLASSES)}, gr))::INT), 8) AS read_higher, round(avg((list_position({sql_list(CLASSES)}, pr) < list_position({sql_list(CLASSES)}, gr))::INT), 8) AS read_lower FROM fi WHERE pr <> 'Unclear' GROUP BY arm")
def label_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """The majority's class against the assigned one, per arm."""
    at = lambda c: F.array_position(F.array(*map(F.lit, CLASSES)), F.col(c))
    j = _read_cases(spark, d)
    rate = lambda c, n: F.round(F.avg(c.cast("double")), 8).alias(n)
    return j.groupBy("arm").agg(F.count("*").alias("n"), rate(F.col("gr") == F.col("pr"), "risk_agreement"), rate(at("pr") > at("gr"), "read_higher"), rate(at("pr") < at("gr"), "read_lower"))


def _read_cases(spark: SparkSession, d: str) -> DataFrame:
    m = agreement.majority(_ratings(spark, d)).where("risk <> 'Unclear'").select("case_id", F.col("risk").alias("pr"))
    return m.join(assigned(spark, d).select("case_id", F.col("risk").alias("gr"), "target_factor"), "case_id").join(drafts(spark, d).select("case_id", "arm").distinct(), "case_id")


@query(f"WITH {DRAFTS}, {_RATE}, {SQL_ASSIGNED}, {_ARM}, c AS (SELECT arm, gr, pr, count(*) AS n FROM fi WHERE pr <> 'Unclear' AND gr <> pr GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY n DESC, gr, pr) AS i FROM c) SELECT arm, gr, pr, n FROM k WHERE i <= 8")
def fidelity_shifts(spark: SparkSession, d: str) -> DataFrame:
    """The eight most frequent changes of class per arm, a top-k report."""
    return agreement.shifts(_read_cases(spark, d), "gr", "pr", ["arm"])


@query(f"WITH {_ANSWERS}, {SQL_ASSIGNED}, {_FIDELITY}, v AS (SELECT case_id, unnest(factors) AS f FROM ans WHERE risk IS NOT NULL), n AS (SELECT case_id, count(*) AS n FROM ans WHERE risk IS NOT NULL GROUP BY case_id), k AS (SELECT v.case_id, f FROM v JOIN n USING (case_id) GROUP BY v.case_id, f, n HAVING count(*) >= 2 AND 2 * count(*) > n) SELECT target_factor, count(*) AS n, count(k.f) AS hits, round(avg((k.f IS NOT NULL)::INT), 8) AS recall FROM n JOIN assigned USING (case_id) LEFT JOIN k ON n.case_id = k.case_id AND k.f = target_factor GROUP BY target_factor")
def target_recall(spark: SparkSession, d: str) -> DataFrame:
    """Target factors that the consensus affirms."""
    c = agreement.consensus(_answers(spark, d), CLASSES).select("case_id", "factors")
    t = agreement.target_recall(c.join(assigned(spark, d).select("case_id", "target_factor"), "case_id"), "target_factor", "factors")
    return t.withColumn("recall", F.round("recall", 8))


@query(f"""WITH {_RATE}, n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY annotator) AS i, count(*) OVER (PARTITION BY case_id) AS m FROM r), t AS (SELECT case_id, max(label) FILTER (i = 1) AS x, max(label) FILTER (i = 2) AS y FROM n WHERE m = 2 GROUP BY case_id), l AS (SELECT DISTINCT label FROM r)
SELECT label, count(*) FILTER (x = label AND y = label) AS both, count(*) FILTER (x = label AND y <> label) AS a_only, count(*) FILTER (x <> label AND y = label) AS b_only, count(*) FILTER (x IS NOT NULL AND x <> label AND y <> label) AS neither FROM l LEFT JOIN t ON true GROUP BY label""")
def pair_match_table(spark: SparkSession, d: str) -> DataFrame:
    """Cases rated by two annotators."""
    return agreement.pair_match_table(_ratings(spark, d))


@query(f"WITH {DRAFTS} SELECT case_id FROM drafts WHERE draft = 0 AND case_id IS NOT NULL INTERSECT SELECT case_id FROM drafts WHERE draft = 1")
def common_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of which all drafts are there."""
    x = drafts(spark, d).where("case_id is not null")
    return x.where("draft = 0").select("case_id").intersect(x.where("draft = 1").select("case_id"))


@query(f"""WITH {DRAFTS}, {SQL_ASSIGNED}, u AS (SELECT draft_id, max(usage.input_tokens) AS i, max(usage.output_tokens) AS o FROM outputs GROUP BY draft_id), w AS (SELECT case_id, {sql_count("regexp_replace(user_text, '^.*\\n', '', 's')")} AS asked FROM prompts)
SELECT arm, status, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(i * 1 + o * 5) / 1e6, 8) AS usd, quantile_cont({sql_count('text')}::DOUBLE, 0.5) AS median_words, round(quantile_cont({sql_count('text')}::DOUBLE / asked, 0.5), 8) AS length_ratio FROM drafts JOIN u USING (draft_id) LEFT JOIN w USING (case_id) GROUP BY arm, status""")
def arm_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts, tokens, cost and lengths; rejects stand in arm_rejects, style in style_by_arm."""
    u = table(spark, d, "outputs", "draft_id", "usage").groupBy("draft_id").agg(F.max("usage.input_tokens").alias("i"), F.max("usage.output_tokens").alias("o"))
    w = table(spark, d, "prompts", "case_id", "user_text").select("case_id", ws_count(F.regexp_replace("user_text", r"(?s)^.*\n", "")).alias("asked"))
    j = drafts(spark, d).join(u, "draft_id").join(w, "case_id", "left").withColumn("w", ws_count(F.col("text")))
    return j.groupBy("arm", "status").agg(F.count("*").alias("n"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.round(F.sum(F.col("i") + 5 * F.col("o")) / 1e6, 8).alias("usd"), F.percentile("w", F.lit(0.5)).alias("median_words"), F.round(F.percentile(F.col("w") / F.col("asked"), F.lit(0.5)), 8).alias("length_ratio"))


@query("WITH p AS (SELECT user_text, row_number() OVER (ORDER BY case_id) - 1 AS i, count(*) OVER () AS n FROM prompts), s AS (SELECT avg(length(user_text) / 4.0::DOUBLE) AS mean_in FROM p WHERE i % greatest(1, n // 20) = 0), c AS (SELECT count(*) AS n FROM p) SELECT n AS n_prompts, round(mean_in, 6) AS mean_input, round(2 * n * (mean_in * 1 + 700 * 5) / 1e6, 6) AS worst_case_usd FROM s, c")
def cost_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """P25: the most that two drafts of every prompt can cost, from every n-th prompt: a sampling operator."""
    from quillspark.operators.ordering import numbered

    p = numbered(table(spark, d, "prompts", "case_id", "user_text"), ["case_id"], "i")
    n = p.count()
    s = p.where(F.col("i") % max(1, n // 20) == 0).agg(F.avg(F.length("user_text") / 4.0).alias("m"))
    return s.select(F.lit(n).cast("long").alias("n_prompts"), F.round("m", 6).alias("mean_input"), F.round(2 * n * (F.col("m") + 700 * 5) / 1e6, 6).alias("worst_case_usd"))


@query(f"WITH {SQL_ASSIGNED} SELECT target_factor, count(*) AS n, count(*) FILTER (risk = 'Attempt') AS n_attempt FROM assigned WHERE list_contains({sql_list(RARE)}, target_factor) GROUP BY target_factor")
def assigned_mix(spark: SparkSession, d: str) -> DataFrame:
    """Cases per target factor and their share of the highest class."""
    return assigned(spark, d).groupBy("target_factor").agg(F.count("*").alias("n"), F.count(F.when(F.col("risk") == CLASSES[-1], 1)).alias("n_attempt"))
