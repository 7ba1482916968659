"""Queries of scoring, agreement, thresholds and pooling over gold labels and hash-made predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import CLASSES, FACTORS, RARE
from quillspark.functions.text import risk_ord, stable_number
from quillspark.operators import agreement, dedup, metrics, parse, realism, render, thresholds
from quillspark.plans.base import SQL_ASSIGNED, SQL_GOLD, SQL_WS, assigned, drafts, gold, posts, scored, sql_key, sql_list, sql_number, sql_posts, sql_scored, sql_trim
from quillspark.plans.catalog import query
from quillspark.sources.tables import table

_SCORED = f"WITH {SQL_GOLD}, {sql_scored()}"
_CLASS = f"""c AS (SELECT unnest({sql_list(CLASSES)}) AS label), cs AS (SELECT label, count(*) FILTER (risk = label) AS support, count(*) FILTER (risk = label AND pred = label) AS tp, count(*) FILTER (risk IS DISTINCT FROM label AND pred = label) AS fp, count(*) FILTER (risk = label AND pred <> label) AS fn FROM c, scored GROUP BY label),
cf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM cs)"""
_FACTOR = f"""fx AS (SELECT unnest({sql_list(FACTORS)}) AS factor), fs AS (SELECT factor, count(*) FILTER (list_contains(factors, factor)) AS support, count(*) FILTER (list_contains(factors, factor) AND list_contains(pred_factors, factor)) AS tp, count(*) FILTER (NOT list_contains(factors, factor) AND list_contains(pred_factors, factor)) AS fp, count(*) FILTER (list_contains(factors, factor) AND NOT list_contains(pred_factors, factor)) AS fn FROM fx, scored GROUP BY factor),
ff AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM fs)"""


@query(f"{_SCORED}, {_CLASS} SELECT label, support::DOUBLE AS support, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, round(f1, 8) AS f1 FROM cf")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """M1, M24."""
    return metrics.class_scores(scored(spark, d), "risk", "pred").withColumn("f1", F.round("f1", 8))


@query(f"{_SCORED}, {_CLASS} SELECT round(sum(support * f1) / sum(support), 8) AS risk_wf1 FROM cf")
def risk_weighted_f1(spark: SparkSession, d: str) -> DataFrame:
    """M1."""
    return metrics.weighted_f1(metrics.class_scores(scored(spark, d), "risk", "pred")).select(F.round("risk_wf1", 8).alias("risk_wf1"))


@query(f"{_SCORED}, {_FACTOR} SELECT factor, support::DOUBLE AS support, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END, 8) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 8) AS recall, round(f1, 8) AS f1 FROM ff")
def factor_scores(spark: SparkSession, d: str) -> DataFrame:
    """M2, M24, M25."""
    s = metrics.factor_scores(scored(spark, d), "factors", "pred_factors")
    return s.select("factor", "support", "tp", "fp", "fn", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_SCORED}, {_FACTOR} SELECT round(avg(f1), 8) AS factors_macro_f1, round(avg(f1) FILTER (list_contains({sql_list(RARE)}, factor)), 8) AS rare_f1, round(avg(f1) FILTER (NOT list_contains({sql_list(RARE)}, factor)), 8) AS other_f1 FROM ff")
def factor_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """M2, M7, M8."""
    r = F.col("factor").isin(RARE)
    return metrics.factor_scores(scored(spark, d), "factors", "pred_factors").agg(F.round(F.avg("f1"), 8).alias("factors_macro_f1"), F.round(F.avg(F.when(r, F.col("f1"))), 8).alias("rare_f1"), F.round(F.avg(F.when(~r, F.col("f1"))), 8).alias("other_f1"))


def _phrases(spark: SparkSession, d: str) -> DataFrame:
    """Predicted phrases: the first two gold spans by hash, and their first words."""
    n = stable_number(F.col("row_id"), F.lit("ph"))
    some = F.filter("spans", lambda s: F.pmod(F.length(s) + n, F.lit(3)) > 0)
    return scored(spark, d).withColumn("pred_spans", some)


# Predicted phrases are some of the gold ones, so that the best matching takes all of them.
_PHRASE = f"""ph AS (SELECT *, list_filter(spans, lambda s: (length(s) + {sql_number('row_id', chr(39) + 'ph' + chr(39))}) % 3 > 0) AS pred_spans FROM scored), pn AS (SELECT *, len(list_filter(spans, lambda s: {sql_trim('s')} <> '')) AS ng, len(list_filter(pred_spans, lambda s: {sql_trim('s')} <> '')) AS np FROM ph),
pf AS (SELECT *, CASE WHEN ng = 0 AND np = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * np / (ng + np) END AS phrase FROM pn)"""


@query(f"{_SCORED}, {_PHRASE} SELECT count(*) AS n, round(avg(phrase), 8) AS ee1, round(avg(phrase) FILTER (ng > 0), 8) AS skip FROM pf")
def phrase_f1_corpus(spark: SparkSession, d: str) -> DataFrame:
    """M3, M4, M6: over all records, by best matching."""
    p = metrics.phrase_f1(_phrases(spark, d), "spans", "pred_spans")
    return p.agg(F.count("*").alias("n"), F.round(F.avg("phrase_f1"), 8).alias("ee1"), F.round(F.avg(F.when(F.col("has_gold"), F.col("phrase_f1"))), 8).alias("skip"))


@query(f"{_SCORED}, {_PHRASE} SELECT row_id, round(phrase, 8) AS phrase_f1, ng > 0 AS has_gold FROM pf")
def phrase_f1_matching(spark: SparkSession, d: str) -> DataFrame:
    """M3: each record."""
    return metrics.phrase_f1(_phrases(spark, d), "spans", "pred_spans").select("row_id", F.round("phrase_f1", 8).alias("phrase_f1"), "has_gold")


@query(f"""{_SCORED}, {_PHRASE}, {_CLASS}, {_FACTOR}, x AS (SELECT (SELECT sum(support * f1) / sum(support) FROM cf) AS w, (SELECT avg(f1) FROM ff) AS m, (SELECT count(*) FROM pf) AS n, (SELECT avg(phrase) FROM pf) AS e, (SELECT avg(phrase) FILTER (ng > 0) FROM pf) AS k)
SELECT n, round(e, 8) AS phrase_f1_ee1, round(k, 8) AS phrase_f1_skip, round(w, 8) AS risk_wf1, round(m, 8) AS factors_macro_f1, round(0.4::DOUBLE * w + 0.3::DOUBLE * e + 0.3::DOUBLE * m, 8) AS score, round((0.4::DOUBLE * w + 0.3::DOUBLE * e) / 0.7::DOUBLE, 8) AS subtask1, round(m, 8) AS subtask2, round((0.4::DOUBLE * w + 0.3::DOUBLE * m) / 0.7::DOUBLE, 8) AS no_evidence FROM x""")
def composite_score(spark: SparkSession, d: str) -> DataFrame:
    """M5, M6, M9."""
    r = metrics.report(metrics.phrase_f1(_phrases(spark, d), "spans", "pred_spans"), "risk", "pred", "factors", "pred_factors", "phrase_f1", "has_gold")
    return r.select("n", *[F.round(c, 8).alias(c) for c in r.columns if c != "n"])


@query(f"WITH {SQL_GOLD}, g AS (SELECT len(list_filter(spans, lambda s: {sql_trim('s')} <> '')) AS ng FROM gold_u) SELECT 'identity' AS kind, 1.0::DOUBLE AS phrase_f1 UNION ALL SELECT 'empty', round(avg((ng = 0)::INT), 8) FROM g")
def scorer_smoke(spark: SparkSession, d: str) -> DataFrame:
    """Gold against itself scores 1, no phrases the share of records without gold ones."""
    g = gold(spark, d).withColumn("none", F.array().cast("array<string>"))
    one = lambda kind, c: metrics.phrase_f1(g, "spans", c).agg(F.lit(kind).alias("kind"), F.round(F.avg("phrase_f1"), 8).alias("phrase_f1"))
    return one("identity", "spans").union(one("empty", "none"))


@query(f"{_SCORED} SELECT risk AS gold, count(*) FILTER (pred = 'Indicator') AS n_indicator, count(*) FILTER (pred = 'Ideation') AS n_ideation, count(*) FILTER (pred = 'Behavior') AS n_behavior, count(*) FILTER (pred = 'Attempt') AS n_attempt FROM scored GROUP BY risk")
def confusion_profile(spark: SparkSession, d: str) -> DataFrame:
    """M24."""
    return metrics.confusion(scored(spark, d), "risk", "pred")


_PRED_ORD = f"list_position({sql_list(CLASSES)}, pred) - 1"


@query(f"{_SCORED} SELECT count(*) AS n, round(avg(({_PRED_ORD} = risk_ord)::INT), 8) AS agreement, round(avg(({_PRED_ORD} > risk_ord)::INT), 8) AS read_higher, round(avg(({_PRED_ORD} < risk_ord)::INT), 8) AS read_lower FROM scored WHERE risk_ord IS NOT NULL")
def risk_shift(spark: SparkSession, d: str) -> DataFrame:
    """M15."""
    s = metrics.shift(scored(spark, d).withColumn("po", risk_ord(F.col("pred"))), "risk_ord", "po")
    return s.select("n", *[F.round(c, 8).alias(c) for c in ("agreement", "read_higher", "read_lower")])


@query(f"""{_SCORED}, t AS (SELECT sum(len(list_intersect(factors, pred_factors))) AS tp, sum(len(pred_factors)) AS np, sum(len(factors)) AS ng, count(*) AS n FROM scored), r AS (SELECT count(*) FILTER ({_PRED_ORD} > risk_ord) AS above, count(*) FILTER ({_PRED_ORD} < risk_ord) AS below FROM scored)
SELECT round(ng::DOUBLE / n, 8) AS gold_per_row, round(np::DOUBLE / n, 8) AS pred_per_row, round(tp::DOUBLE / np, 8) AS micro_precision, round(tp::DOUBLE / ng, 8) AS micro_recall, above, below FROM t, r""")
def factor_behaviour(spark: SparkSession, d: str) -> DataFrame:
    """Density, micro precision and recall, calls above and below the annotated class."""
    s = scored(spark, d).withColumn("po", risk_ord(F.col("pred")))
    c = lambda x: F.count(F.when(x, 1))
    a = s.agg(F.sum(F.size(F.array_intersect("factors", "pred_factors"))).alias("tp"), F.sum(F.size("pred_factors")).alias("np"), F.sum(F.size("factors")).alias("ng"), F.count("*").alias("n"), c(F.col("po") > F.col("risk_ord")).alias("above"), c(F.col("po") < F.col("risk_ord")).alias("below"))
    r = lambda x, y, n: F.round(F.try_divide(F.col(x), F.col(y)), 8).alias(n)
    return a.select(r("ng", "n", "gold_per_row"), r("np", "n", "pred_per_row"), r("tp", "np", "micro_precision"), r("tp", "ng", "micro_recall"), "above", "below")


@query(f"{_SCORED} SELECT risk AS gold, pred, count(*) AS n FROM scored WHERE risk <> pred GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 8")
def frequent_mistakes(spark: SparkSession, d: str) -> DataFrame:
    """The eight most frequent mistakes, a top-k report."""
    return agreement.shifts(scored(spark, d).select(F.col("risk").alias("gold"), "pred"), "gold", "pred")


@query(f"{_SCORED}, x AS (SELECT row_id, risk, pred, unnest(list_intersect(factors, {sql_list(RARE)})) AS target, pred_factors FROM scored) SELECT target, count(*) AS n, count(*) FILTER (list_contains(pred_factors, target)) AS hits, round(avg(list_contains(pred_factors, target)::INT), 8) AS recall, round(avg((risk IS NOT DISTINCT FROM pred)::INT), 8) AS risk_agreement FROM x GROUP BY target")
def real_baseline(spark: SparkSession, d: str) -> DataFrame:
    """One row per post and rare factor it has, read by the labeller."""
    x = scored(spark, d).withColumn("target", F.explode(F.array_intersect("factors", F.array(*map(F.lit, RARE)))))
    t = agreement.target_recall(x, "target", "pred_factors")
    a = x.groupBy("target").agg(F.round(F.avg(F.col("risk").eqNullSafe(F.col("pred")).cast("double")), 8).alias("risk_agreement"))
    return t.join(a, "target").select("target", "n", "hits", F.round("recall", 8).alias("recall"), "risk_agreement")


@query(f"""{_SCORED}, x AS (SELECT fold, len(list_intersect(factors, pred_factors)) AS tp, len(list_filter(pred_factors, lambda f: NOT list_contains(factors, f))) AS fp, len(list_filter(factors, lambda f: NOT list_contains(pred_factors, f))) AS fn FROM scored), s AS (SELECT fold, count(*) AS n, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg((fp + fn = 0)::INT) AS exact FROM x GROUP BY fold)
SELECT fold, n, tp, fp, fn, round(exact, 8) AS exact, round(tp::DOUBLE / nullif(tp + fp, 0), 8) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 8) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 8) AS f1 FROM s""")
def set_micro_prf(spark: SparkSession, d: str) -> DataFrame:
    """M12, M14."""
    s = metrics.set_micro(scored(spark, d), "factors", "pred_factors", ["fold"])
    return s.select("fold", "n", "tp", "fp", "fn", *[F.round(c, 8).alias(c) for c in ("exact", "precision", "recall", "f1")])


def _score(factor: Column, f: str) -> Column:
    """A score per row and factor, higher where the factor is there."""
    n = stable_number(F.col("row_id"), F.lit(f), F.lit("p")) % 1000
    return F.when(factor, 300 + n).otherwise(n) / 1300.0


def _long_scores(spark: SparkSession, d: str) -> DataFrame:
    g = gold(spark, d).where("fold is not null")
    cells = [F.struct(F.lit(f).alias("factor"), F.array_contains("factors", f).alias("y"), _score(F.array_contains("factors", f), f).alias("p")) for f in FACTORS]
    return g.select("row_id", "fold", F.explode(F.array(*cells)).alias("x")).select("row_id", "fold", "x.*")


_LONG = f"WITH {SQL_GOLD}, sc AS (SELECT row_id, fold, factor, list_contains(factors, factor) AS y, (CASE WHEN list_contains(factors, factor) THEN 300 ELSE 0 END + {sql_number('row_id', 'factor', chr(39) + 'p' + chr(39))} % 1000) / 1300.0::DOUBLE AS p FROM gold_u, (SELECT unnest({sql_list(FACTORS)}) AS factor) WHERE fold IS NOT NULL)"
_TAU = """, ks AS (SELECT DISTINCT fold AS held_out FROM sc), d AS (SELECT held_out, factor, p AS s, count(*) FILTER (y) AS pos, count(*) AS n FROM ks JOIN sc ON fold <> held_out GROUP BY ALL),
w AS (SELECT *, sum(pos) OVER (PARTITION BY held_out, factor ORDER BY s DESC) AS tp, sum(n) OVER (PARTITION BY held_out, factor ORDER BY s DESC) AS k, sum(pos) OVER (PARTITION BY held_out, factor) AS total, lag(s) OVER (PARTITION BY held_out, factor ORDER BY s) AS low FROM d),
cand AS (SELECT held_out, factor, CASE WHEN low IS NULL THEN 0.0 ELSE (low + s) / 2 END AS tau, total, round(CASE WHEN k + total > 0 THEN 2.0::DOUBLE * tp / (k + total) ELSE 0 END, 12) AS f1 FROM w),
best AS (SELECT held_out, factor, tau, total, f1, row_number() OVER (PARTITION BY held_out, factor ORDER BY f1 DESC, tau DESC) AS i FROM cand),
tau AS (SELECT held_out, factor, CASE WHEN total = 0 THEN 0.5 ELSE tau END AS tau, CASE WHEN total = 0 THEN 0 ELSE f1 END AS f1 FROM best WHERE i = 1)"""


@query(f"{_LONG}{_TAU} SELECT held_out, factor, round(tau, 8) AS tau, round(f1, 8) AS f1 FROM tau")
def nested_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """T1, T2, W10."""
    t = thresholds.nested_cutoffs(_long_scores(spark, d), "fold", ["factor"], "p", "y")
    return t.select("held_out", "factor", F.round("tau", 8).alias("tau"), F.round("f1", 8).alias("f1"))


@query(f"{_LONG}{_TAU} SELECT sc.fold, sc.factor, count(*) FILTER (p >= tau) AS n_pred, count(*) FILTER (p >= tau AND y) AS tp FROM sc JOIN tau ON sc.fold = tau.held_out AND sc.factor = tau.factor GROUP BY sc.fold, sc.factor")
def threshold_apply(spark: SparkSession, d: str) -> DataFrame:
    """T2, T6."""
    s = _long_scores(spark, d)
    a = thresholds.apply_cutoffs(s, thresholds.nested_cutoffs(s, "fold", ["factor"], "p", "y"), "fold", ["factor"], "p")
    return a.groupBy("fold", "factor").agg(F.count(F.when(F.col("pred"), 1)).alias("n_pred"), F.count(F.when(F.col("pred") & F.col("y"), 1)).alias("tp"))


@query()
def bagged_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """T3."""
    return thresholds.bagged_cutoffs(_long_scores(spark, d), "fold", "factor", "p", "y", order=FACTORS)


@query(f"{_LONG}, d AS (SELECT factor, p, count(*) FILTER (y) AS a, count(*) FILTER (NOT y) AS b FROM sc GROUP BY factor, p), w AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY factor ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d) SELECT factor, CAST(sum(a) AS BIGINT) AS n_pos, CAST(sum(b) AS BIGINT) AS n_neg, round(sum(a * (below + b / 2.0::DOUBLE)) / (sum(a) * sum(b)), 8) AS auc FROM w GROUP BY factor")
def rank_auc(spark: SparkSession, d: str) -> DataFrame:
    """G14 in rank form."""
    return metrics.rank_auc(_long_scores(spark, d), "p", "y", ["factor"]).select("factor", "n_pos", "n_neg", F.round("auc", 8).alias("auc"))


@query(
    f"""WITH {SQL_GOLD}, {SQL_ASSIGNED}, {sql_scored('s1', 'a')}, {sql_scored('s2', 'b')}, fx AS (SELECT unnest({sql_list(FACTORS)}) AS factor), nr AS (SELECT count(*) AS nr FROM gold_u), ng AS (SELECT count(*) AS ng FROM assigned),
r AS (SELECT factor, (SELECT count(*) FROM gold_u WHERE list_contains(factors, factor)) AS r, (SELECT count(*) FROM assigned WHERE list_contains(factors, factor)) AS g FROM fx),
f1s AS (SELECT factor, 2.0::DOUBLE * count(*) FILTER (list_contains(factors, factor) AND list_contains(pred_factors, factor)) / nullif(count(*) FILTER (list_contains(factors, factor)) + count(*) FILTER (list_contains(pred_factors, factor)), 0) AS f, k FROM fx, (SELECT factors, pred_factors, 1 AS k FROM a UNION ALL SELECT factors, pred_factors, 2 FROM b) GROUP BY factor, k),
x AS (SELECT r.factor, ln(((r + g)::DOUBLE / (nr + ng)) / (r::DOUBLE / nr)) AS ratio, coalesce(f2.f, 0) - coalesce(f1.f, 0) AS delta FROM r, nr, ng, f1s f1, f1s f2 WHERE r.r > 0 AND f1.factor = r.factor AND f2.factor = r.factor AND f1.k = 1 AND f2.k = 2),
y AS (SELECT rank() OVER (ORDER BY round(ratio, 10)) + (count(*) OVER (PARTITION BY round(ratio, 10)) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY round(delta, 10)) + (count(*) OVER (PARTITION BY round(delta, 10)) - 1) / 2.0::DOUBLE AS ry FROM x) SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM y"""
)
def spearman_rho(spark: SparkSession, d: str) -> DataFrame:
    """How much written rows raise a factor's share (log ratio) against the change of its F1 between two runs.  Its p comes
    from metrics.spearman_p."""
    g, a = gold(spark, d), assigned(spark, d)
    count = lambda df, n: df.select(F.explode("factors").alias("factor")).groupBy("factor").agg(F.count("*").alias(n))
    nr, ng = g.count(), a.count()
    if not nr:
        return spark.createDataFrame([(0, None)], "n long, rho double")
    share = count(g, "r").join(count(a, "g"), "factor", "left").withColumn("ratio", F.round(F.log(((F.col("r") + F.coalesce("g", F.lit(0))) / (nr + ng)) / (F.col("r") / nr)), 10))
    f = lambda seed, n: metrics.factor_scores(scored(spark, d, seed), "factors", "pred_factors").select("factor", F.col("f1").alias(n))
    x = share.join(f("s1", "f1"), "factor").join(f("s2", "f2"), "factor").withColumn("delta", F.round(F.col("f2") - F.col("f1"), 10))
    return metrics.spearman(x, "ratio", "delta").select("n", F.round("rho", 8).alias("rho"))


_HOT = lambda x: f"list_transform(range(0, 4), lambda k: 0.75::DOUBLE * (k = list_position({sql_list(CLASSES)}, {x}) - 1)::INT + 0.25::DOUBLE * (k = list_position({sql_list(CLASSES)}, {x}) % 4)::INT)"


@query(f"""WITH {SQL_GOLD}, {sql_scored('s1', 'a')}, {sql_scored('s2', 'b')}, j AS (SELECT a.row_id, a.pred AS pa, list_transform(range(1, 5), lambda i: ({_HOT('a.pred')}[i] + {_HOT('b.pred')}[i]) / 2) AS p, CASE WHEN {sql_number('a.row_id', "'ha'")} % 2 = 0 THEN a.spans ELSE [] END AS sa, CASE WHEN {sql_number('a.row_id', "'hb'")} % 2 = 0 THEN a.spans ELSE [] END AS sb FROM a JOIN b USING (row_id)),
m AS (SELECT *, ({sql_list(CLASSES)})[list_position(p, list_max(p))] AS top, CASE WHEN len(sa) > 0 THEN sa ELSE sb END AS sp FROM j), f AS (SELECT row_id, p, CASE WHEN top <> 'Indicator' AND len(sp) = 0 THEN pa ELSE top END AS risk, sp FROM m) SELECT row_id, risk, CAST(CASE WHEN risk = 'Indicator' THEN 0 ELSE len(sp) END AS INTEGER) AS n_spans, round(list_max(p), 8) AS top_probability FROM f""")
def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two runs with class probabilities from the first token's alternatives."""
    named = F.array(*map(F.lit, CLASSES))
    second = F.element_at(named, (F.array_position(named, F.col("pred")) % 4 + 1).cast("int"))

    def run(seed: str, half: str) -> DataFrame:
        tokens = F.array(F.struct(F.concat(F.lit(' "'), F.substring("pred", 1, 3)).alias("tok"), F.log(F.lit(0.6)).alias("lp")), F.struct(second.alias("tok"), F.log(F.lit(0.2)).alias("lp")), F.struct(F.lit("I").alias("tok"), F.log(F.lit(0.1)).alias("lp")))
        keep = F.when(stable_number(F.col("row_id"), F.lit(half)) % 2 == 0, F.col("spans")).otherwise(F.array().cast("array<string>"))
        probs = F.transform(thresholds.class_probabilities(tokens, CLASSES, F.col("pred")), lambda p: F.round(p, 12))
        return scored(spark, d, seed).select("row_id", probs.alias("probs"), keep.alias("spans"), F.col("pred").alias("risk"))

    m = thresholds.merge_runs(run("s1", "ha"), run("s2", "hb"), "row_id", CLASSES)
    return m.select("row_id", "risk", F.size("spans").alias("n_spans"), F.round(F.array_max("probs"), 8).alias("top_probability"))


@query(f"""WITH {SQL_GOLD}, m AS (SELECT fold, step, avg(({sql_number('row_id', 'CAST(step AS VARCHAR)')} % 1000) / 1000.0::DOUBLE) AS v FROM gold_u, (SELECT unnest([20, 40, 60, 80]) AS step) WHERE fold IS NOT NULL GROUP BY fold, step), o AS (SELECT f.fold, m.step, round(avg(m.v), 10) AS mean_others FROM (SELECT DISTINCT fold FROM m) f JOIN m ON m.fold <> f.fold GROUP BY f.fold, m.step), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY mean_others DESC, step) AS i FROM o) SELECT fold, CAST(step AS INTEGER) AS step, round(mean_others, 8) AS mean_others FROM r WHERE i = 1""")
def nested_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """T8, X7."""
    g = gold(spark, d).where("fold is not null").withColumn("step", F.explode(F.array(*map(F.lit, (20, 40, 60, 80)))))
    m = g.withColumn("v", (stable_number(F.col("row_id"), F.col("step").cast("string")) % 1000) / 1000.0)
    return thresholds.nested_checkpoint(m, "fold", "step", "v").select("fold", "step", F.round("mean_others", 8).alias("mean_others"))


@query(f"""WITH {sql_posts('post_raw', 'split')}, k AS (SELECT row_id, min(row_id) OVER (PARTITION BY {sql_key('post_raw')}) AS cluster FROM posts_u), {SQL_GOLD}, p AS (SELECT k.*, CASE WHEN {sql_number('k.row_id', "'has'")} % 2 = 0 THEN risk END AS own FROM k LEFT JOIN gold_u g ON k.row_id = g.row_id), r AS (SELECT *, first_value(own) OVER (PARTITION BY cluster ORDER BY (own IS NULL), row_id) AS rep FROM p)
SELECT row_id, cluster, coalesce(own, rep) AS pred, CASE WHEN own IS NOT NULL THEN 'own' WHEN rep IS NOT NULL THEN 'representative' ELSE 'default' END AS source FROM r""")
def propagate_to_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """J2, T7, D10."""
    c = dedup.clusters(posts(spark, d, "post_raw", "split"), "row_id", "post_raw").select("row_id", "cluster")
    preds = gold(spark, d).where((stable_number(F.col("row_id"), F.lit("has")) % 2 == 0) & F.col("risk").isNotNull()).select("row_id", F.col("risk").alias("pred"))
    return dedup.propagate(preds, c, "row_id", "cluster")


@query()
def realigned_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Spans of representatives carried over to their duplicates and aligned on their texts."""
    c = dedup.clusters(posts(spark, d, "post_raw"), "row_id", "post_raw")
    preds = gold(spark, d).where(stable_number(F.col("row_id"), F.lit("has")) % 2 == 0).select("row_id", "spans")
    return dedup.propagate_spans(preds, c, "row_id", "cluster", "post_raw").select("row_id", F.array_join("spans", "|").alias("spans"), "source")



@query(f"{_SCORED} SELECT risk, count(*) AS n, round(avg(len(factors)), 8) AS factors_per_row, round(avg(len(spans)), 8) AS spans_per_row, round(avg(len(pred_factors)), 8) AS predicted_per_row, round(avg(weight), 8) AS mean_weight FROM scored GROUP BY risk")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    """M21, M22, M25, M29."""
    a = lambda c, n: F.round(F.avg(c), 8).alias(n)
    return scored(spark, d).groupBy("risk").agg(F.count("*").alias("n"), a(F.size("factors"), "factors_per_row"), a(F.size("spans"), "spans_per_row"), a(F.size("pred_factors"), "predicted_per_row"), a("weight", "mean_weight"))


@query(f"{_SCORED} SELECT fold, round(sum(weight * (pred IS DISTINCT FROM risk)::INT) / (count(*) * avg(weight)), 8) AS loss FROM scored GROUP BY fold")
def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """M30."""
    wrong = (~F.col("pred").eqNullSafe(F.col("risk"))).cast("int")
    return scored(spark, d).groupBy("fold").agg(F.round(F.sum(F.col("weight") * wrong) / (F.count("*") * F.avg("weight")), 8).alias("loss"))


@query()
def realism_auc(spark: SparkSession, d: str) -> DataFrame:
    """Drafts against real posts of their class and length, grouped by case or author, weights fitted without the fold."""
    made = drafts(spark, d).where("text is not null").join(assigned(spark, d).select("case_id", "risk"), "case_id").select(F.col("draft_id").alias("row_id"), "text", F.col("case_id").alias("grp"), "risk")
    real = posts(spark, d, "post_raw", "anon_user_id").join(gold(spark, d).where("risk is not null").select("row_id", "risk"), "row_id").select("row_id", F.col("post_raw").alias("text"), F.col("anon_user_id").alias("grp"), "risk")
    return realism.realism_auc(made, real).select("fold", "n_pos", "n_neg", F.round("auc", 4).alias("auc"))


_STEPS = f"""WITH {SQL_GOLD}, m AS (SELECT fold, step, round(avg(({sql_number('row_id', 'CAST(step AS VARCHAR)')} % 1000) / 1000.0::DOUBLE), 10) AS v FROM gold_u, (SELECT unnest([20, 40, 60, 80]) AS step) WHERE fold IS NOT NULL GROUP BY fold, step), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY v DESC, step) AS i FROM m)"""


@query(f"{_STEPS} SELECT fold, CAST(step AS INTEGER) AS step, round(v, 8) AS value FROM r WHERE i = 1")
def selected_steps(spark: SparkSession, d: str) -> DataFrame:
    """The step with the best figure of each fold, the first of equals."""
    g = gold(spark, d).where("fold is not null").withColumn("step", F.explode(F.array(*map(F.lit, (20, 40, 60, 80)))))
    m = g.withColumn("v", (stable_number(F.col("row_id"), F.col("step").cast("string")) % 1000) / 1000.0)
    return thresholds.selected_steps(m, "fold", "step", "v").select("fold", "step", F.round("value", 8).alias("value"))


def _generations(spark: SparkSession, d: str) -> DataFrame:
    """Rendered targets as generations: tokens are words, capitals and what is between, each its own only alternative."""
    g = gold(spark, d).where("risk is not null")
    t = g.select("row_id", render.target_map(F.col("risk"), F.col("spans"), F.col("factors")).alias("text"))
    return t.withColumn("tokens", F.regexp_extract_all("text", F.lit("(true|false|[A-Z]|[a-z]+|[^A-Za-z]+)"), 1)).withColumn("logs", F.transform("tokens", lambda x: F.array(F.struct(x.alias("tok"), F.lit(0.0).alias("lp")))))


@query(f"WITH {SQL_GOLD} SELECT row_id, f.factor, list_contains(factors, f.factor)::INT::DOUBLE AS p FROM gold_u, (SELECT unnest({sql_list(FACTORS)}) AS factor) f WHERE risk IS NOT NULL")
def factor_probes(spark: SparkSession, d: str) -> DataFrame:
    """Factor probabilities at the steps of their values."""
    return parse.probed(_generations(spark, d), "text", "tokens", "logs").select("row_id", F.explode("p_true").alias("factor", "p"))


@query(f"WITH {SQL_GOLD} SELECT row_id, risk || '\"}}' AS first_steps FROM gold_u WHERE risk IS NOT NULL")
def risk_probes(spark: SparkSession, d: str) -> DataFrame:
    """The most likely tokens of the first three steps of the class."""
    r = parse.risk_probed(_generations(spark, d), "text", "tokens", "logs")
    return r.select("row_id", F.array_join(F.transform("risk_logprobs", lambda s: F.element_at(s, 1)["tok"]), "").alias("first_steps"))
