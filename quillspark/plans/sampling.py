"""Queries of seeded sampling, bootstrap, contrasts and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quillspark.config import BOOTSTRAPS, CLASSES, FACTORS, RARE
from quillspark.functions.text import f1, stable_number, stable_rank, ws_count
from quillspark.operators import checks, ordering, realism, resample
from quillspark.plans.base import DRAFTS, SQL_ASSIGNED, SQL_GOLD, assigned, drafts, gold, posts, scored, sql_count, sql_list, sql_mixed, sql_number, sql_posts, sql_scored
from quillspark.plans.catalog import query
from quillspark.sources.tables import table


@query("WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s|' || c_custkey)) AS pick FROM customer) SELECT c_custkey, c_mktsegment, CAST(pick AS INTEGER) AS pick FROM r WHERE pick <= 20")
def stable_rank_sample(spark: SparkSession, d: str) -> DataFrame:
    """20 of each stratum, a sampling operator."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    return resample.top_by_rank(c, ["c_mktsegment"], 20, F.lit("s"), F.col("c_custkey").cast("string"))


@query("WITH r AS (SELECT c_custkey, c_nationkey, sha256('b|stratum|' || c_nationkey) AS s, sha256('b|' || c_custkey) AS k FROM customer), i AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY k, c_custkey) AS round FROM r) SELECT c_custkey, c_nationkey, CAST(round AS INTEGER) AS round FROM i ORDER BY round, s, k LIMIT 60")
def balanced_pick(spark: SparkSession, d: str) -> DataFrame:
    """60 rows by turns, a sampling operator."""
    return resample.balanced_pick(table(spark, d, "customer", "c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 60, "b")


@query(f"WITH {SQL_GOLD}, c AS (SELECT risk, count(*) AS n FROM gold_u WHERE risk IS NOT NULL GROUP BY risk), t AS (SELECT *, sum(n) OVER () AS t FROM c), w AS (SELECT *, (48 * n) // t AS w, 48 * n - ((48 * n) // t) * t AS rest FROM t), p AS (SELECT *, row_number() OVER (ORDER BY rest DESC, risk) AS i, 48 - sum(w) OVER () AS left_over FROM w) SELECT risk, n, CAST(w + CASE WHEN i <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM p")
def quota_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    """Quotas."""
    c = gold(spark, d).where("risk is not null").groupBy("risk").agg(F.count("*").alias("n"))
    return resample.largest_remainder(c, "risk", "n", 48)


@query()
def audit_pick(spark: SparkSession, d: str) -> DataFrame:
    """The quota pick over all rows in stable order, a sampling operator."""
    g = gold(spark, d).where("risk is not null")
    quota = {r["risk"]: r["quota"] for r in resample.largest_remainder(g.groupBy("risk").agg(F.count("*").alias("n")), "risk", "n", 48).collect()}
    got = resample.quota_pick(resample.quota_rows(g, "row_id", "risk", RARE, 48, "audit"), "risk", RARE, quota, 4)
    return spark.createDataFrame([(r["row_id"], r["risk"]) for r in got], "row_id string, risk string")


@query(
    f"""WITH {SQL_ASSIGNED}, c AS (SELECT case_id, target_factor, risk, {sql_number('case_id', "'is'")} % 2 = 0 AS hit FROM assigned), t AS (SELECT *, row_number() OVER (PARTITION BY target_factor, risk ORDER BY sha256('sub|' || case_id), case_id) AS round FROM c WHERE hit), p AS (SELECT *, row_number() OVER (PARTITION BY target_factor ORDER BY round, sha256('sub|stratum|' || target_factor || '|' || risk)) AS i FROM t WHERE round <= 5),
o AS (SELECT *, target_factor || '/' || risk AS cell, row_number() OVER (PARTITION BY target_factor, risk ORDER BY sha256('sub|' || case_id), case_id) AS round FROM c WHERE NOT hit), r AS (SELECT case_id FROM o ORDER BY round, sha256('sub|stratum|' || cell), sha256('sub|' || case_id) LIMIT 12) SELECT case_id, 'target' AS part FROM p WHERE i <= 5 UNION ALL SELECT case_id, 'other' FROM r"""
)
def audit_subset(spark: SparkSession, d: str) -> DataFrame:
    """Five cases of each target factor balanced over classes and twelve others, a sampling operator."""
    c = assigned(spark, d).withColumn("hit", stable_number(F.col("case_id"), F.lit("is")) % 2 == 0)
    return resample.subset(c, "case_id", "target_factor", "hit", "risk", 5, 12, "sub")


def _packet(spark: SparkSession, d: str) -> DataFrame:
    o = ordering.numbered(drafts(spark, d), [stable_rank(F.lit("packet"), F.col("draft_id")), "draft_id"], "i")
    return o.withColumn("item", F.concat(F.lit("CA"), F.lpad((F.col("i") + 1).cast("string"), 7, "0")))


@query(f"WITH {DRAFTS}, o AS (SELECT draft_id, text, row_number() OVER (ORDER BY sha256('packet|' || draft_id)) AS i FROM drafts) SELECT 'CA' || lpad(CAST(i AS VARCHAR), 7, '0') AS item, text, sha256(text) AS text_hash FROM o")
def blinded_packet(spark: SparkSession, d: str) -> DataFrame:
    """Items in stable order under blind ids; nothing tells where they come from."""
    return _packet(spark, d).select("item", "text", F.sha2("text", 256).alias("text_hash"))


@query(f"WITH {DRAFTS}, {SQL_ASSIGNED}, o AS (SELECT draft_id, case_id, arm, row_number() OVER (ORDER BY sha256('packet|' || draft_id)) AS i FROM drafts) SELECT 'CA' || lpad(CAST(i AS VARCHAR), 7, '0') AS item, draft_id, arm, risk, target_factor FROM o LEFT JOIN assigned USING (case_id)")
def blinding_key(spark: SparkSession, d: str) -> DataFrame:
    """The key to the blind ids, kept apart."""
    return _packet(spark, d).join(assigned(spark, d).select("case_id", "risk", "target_factor"), "case_id", "left").select("item", "draft_id", "arm", "risk", "target_factor")


@query(f"WITH {SQL_GOLD}, a AS (SELECT row_id FROM gold_u WHERE len(list_intersect(factors, {sql_list(RARE)})) > 0), n AS (SELECT count(*) AS n FROM a), r AS (SELECT row_id, row_number() OVER (ORDER BY sha256('up|' || row_id), row_id) AS i, n FROM a, n) SELECT row_id, CAST(unnest(range(1, 1 + 3000 // n + CASE WHEN i <= 3000 % n THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM r")
def upsample_to_dose(spark: SparkSession, d: str) -> DataFrame:
    """Rare rows to 3000."""
    a = gold(spark, d).where(F.arrays_overlap("factors", F.array(*map(F.lit, RARE)))).select("row_id")
    return resample.upsample(a, "row_id", 3000, "up")


@query(f"WITH {SQL_GOLD} SELECT row_id, CASE WHEN len(list_intersect(factors, {sql_list(RARE)})) > 0 THEN 3.0::DOUBLE ELSE 1.0 END AS weight FROM gold_u")
def rare_reweight(spark: SparkSession, d: str) -> DataFrame:
    """T17."""
    return resample.reweight(gold(spark, d), "factors", RARE).select("row_id", "weight")


@query(f"WITH {SQL_GOLD}, e AS (SELECT row_id, epoch FROM gold_u, (SELECT unnest([0, 1]) AS epoch)) SELECT row_id, CAST(epoch AS INTEGER) AS epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY sha256('ep|' || epoch || '|' || row_id), row_id) - 1 AS INTEGER) AS position FROM e")
def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """T18."""
    return resample.epoch_order(gold(spark, d), "row_id", "ep", 2)


ARMS = {"base": "s1", "control": "s3", "treated": "s2"}


def _arm_stats(spark: SparkSession, d: str, seed: str) -> DataFrame:
    s = scored(spark, d, seed).join(posts(spark, d, "anon_user_id"), "row_id")
    return resample.sufficient(s, "anon_user_id", "risk", "pred", "factors", "pred_factors")


def _replicates(spark: SparkSession, d: str) -> DataFrame:
    """(b, arm, metric, value) of three sets of predictions over the same draws of users."""
    out = None
    for arm, seed in ARMS.items():
        r = resample.long_scores(resample.scores(resample.replicates(_arm_stats(spark, d, seed), "unit", resample.STATS)).withColumn("arm", F.lit(arm)), ["b", "arm"])
        out = r if out is None else out.unionByName(r)
    return out


_CUT = " + ".join(f"(u >= {c})::INT" for c in resample.CUTS)
_CELLS = [(f"c{i}{j}", f"count(*) FILTER (risk = '{a}' AND pred = '{b}')") for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)]
for _i, _f in enumerate(FACTORS):
    _g, _p = (f"list_contains({c}, '{_f}')" for c in ("factors", "pred_factors"))
    _CELLS += [(f"tp{_i}", f"count(*) FILTER ({_g} AND {_p})"), (f"fp{_i}", f"count(*) FILTER (NOT {_g} AND {_p})"), (f"fn{_i}", f"count(*) FILTER ({_g} AND NOT {_p})")]
_F = lambda tp, fp, fn: f"CASE WHEN 2 * ({tp}) + ({fp}) + ({fn}) > 0 THEN 2.0::DOUBLE * ({tp}) / (2 * ({tp}) + ({fp}) + ({fn})) ELSE 0 END"
_SUP = ["(" + " + ".join(f"c{i}{j}" for j in range(4)) + ")" for i in range(4)]
_CAL = ["(" + " + ".join(f"c{i}{j}" for i in range(4)) + ")" for j in range(4)]
_RISK = "(" + " + ".join(f"{_SUP[i]} * {_F(f'c{i}{i}', f'{_CAL[i]} - c{i}{i}', f'{_SUP[i]} - c{i}{i}')}" for i in range(4)) + f") / ({' + '.join(_SUP)})"
_MEAN = lambda names: "(" + " + ".join(_F(f"tp{i}", f"fp{i}", f"fn{i}") for i, f in enumerate(FACTORS) if f in names) + f") / {len(names)}"
_BOOT = f"""WITH {SQL_GOLD}, {sql_posts('anon_user_id')}, {', '.join(sql_scored(seed, f'sc_{arm}') for arm, seed in ARMS.items())}, alls AS ({' UNION ALL '.join(f"SELECT '{arm}' AS arm, row_id, risk, pred, factors, pred_factors FROM sc_{arm}" for arm in ARMS)}),
st AS (SELECT arm, anon_user_id AS unit, {', '.join(f'{x} AS {n}' for n, x in _CELLS)} FROM alls JOIN posts_u USING (row_id) WHERE anon_user_id IS NOT NULL GROUP BY ALL), us AS (SELECT unit, {sql_number("'boot'", 'unit')} AS base FROM (SELECT DISTINCT unit FROM st)),
bs AS (SELECT b, {sql_mixed(f'(b * {0x9E3779B1}) % 4294967296')} AS step FROM (SELECT unnest(range(0, {BOOTSTRAPS})) AS b)), dr AS (SELECT b, unit, {_CUT} AS m FROM (SELECT b, unit, {sql_mixed('(base + step) % 4294967296')} AS u FROM us, bs)),
rs AS (SELECT b, arm, {', '.join(f'sum(m * {n})::DOUBLE AS {n}' for n, _ in _CELLS)} FROM dr JOIN st USING (unit) WHERE m > 0 GROUP BY b, arm), sc AS (SELECT b, arm, {_RISK} AS risk_wf1, {_MEAN(FACTORS)} AS factors_macro_f1, {_MEAN(RARE)} AS rare_f1, {_MEAN([f for f in FACTORS if f not in RARE])} AS other_f1 FROM rs),
rp AS (SELECT b, arm, unnest(['risk_wf1', 'factors_macro_f1', 'rare_f1', 'other_f1', 'no_evidence']) AS metric, unnest([risk_wf1, factors_macro_f1, rare_f1, other_f1, (0.4::DOUBLE * risk_wf1 + 0.3::DOUBLE * factors_macro_f1) / 0.7::DOUBLE]) AS value FROM sc)"""
_SUMMARY = lambda v: f"count(*) AS n, round(avg({v}), 8) AS mean, round(quantile_cont({v}, 0.025), 8) AS low, round(quantile_cont({v}, 0.975), 8) AS high, round(avg(({v} > 0)::INT), 8) AS positive, round(least(1.0, 2 * least(avg(({v} <= 0)::INT), avg(({v} >= 0)::INT))), 8) AS p"
_ROUNDED = ("mean", "low", "high", "positive", "p")


@query(f"{_BOOT} SELECT arm, metric, {_SUMMARY('value')} FROM rp GROUP BY arm, metric")
def user_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """All figures over 2,000 draws of users, of three sets of predictions."""
    s = resample.summarize(_replicates(spark, d), "value", ["arm", "metric"])
    return s.select("arm", "metric", "n", *[F.round(c, 8).alias(c) for c in _ROUNDED])


@query(f"{_BOOT}, dl AS (SELECT t.b, t.metric, t.value - r.value AS delta FROM rp t JOIN rp r ON t.b = r.b AND t.metric = r.metric AND t.arm = 'treated' AND r.arm = 'base') SELECT metric, {_SUMMARY('delta')} FROM dl GROUP BY metric")
def paired_contrast(spark: SparkSession, d: str) -> DataFrame:
    """One set of predictions less another in every draw, which both share."""
    s = resample.summarize(resample.contrast(_replicates(spark, d), "arm", "treated", "base", "value", ["metric"]), "delta", ["metric"])
    return s.select("metric", "n", *[F.round(c, 8).alias(c) for c in _ROUNDED])


@query(f"{_BOOT}, m AS (SELECT arm, avg(value) AS v FROM rp WHERE metric = 'no_evidence' GROUP BY arm) SELECT t.arm, round(t.v - b.v, 8) AS delta_base, round(t.v - c.v, 8) AS delta_control, t.v - b.v >= 0.01 AND t.v - c.v > 0 AS adopt FROM m t, m b, m c WHERE t.arm = 'treated' AND b.arm = 'base' AND c.arm = 'control'")
def adoption_rule(spark: SparkSession, d: str) -> DataFrame:
    """Whether the gain over the base reaches the bar and there is any over the control."""
    a = resample.adoption(_replicates(spark, d).where("metric = 'no_evidence'"), "arm", ["treated"], "base", "control", "value")
    return a.select("arm", F.round("delta_base", 8).alias("delta_base"), F.round("delta_control", 8).alias("delta_control"), "adopt")


@query(f"{_BOOT}, dl AS (SELECT t.b, t.metric, t.value - r.value AS delta FROM rp t JOIN rp r ON t.b = r.b AND t.metric = r.metric AND t.arm = 'treated' AND r.arm = 'base'), ps AS (SELECT metric AS name, least(1.0, 2 * least(avg((delta <= 0)::INT), avg((delta >= 0)::INT))) AS p FROM dl GROUP BY metric), r AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 AS place, count(*) OVER () AS m FROM ps), k AS (SELECT *, 0.05 / (m - place) AS bound FROM r) SELECT name, round(p, 8) AS p, CAST(place AS INTEGER) AS place, round(bound, 8) AS bound, min((p <= bound)::INT) OVER (ORDER BY place) = 1 AS rejected FROM k")
def holm_stepdown(spark: SparkSession, d: str) -> DataFrame:
    """The contrasts' p values, stepped down."""
    s = resample.summarize(resample.contrast(_replicates(spark, d), "arm", "treated", "base", "value", ["metric"]), "delta", ["metric"])
    return resample.holm(s.select(F.col("metric").alias("name"), "p"), "name", "p").select("name", F.round("p", 8).alias("p"), "place", F.round("bound", 8).alias("bound"), "rejected")


@query(f"WITH {SQL_GOLD}, {sql_scored()}, o AS (SELECT risk, count(*) AS n FROM scored GROUP BY risk) SELECT coalesce(risk, 'none') AS name, n::DOUBLE AS got, n::DOUBLE AS want, true AS ok FROM o")
def reproduction_guard(spark: SparkSession, d: str) -> DataFrame:
    """Class counts of the scored rows against those of the gold table they must reproduce."""
    name = F.coalesce("risk", F.lit("none")).alias("name")
    count = lambda df: df.groupBy(name).agg(F.count("*").alias("n"))
    return checks.expect(count(scored(spark, d)), count(gold(spark, d)), "name", "n")


@query()
def pinned_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """T9 with one pinned generator over users as units."""
    s = scored(spark, d).join(posts(spark, d, "anon_user_id"), "row_id")
    u = s.groupBy(F.col("anon_user_id").alias("unit")).agg(F.count("*").alias("n"), F.sum(F.col("pred").eqNullSafe(F.col("risk")).cast("int")).alias("hit"))
    rep = resample.pinned_bootstrap(u, "unit", ["n", "hit"]).withColumn("acc", F.col("hit") / F.col("n"))
    return resample.summarize(rep, "acc").select("n", *[F.round(c, 8).alias(c) for c in ("mean", "low", "high")])


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity * 1 + l_extendedprice * 5) / 1e6, 4) AS usd FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def usage_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """P25, M23 over large tables."""
    j = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice").join(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") + F.col("l_extendedprice") * 5) / 1e6, 4).alias("usd"))


@query(
    f"""WITH {sql_posts('post_raw', 'split')}, {SQL_GOLD}, r AS (SELECT p.row_id, risk, {sql_count('post_raw')} AS w FROM posts_u p JOIN gold_u USING (row_id) WHERE risk IS NOT NULL), e AS (SELECT list_transform(range(1, 10), lambda i: i / 10.0) AS q), ed AS (SELECT unnest(quantile_cont(w, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM r)
SELECT row_id, CAST((SELECT count(*) FROM ed WHERE edge < w) AS INTEGER) AS decile FROM r"""
)
def length_deciles(spark: SparkSession, d: str) -> DataFrame:
    """G12."""
    r = posts(spark, d, "post_raw", "split").join(gold(spark, d).where("risk is not null").select("row_id", "risk"), "row_id").withColumn("w", ws_count(F.col("post_raw")))
    return r.select("row_id", realism.decile(F.col("w"), realism.decile_edges(r, "w")).alias("decile"))


@query(
    f"""WITH {DRAFTS}, {SQL_ASSIGNED}, {sql_posts('post_raw')}, {SQL_GOLD}, r AS (SELECT p.row_id, risk, {sql_count('post_raw')} AS w FROM posts_u p JOIN gold_u USING (row_id) WHERE risk IS NOT NULL), ed AS (SELECT unnest(quantile_cont(w, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM r),
rd AS (SELECT row_id, risk, CAST((SELECT count(*) FROM ed WHERE edge < w) AS INTEGER) AS rd FROM r), m AS (SELECT draft_id, a.risk, {sql_count('text')} AS w FROM drafts JOIN assigned a USING (case_id) WHERE text IS NOT NULL), md AS (SELECT draft_id AS row_id, risk, CAST((SELECT count(*) FROM ed WHERE edge < w) AS INTEGER) AS decile FROM m),
nr AS (SELECT x.risk, x.decile, y.rd, row_number() OVER (PARTITION BY x.risk, x.decile ORDER BY abs(x.decile - y.rd), y.rd) AS i FROM (SELECT DISTINCT risk, decile FROM md) x JOIN (SELECT DISTINCT risk, rd FROM rd) y ON x.risk = y.risk), s AS (SELECT md.*, nr.rd, row_number() OVER (PARTITION BY md.risk, nr.rd ORDER BY sha256('match|' || row_id), row_id) - 1 AS i FROM md JOIN nr ON md.risk = nr.risk AND md.decile = nr.decile AND nr.i = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY risk, rd ORDER BY sha256('match|' || row_id), row_id) - 1 AS k, count(*) OVER (PARTITION BY risk, rd) AS n FROM rd) SELECT s.row_id, s.decile, s.rd AS real_decile, k.row_id AS real_key FROM s JOIN k ON s.risk = k.risk AND s.rd = k.rd AND k.k = s.i % k.n"""
)
def length_decile_match(spark: SparkSession, d: str) -> DataFrame:
    """Drafts to real posts of their class and nearest decile, by turns."""
    real = posts(spark, d, "post_raw").join(gold(spark, d).where("risk is not null").select("row_id", "risk"), "row_id").withColumn("w", ws_count(F.col("post_raw")))
    edges = realism.decile_edges(real, "w")
    made = drafts(spark, d).where("text is not null").join(assigned(spark, d).select("case_id", "risk"), "case_id").select(F.col("draft_id").alias("row_id"), "risk", realism.decile(ws_count(F.col("text")), edges).alias("decile"))
    return realism.matched_reals(made, real.select("row_id", "risk", realism.decile(F.col("w"), edges).alias("decile")), "risk", "row_id", "match")


@query(f"WITH {SQL_GOLD}, {sql_scored()}, {sql_posts('anon_user_id')}, c AS (SELECT anon_user_id, count(*) FILTER (risk = 'Attempt' AND pred = 'Attempt') AS tp, count(*) FILTER (risk IS DISTINCT FROM 'Attempt' AND pred = 'Attempt') AS fp, count(*) FILTER (risk = 'Attempt' AND pred <> 'Attempt') AS fn FROM scored JOIN posts_u USING (row_id) GROUP BY 1) SELECT anon_user_id, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 8) AS f1 FROM c")
def user_statistics(spark: SparkSession, d: str) -> DataFrame:
    """M7, M8: sufficient statistics per user."""
    s = scored(spark, d).join(posts(spark, d, "anon_user_id"), "row_id")
    g, p = F.col("risk").eqNullSafe("Attempt"), F.col("pred").eqNullSafe("Attempt")
    c = s.groupBy("anon_user_id").agg(*[F.count(F.when(x, 1)).alias(n) for n, x in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p))])
    return c.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 8))
