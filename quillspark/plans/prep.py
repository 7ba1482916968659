"""Queries of preparation: cleaning, duplicates, timelines, spans, screening, rendering and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import CLASSES, FACTORS
from quillspark.functions import text as T
from quillspark.operators import checks, dedup, realism, render, screen, spans, timeline
from quillspark.operators import parse as parsing
from quillspark.plans.base import DRAFTS, SQL_ASSIGNED, SQL_GOLD, SQL_SHOWN, SQL_WS, assigned, drafts, gold, posts, real_rows, sql_collapse, sql_count, sql_key, sql_list, sql_norm, sql_number, sql_posts, sql_scorer, sql_trim
from quillspark.plans.catalog import query
from quillspark.sources.staging import stage
from quillspark.sources.tables import table

# Patterns of the screens are configuration of a project; these fit the test data.
REFUSAL = "(?i)(can't|cannot|won't be able to|unable to|decline|rather not) (write|comply|draft|this|produce)"
DISCLAIMER = "(?i)(no|not|don't|never|without)[^.?!]{0,30}(plan|date|note)"
DISCLAIMED = "Ideation"


@query(f"WITH {sql_posts('post_raw')}, g AS (SELECT post_raw, count(*) AS n, min(row_id) AS f FROM posts_u GROUP BY post_raw) SELECT row_id, n AS group_size, f AS first_key, 1.0::DOUBLE / n AS train_weight FROM posts_u JOIN g ON posts_u.post_raw IS NOT DISTINCT FROM g.post_raw")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """D1, D6, D7."""
    return dedup.exact_groups(posts(spark, d, "post_raw"), "row_id", "post_raw")


@query(f"WITH {sql_posts('post_raw')}, g AS (SELECT row_id, min(row_id) OVER w AS first_key, row_number() OVER (PARTITION BY post_raw ORDER BY row_id) - 1 AS place, count(*) OVER w AS size FROM posts_u WINDOW w AS (PARTITION BY post_raw)) SELECT row_id, first_key, CAST(place AS INTEGER) AS place, size FROM g WHERE size > 1")
def identical_groups(spark: SparkSession, d: str) -> DataFrame:
    """The members of each group, a row each."""
    return dedup.identical_groups(posts(spark, d, "post_raw"), "row_id", "post_raw")


@query(f"""WITH {sql_posts('post_raw', 'split')}, t AS (SELECT count(DISTINCT post_raw) + count(DISTINCT CASE WHEN post_raw IS NULL THEN 1 END) AS n FROM posts_u WHERE split = 'train'), g AS (SELECT row_id, min(row_id) OVER (PARTITION BY post_raw) AS f FROM posts_u WHERE split = 'leaderboard')
SELECT row_id, n + dense_rank() OVER (ORDER BY f) - 1 AS dup_group_id, row_id = f AS is_representative, CAST(-1 AS INTEGER) AS cv_component, CAST(-1 AS INTEGER) AS fold FROM g, t""")
def leaderboard_groups(spark: SparkSession, d: str) -> DataFrame:
    """Exact groups of the leaderboard, numbered behind those of the train split."""
    p = posts(spark, d, "post_raw", "split")
    top = dedup.exact_groups(p.where("split = 'train'"), "row_id", "post_raw").agg((F.count_distinct("first_key") - 1).alias("top"))
    return dedup.second_side(p.where("split = 'leaderboard'"), "row_id", "post_raw", top)


_PIN = sql_number("row_id", "'pin'")


@query(
    f"""WITH RECURSIVE {sql_posts('post_raw')}, k AS (SELECT row_id, 'c:' || min(row_id) OVER (PARTITION BY {sql_key('post_raw')}) AS c, CASE WHEN {_PIN} % 100 = 0 THEN 's:' || CAST(({_PIN} // 100) % 7 AS VARCHAR) END AS s FROM posts_u),
e AS (SELECT DISTINCT s AS a, c AS b FROM k WHERE s IS NOT NULL UNION SELECT DISTINCT c, s FROM k WHERE s IS NOT NULL), l(node, label) AS (SELECT DISTINCT a, min(b) OVER (PARTITION BY a) FROM e UNION SELECT e.b, l.label FROM l JOIN e ON l.node = e.a WHERE l.label < e.b),
m AS (SELECT node, min(label) AS label FROM (SELECT node, label FROM l UNION ALL SELECT a, a FROM e) GROUP BY node) SELECT k.row_id, substring(coalesce(m.label, k.c), 3) AS cluster FROM k LEFT JOIN m ON k.c = m.node"""
)
def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate clusters with pinned sets of rows that belong together; the sets come from a hash of the row."""
    p = posts(spark, d, "post_raw")
    n = T.stable_number(F.col("row_id"), F.lit("pin"))
    pins = p.where(n % 100 == 0).select(F.floor(n / 100 % 7).cast("string").alias("merge_set"), "row_id")
    return dedup.clusters(p, "row_id", "post_raw", pins).select("row_id", "cluster")


@query(
    f"""WITH {sql_posts('post_raw', 'split')}, {SQL_GOLD}, k AS (SELECT p.row_id, {sql_key('post_raw')} AS k, risk_ord FROM posts_u p LEFT JOIN gold_u g ON p.row_id = g.row_id WHERE split = 'train'),
c AS (SELECT *, min(row_id) OVER (PARTITION BY k) AS cluster FROM k), v AS (SELECT cluster, risk_ord, count(*) AS n, min(row_id) AS f FROM c GROUP BY cluster, risk_ord),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY (risk_ord IS NULL), n DESC, risk_ord DESC) AS i, sum(n) OVER (PARTITION BY cluster) AS size, count(risk_ord) OVER (PARTITION BY cluster) AS labels FROM v)
SELECT cluster, CAST(size AS BIGINT) AS size, risk_ord AS label_ord, CASE WHEN risk_ord IS NULL THEN cluster ELSE f END AS representative, labels > 1 AS is_label_conflict FROM r WHERE i = 1"""
)
def near_dup_representatives(spark: SparkSession, d: str) -> DataFrame:
    """P11, D2, D5, D10."""
    p = posts(spark, d, "post_raw", "split").where("split = 'train'").join(gold(spark, d).select("row_id", "risk_ord"), "row_id", "left")
    return dedup.resolve_conflicts(dedup.clusters(p, "row_id", "post_raw"), "row_id", "cluster", "risk_ord")


@query(
    f"""WITH RECURSIVE {sql_posts('post_raw', 'anon_user_id')}, k AS (SELECT row_id, 'u:' || anon_user_id AS u, 'c:' || min(row_id) OVER (PARTITION BY {sql_key('post_raw')}) AS c FROM posts_u),
e AS (SELECT DISTINCT u AS a, c AS b FROM k UNION SELECT DISTINCT c, u FROM k), l(node, label) AS (SELECT DISTINCT a, min(b) OVER (PARTITION BY a) FROM e UNION SELECT e.b, l.label FROM l JOIN e ON l.node = e.a WHERE l.label < e.b),
m AS (SELECT node, min(label) AS label FROM (SELECT node, label FROM l UNION ALL SELECT a, a FROM e) GROUP BY node) SELECT k.row_id, m.label AS component FROM k JOIN m ON k.c = m.node"""
)
def cv_components(spark: SparkSession, d: str) -> DataFrame:
    """D3."""
    c = dedup.clusters(posts(spark, d, "post_raw", "anon_user_id"), "row_id", "post_raw")
    return dedup.author_components(c, "row_id", "anon_user_id", "cluster")


@query(f"WITH {sql_posts('anon_user_id')}, u AS (SELECT anon_user_id, min(row_id) AS f FROM posts_u GROUP BY anon_user_id), i AS (SELECT anon_user_id, dense_rank() OVER (ORDER BY f) - 1 AS dense_id FROM u) SELECT row_id, CAST(dense_id AS BIGINT) AS dense_id FROM posts_u JOIN i USING (anon_user_id)")
def dense_group_ids(spark: SparkSession, d: str) -> DataFrame:
    """D4."""
    return dedup.dense_ids(posts(spark, d, "anon_user_id"), "row_id", "anon_user_id").select("row_id", "dense_id")


@query()
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    """Components of authors and near-duplicate clusters as groups."""
    p = posts(spark, d, "post_raw", "anon_user_id", "split").where("split = 'train' and row_id is not null")
    clustered = stage(dedup.clusters(p, "row_id", "post_raw").select("row_id", "anon_user_id", "cluster"), "clusters")
    c = dedup.author_components(clustered, "row_id", "anon_user_id", "cluster")
    c = stage(c.join(gold(spark, d).select("row_id", "risk_ord"), "row_id", "left"), "components")
    return c.join(dedup.component_folds(c, "component", "risk_ord"), "component").select("row_id", "component", "fold")


@query(f"WITH {sql_posts('fold', 'anon_user_id', 'split')}, {SQL_GOLD} SELECT CAST(p.fold AS INTEGER) AS fold, count(*) AS n_posts, count(DISTINCT anon_user_id) AS n_users, count(*) FILTER (risk_ord = 0) AS n0, count(*) FILTER (risk_ord = 1) AS n1, count(*) FILTER (risk_ord = 2) AS n2, count(*) FILTER (risk_ord = 3) AS n3 FROM posts_u p LEFT JOIN gold_u g ON p.row_id = g.row_id WHERE split = 'train' GROUP BY p.fold")
def fold_balance(spark: SparkSession, d: str) -> DataFrame:
    """V8, M21."""
    p = posts(spark, d, "fold", "anon_user_id", "split").where("split = 'train'").withColumn("fold", F.col("fold").cast("int")).join(gold(spark, d).select("row_id", "risk_ord"), "row_id", "left")
    return p.groupBy("fold").agg(F.count("*").alias("n_posts"), F.count_distinct("anon_user_id").alias("n_users"), *[F.count(F.when(F.col("risk_ord") == i, 1)).alias(f"n{i}") for i in range(4)])


@query(f"WITH {sql_posts('fold', 'anon_user_id', 'split')} SELECT anon_user_id, count(DISTINCT fold) AS n_folds FROM posts_u WHERE split = 'train' AND fold IS NOT NULL GROUP BY anon_user_id HAVING count(DISTINCT fold) > 1")
def leakage_violations(spark: SparkSession, d: str) -> DataFrame:
    """Authors in several stored folds."""
    return checks.split_components(posts(spark, d, "fold", "anon_user_id", "split").where("split = 'train'"), "anon_user_id", "fold")


_EXEMPLAR = sql_number("row_id", "CAST(held_out AS VARCHAR)")


@query(f"WITH e AS (SELECT DISTINCT row_id, held_out FROM spans, (SELECT unnest([0, 1, 2, 3, 4]) AS held_out) WHERE {_EXEMPLAR} % 20 = 0) SELECT DISTINCT e.row_id, CAST(held_out AS INTEGER) AS held_out FROM e JOIN gold g ON e.row_id = g.row_id WHERE g.fold = held_out")
def fold_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Exemplars of the five training files, chosen by a hash, that lie in the fold the file holds out."""
    e = table(spark, d, "spans", "row_id").distinct().withColumn("held_out", F.explode(F.array(*map(F.lit, range(5))))).where(T.stable_number(F.col("row_id"), F.col("held_out").cast("string")) % 20 == 0)
    return checks.leaked(e, table(spark, d, "gold", "row_id", "fold"), "row_id", "held_out", "fold")


@query(f"WITH {SQL_GOLD}, f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold), n AS (SELECT fold, count(*) AS n FROM gold_u WHERE risk = 'Attempt' GROUP BY fold) SELECT CAST(f.fold AS INTEGER) AS fold, coalesce(n, 0) AS n FROM f LEFT JOIN n ON f.fold = n.fold WHERE coalesce(n, 0) < 40")
def thin_folds(spark: SparkSession, d: str) -> DataFrame:
    """Stored folds with fewer than 40 rows of the rarest class."""
    return checks.thin_folds(gold(spark, d), "fold", "risk", CLASSES[-1], 40)


@query(f"WITH {SQL_GOLD}, x AS (SELECT DISTINCT fold, unnest(factors) AS item FROM gold_u), e AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold, i.item FROM (SELECT unnest({sql_list(FACTORS)}) AS item) i) SELECT e.item, CAST(e.fold AS INTEGER) AS fold FROM e ANTI JOIN x ON e.fold = x.fold AND e.item = x.item")
def absent_factors(spark: SparkSession, d: str) -> DataFrame:
    """V8: factors that no row of a fold has."""
    return checks.absent_items(gold(spark, d), "fold", "factors", FACTORS)


@query(f"WITH {sql_posts('post_raw', 'split')}, c AS (SELECT DISTINCT split, row_id, unnest(regexp_extract_all(post_raw, '[^\\x00-\\x7f]')) AS character FROM posts_u) SELECT character, count(*) AS n FROM c WHERE split = 'leaderboard' AND character NOT IN (SELECT character FROM c WHERE split = 'train') GROUP BY character")
def novel_characters(spark: SparkSession, d: str) -> DataFrame:
    """V8: characters beyond ASCII of the leaderboard that no train post has."""
    p = posts(spark, d, "post_raw", "split")
    return checks.novel_characters(p.where("split = 'leaderboard'"), p.where("split = 'train'"), "post_raw")


@query(f"WITH {SQL_GOLD}, x AS (SELECT row_id, unnest(spans) AS s FROM gold_u), r AS (SELECT row_id, CASE WHEN regexp_matches(s, '[;\\n]') THEN 'separator' WHEN {sql_count('s')} > 7 THEN 'long' END AS reason FROM x) SELECT DISTINCT row_id, reason FROM r WHERE reason IS NOT NULL")
def span_constraints(spark: SparkSession, d: str) -> DataFrame:
    """V2: spans with a separator or a line break, or longer than 7 tokens."""
    return checks.span_constraints(gold(spark, d), "row_id", "spans", 7)


@query(
    f"""WITH {sql_posts('post_raw', 'split')}, {SQL_GOLD}, c AS (SELECT p.row_id, min(p.row_id) OVER (PARTITION BY {sql_key('post_raw')}) AS cluster, risk, risk_ord FROM posts_u p LEFT JOIN gold_u g ON p.row_id = g.row_id WHERE split = 'train'),
v AS (SELECT cluster, risk, risk_ord, count(*) AS n FROM c WHERE risk IS NOT NULL GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, risk_ord DESC) AS i, count(*) OVER (PARTITION BY cluster) > 1 AS flagged FROM v)
SELECT c.row_id, flagged FROM c JOIN b ON c.cluster = b.cluster AND i = 1 WHERE c.risk IS DISTINCT FROM b.risk"""
)
def label_overrides(spark: SparkSession, d: str) -> DataFrame:
    """V3: rows whose label the majority of their cluster overrides, and whether the conflict is flagged."""
    p = posts(spark, d, "post_raw", "split").where("split = 'train'").join(gold(spark, d).select("row_id", "risk", "risk_ord"), "row_id", "left")
    c = dedup.clusters(p, "row_id", "post_raw").select("row_id", "cluster", "risk", "risk_ord")
    won = dedup.resolve_conflicts(c, "row_id", "cluster", "risk_ord").where("label_ord is not null").select("cluster", F.element_at(F.array(*map(F.lit, CLASSES)), F.col("label_ord") + 1).alias("won"), "is_label_conflict")
    return checks.overrides(c.join(won, "cluster"), "row_id", "risk", "won", "is_label_conflict")


@query(f"WITH {sql_posts('post_raw', 'anon_user_id')} SELECT row_id, CAST(length(post_raw) AS INTEGER) AS n_chars, {sql_count('post_raw')} AS n_ws_tokens, count(*) OVER (PARTITION BY anon_user_id) AS user_n_posts, sha256({sql_norm('post_raw')}) AS norm_hash, sha256({sql_scorer('post_raw')}) AS scorer_hash FROM posts_u")
def text_profile(spark: SparkSession, d: str) -> DataFrame:
    """P6, P7, P9, IO8.  The posts of a user are counted apart and joined, so that no user is one task."""
    t, p = F.col("post_raw"), posts(spark, d, "post_raw", "anon_user_id")
    n = posts(spark, d, "anon_user_id").groupBy(F.col("anon_user_id").alias("_u")).agg(F.count("*").alias("user_n_posts"))
    own = p.select("row_id", "anon_user_id", F.length(t).alias("n_chars"), T.ws_count(t).alias("n_ws_tokens"), F.sha2(T.normalized(t), 256).alias("norm_hash"), F.sha2(T.scorer_norm(t), 256).alias("scorer_hash"))
    return own.join(n, F.col("anon_user_id").eqNullSafe(F.col("_u"))).drop("anon_user_id", "_u")


@query(f"""SELECT arm, count(*) AS n, round(avg(regexp_matches(text, '[A-Z]')::INT), 4) AS upper, round(avg(regexp_matches(text, '(?:^|[^A-Za-z0-9_])i(?:$|[^A-Za-z0-9_])')::INT), 4) AS lone_i, round(avg(regexp_matches(text, '[\\x{{1F300}}-\\x{{1FAFF}}]')::INT), 4) AS emoji, round(avg(regexp_matches(text, ',')::INT), 4) AS comma, round(avg(regexp_matches(text, '\\?')::INT), 4) AS question, round(avg({sql_count('text')}), 2) AS mean_words FROM outputs WHERE text IS NOT NULL GROUP BY arm""")
def style_by_arm(spark: SparkSession, d: str) -> DataFrame:
    """M17, M19."""
    return realism.style(table(spark, d, "outputs", "arm", "text"), "text", ["arm"])


@query(f"WITH {sql_posts('post_raw')}, t AS (SELECT string_split({sql_norm('post_raw')}, ' ') AS w FROM posts_u), o AS (SELECT array_to_string(w[1:3], ' ') AS opening, count(*) AS n FROM t WHERE len(w) >= 3 GROUP BY 1) SELECT opening, n FROM o WHERE n > 1 ORDER BY n DESC, opening LIMIT 10")
def top_openings(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return realism.top_openings(posts(spark, d, "post_raw"), "post_raw")


_EVIDENCE = f"list_filter(list_transform(string_split(regexp_replace(j, '(?s)^.*?\\x{{2026}}:\\s*', ''), ';'), lambda x: {sql_trim('x')}), lambda x: x <> '')"


@query(f"WITH {SQL_GOLD}, j AS (SELECT row_id, spans, array_to_string(spans, '; ') AS j FROM gold_u), e AS (SELECT row_id, spans, CASE WHEN lower({sql_trim('j')}) = 'none' THEN [] ELSE {_EVIDENCE} END AS p FROM j) SELECT row_id, CAST(len(p) AS INTEGER) AS n_parts, array_to_string(p, '|') AS parts, p IS DISTINCT FROM spans AS differs FROM e")
def evidence_parse(spark: SparkSession, d: str) -> DataFrame:
    """P2, P3, V2."""
    g = gold(spark, d).withColumn("p", T.parse_evidence(F.array_join("spans", "; ")))
    return g.select("row_id", F.size("p").alias("n_parts"), F.array_join("p", "|").alias("parts"), (~F.col("p").eqNullSafe(F.col("spans"))).alias("differs"))


@query("SELECT count(*) FILTER (gold_eval_spans IS NULL) AS null_cells, count(*) FILTER (len(gold_eval_spans) = 0) AS empty_cells, count(*) FILTER (len(list_filter(gold_eval_spans, lambda x: lower(x) = 'none')) > 0) AS none_cells, count(DISTINCT row_id) AS n_rows FROM gold")
def evidence_drift(spark: SparkSession, d: str) -> DataFrame:
    """Counts that a delivery must reproduce, to be held against the pinned ones by checks.expect."""
    c = lambda x, n: F.count(F.when(x, 1)).alias(n)
    e = F.col("gold_eval_spans")
    return table(spark, d, "gold", "row_id", "gold_eval_spans").agg(c(e.isNull(), "null_cells"), c(F.size(e) == 0, "empty_cells"), c(F.exists(e, lambda x: F.lower(x) == "none"), "none_cells"), F.count_distinct("row_id").alias("n_rows"))


@query("WITH g AS (SELECT DISTINCT row_id, list_filter(factors_mentions, lambda x: x IS NOT NULL) AS m FROM gold WHERE factors_mentions IS NOT NULL) SELECT row_id, CAST(len(m) AS INTEGER) AS n, array_to_string(m, '|') AS items FROM g")
def factor_cells(spark: SparkSession, d: str) -> DataFrame:
    """Factor cells written as quoted lists and read back."""
    g = table(spark, d, "gold", "row_id", "factors_mentions").where("factors_mentions is not null").select("row_id", F.filter("factors_mentions", lambda x: x.isNotNull()).alias("m")).distinct()
    quoted = lambda x: F.when(F.contains(x, F.lit("'")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), x, F.lit("'")))
    back = T.literal_list(F.concat(F.lit("["), F.array_join(F.transform("m", quoted), ", "), F.lit("]")))
    return g.select("row_id", back.alias("b")).select("row_id", F.size("b").alias("n"), F.array_join("b", "|").alias("items"))


@query(f"WITH {SQL_GOLD}, x AS (SELECT 'risk' AS field, risk AS v FROM gold_u UNION ALL SELECT 'factors', array_to_string(factors, ',') FROM gold_u UNION ALL SELECT 'fold', CAST(fold AS VARCHAR) FROM gold_u), c AS (SELECT field, v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY ALL) SELECT field, count(*) AS n_unique, max(n) AS max_repeat, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY field")
def value_profile(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values and the most repeats of each field."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), c.alias("v")) for n, c in (("risk", F.col("risk")), ("factors", F.array_join("factors", ",")), ("fold", F.col("fold").cast("string")))]))
    c = gold(spark, d).select(cells.alias("x")).select("x.*").where("v is not null").groupBy("field", "v").agg(F.count("*").alias("n"))
    return c.groupBy("field").agg(F.count("*").alias("n_unique"), F.max("n").alias("max_repeat"), F.sum("n").alias("n_rows"))


@query(f"WITH {SQL_GOLD}, f AS (SELECT unnest({sql_list(FACTORS)}) AS factor), x AS (SELECT unnest(factors) AS factor FROM gold_u) SELECT f.factor, count(x.factor) AS support FROM f LEFT JOIN x ON f.factor = x.factor GROUP BY f.factor")
def factor_supports(spark: SparkSession, d: str) -> DataFrame:
    """One-hot flags summed."""
    wide = gold(spark, d).agg(*[F.sum(F.array_contains("factors", f).cast("long")).alias(f"f_{i:02d}") for i, f in enumerate(FACTORS)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.coalesce(f"f_{i:02d}", F.lit(0)).alias("support")) for i, f in enumerate(FACTORS)])).alias("x")).select("x.*")


_TAGS = {"question": r"\?", "shouting": r"[A-Z]{4,}", "number": r"[0-9]", "quote": "[\"“”]", "ago": r"(?:^|[^a-z])ago(?:$|[^a-z])", "newline": r"\n"}


_SQL_TAGS = ", ".join("('" + k + "', '" + v + "')" for k, v in _TAGS.items())


@query(f"WITH {sql_posts('post_raw')}, c AS (SELECT row_id, {sql_number('row_id', chr(39) + 'curated' + chr(39))} % 300 = 0 AS curated, post_raw FROM posts_u), t(tag, pattern) AS (VALUES {_SQL_TAGS}), h AS (SELECT tag, row_id, row_number() OVER (PARTITION BY tag ORDER BY row_id) AS pick FROM c, t WHERE NOT curated AND regexp_matches(post_raw, pattern)) SELECT tag, row_id, CAST(pick AS INTEGER) AS pick FROM h WHERE pick <= 20 UNION ALL SELECT 'curated', row_id, 0 FROM c WHERE curated")
def regex_mining(spark: SparkSession, d: str) -> DataFrame:
    """First 20 hits of each tag, which is the feature, beside a curated list (by a hash) that mining leaves out."""
    from pyspark.sql.window import Window

    p = posts(spark, d, "post_raw")
    listed = p.select("row_id").where(T.stable_number(F.col("row_id"), F.lit("curated")) % 300 == 0)
    tags = F.explode(F.filter(F.array(*[F.when(F.col("post_raw").rlike(v), k) for k, v in _TAGS.items()]), lambda x: x.isNotNull()))
    hits = p.join(listed, "row_id", "left_anti").select("row_id", tags.alias("tag")).withColumn("pick", F.row_number().over(Window.partitionBy("tag").orderBy("row_id"))).where("pick <= 20")
    return hits.select("tag", "row_id", "pick").union(listed.select(F.lit("curated"), "row_id", F.lit(0)))


@query(f"WITH {SQL_GOLD} SELECT count(*) AS n_rows, CAST(sum(len(spans)) AS BIGINT) AS n_spans, count(*) FILTER (len(spans) > 0) AS with_evidence, count(*) FILTER (len(spans) = 0) AS without_evidence, count(*) FILTER (len(spans) > 0 AND risk = 'Indicator') AS lowest_with_evidence, count(*) FILTER (len(spans) = 0 AND risk <> 'Indicator') AS others_without FROM gold_u")
def evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    """V1."""
    return checks.evidence_counts(gold(spark, d), "spans", "risk", CLASSES[0])


@query(f"WITH {sql_posts('post_raw')} SELECT DISTINCT s.row_id, s.span_idx FROM spans s JOIN posts_u p ON s.row_id = p.row_id WHERE raw_slice IS NOT NULL AND raw_start >= 0 AND substring(post_raw, raw_start + 1, raw_end - raw_start) <> raw_slice")
def slice_errors(spark: SparkSession, d: str) -> DataFrame:
    """V5."""
    return checks.slice_errors(table(spark, d, "spans", "row_id", "span_idx", "raw_slice", "raw_start", "raw_end"), posts(spark, d, "post_raw"))


_P, _G = sql_scorer("raw_slice"), sql_scorer("text_gold")


@query(f"SELECT DISTINCT row_id, span_idx FROM spans WHERE use_for_supervision AND raw_slice IS NOT NULL AND NOT ({_P} <> '' AND {_G} <> '' AND (contains({_P}, {_G}) OR contains({_G}, {_P})) AND {sql_count('raw_slice')} <= 3 * {sql_count('text_gold')})")
def unscored_spans(spark: SparkSession, d: str) -> DataFrame:
    """A5, V5."""
    return checks.unscored(table(spark, d, "spans", "row_id", "span_idx", "text_gold", "raw_slice", "use_for_supervision"))


@query("SELECT rung, count(*) AS n, count(*) FILTER (n_occurrences > 1) AS n_repeated FROM spans GROUP BY rung")
def rung_census(spark: SparkSession, d: str) -> DataFrame:
    """V4, V6, M28."""
    return checks.rung_census(table(spark, d, "spans", "rung", "n_occurrences"))


@query(f"WITH {sql_posts('near_dup_cluster_id', 'is_representative', 'split')} SELECT near_dup_cluster_id, count(*) FILTER (is_representative) AS n FROM posts_u WHERE split = 'train' GROUP BY near_dup_cluster_id HAVING count(*) FILTER (is_representative) <> 1")
def representative_violations(spark: SparkSession, d: str) -> DataFrame:
    """V3."""
    return checks.representatives(posts(spark, d, "near_dup_cluster_id", "is_representative", "split").where("split = 'train'"), "near_dup_cluster_id", "is_representative")


@query("SELECT row_id, count(*) AS n FROM posts GROUP BY row_id HAVING count(*) > 1")
def repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    """IO1 assertions, J7."""
    return checks.duplicated(table(spark, d, "posts", "row_id"), "row_id")


@query(f"WITH {sql_posts('split')}, a AS (SELECT row_id FROM posts_u WHERE split = 'train'), b AS (SELECT DISTINCT row_id FROM gold) SELECT 'left' AS side, row_id FROM a WHERE row_id NOT IN (SELECT row_id FROM b) UNION ALL SELECT 'right', row_id FROM b WHERE row_id NOT IN (SELECT row_id FROM a)")
def key_differences(spark: SparkSession, d: str) -> DataFrame:
    """Train posts against gold, both ways."""
    return checks.same_keys(posts(spark, d, "split").where("split = 'train'"), table(spark, d, "gold", "row_id"), "row_id")


@query(f"WITH {sql_posts('split', 'anon_user_id')}, k AS (SELECT 'row' AS kind, row_id AS k, split FROM posts_u UNION ALL SELECT 'user', anon_user_id, split FROM posts_u) SELECT kind, k AS value FROM k WHERE split = 'train' AND k IS NOT NULL INTERSECT SELECT kind, k FROM k WHERE split = 'leaderboard'")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Row ids and authors that stand in both splits."""
    p = posts(spark, d, "split", "anon_user_id")
    k = p.select("split", F.lit("row").alias("kind"), F.col("row_id").alias("value")).union(p.select("split", F.lit("user"), "anon_user_id")).where("value is not null")
    return k.where("split = 'train'").select("kind", "value").intersect(k.where("split = 'leaderboard'").select("kind", "value"))


_LABEL = "regexp_replace(risk, '[^A-Za-z]+', '', 'g')"


@query(f"""WITH r AS (SELECT case_id, annotator, CASE WHEN risk IS NULL THEN 'no risk' WHEN upper({_LABEL}[1]) || lower({_LABEL}[2:]) NOT IN ('Indicator', 'Ideation', 'Behavior', 'Attempt', 'Unclear') THEN 'risk' WHEN naturalness NOT BETWEEN 1 AND 5 THEN 'naturalness' WHEN confidence NOT BETWEEN 1 AND 3 THEN 'confidence' WHEN len(list_filter(factors, lambda f: f IS NULL OR NOT list_contains({sql_list(FACTORS)}, f))) > 0 THEN 'factors' WHEN status NOT IN ('complete', 'in_progress') THEN 'status' END AS reason FROM annotations) SELECT DISTINCT * FROM r WHERE reason IS NOT NULL""")
def response_errors(spark: SparkSession, d: str) -> DataFrame:
    """V12, IO14 payload checks."""
    return checks.response_errors(table(spark, d, "annotations"), CLASSES, FACTORS)


def _sql_clip(x: str, n: int) -> str:
    t = sql_trim(sql_collapse(x))
    return f"CASE WHEN length({t}) > {n} THEN regexp_replace(substring({t}, 1, {n}), '{SQL_WS}+$', '') || ' [...]' ELSE {t} END"


@query(
    f"""WITH {sql_posts('post_raw', 'anon_user_id', 'post_id')}, t AS (SELECT *, {_sql_clip('post_raw', 300)} AS t FROM posts_u)
SELECT row_id, CAST(row_number() OVER w AS INTEGER) AS position, count(*) OVER (PARTITION BY anon_user_id) AS n_posts, concat_ws(chr(10), '[-2] ' || lag(t, 2) OVER w, '[-1] ' || lag(t, 1) OVER w, '[+1] ' || lead(t, 1) OVER w) AS context FROM t WINDOW w AS (PARTITION BY anon_user_id ORDER BY post_id, row_id)"""
)
def timeline_context(spark: SparkSession, d: str) -> DataFrame:
    """W1, W2, P16."""
    return timeline.context(posts(spark, d, "post_raw", "anon_user_id", "post_id"), "anon_user_id", "post_id", "row_id", "post_raw")


@query(f"WITH {sql_posts('anon_user_id', 'post_id')}, i AS (SELECT anon_user_id, post_id, row_number() OVER (PARTITION BY anon_user_id ORDER BY post_id) - 1 AS i FROM posts_u) SELECT anon_user_id, count(*) AS n, count(*) FILTER (i <> post_id) AS n_wrong FROM i GROUP BY anon_user_id HAVING count(*) FILTER (i <> post_id) > 0")
def timeline_gaps(spark: SparkSession, d: str) -> DataFrame:
    """W3."""
    return timeline.gaps(posts(spark, d, "anon_user_id", "post_id"), "anon_user_id", "post_id")


@query(
    f"""WITH {sql_posts('anon_user_id', 'post_id')}, p AS (SELECT row_id, anon_user_id, row_number() OVER (PARTITION BY anon_user_id ORDER BY post_id, row_id) AS position, count(*) OVER (PARTITION BY anon_user_id) AS n FROM posts_u),
c AS (SELECT 'case-' || anon_user_id AS case_id, anon_user_id, {sql_number('anon_user_id', "'gap'")} % (max(n) + 1) AS gap FROM p GROUP BY anon_user_id)
SELECT case_id, max(n) AS n_host, coalesce(string_agg(row_id, ',' ORDER BY position) FILTER (position <= gap), '') AS earlier, coalesce(string_agg(row_id, ',' ORDER BY position) FILTER (position > gap), '') AS later FROM c JOIN p USING (anon_user_id) WHERE position > gap - 2 AND position <= gap + 1 GROUP BY case_id"""
)
def case_neighbour_ids(spark: SparkSession, d: str) -> DataFrame:
    """One case per author, its gap from a hash."""
    p = posts(spark, d, "anon_user_id", "post_id")
    cases = p.groupBy("anon_user_id").agg(F.count("*").alias("n")).select(F.concat(F.lit("case-"), "anon_user_id").alias("case_id"), "anon_user_id", (T.stable_number(F.col("anon_user_id"), F.lit("gap")) % (F.col("n") + 1)).alias("gap"))
    return timeline.around_gap(cases, p, "anon_user_id", "post_id", "row_id")


_GRAMS = "SELECT {k} AS k, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {k}, string_split({n}, ' ') AS w FROM {t}))"


@query(f"WITH a AS ({_GRAMS.format(k='doc_id', n=sql_norm('text'), t='documents')}), b AS ({_GRAMS.format(k='item_id', n=sql_norm('text'), t='eval_items')}) SELECT DISTINCT a.k AS doc_id FROM a SEMI JOIN b USING (g) UNION SELECT d.doc_id FROM documents d JOIN eval_items e ON {sql_key('d.text')} = {sql_key('e.text')}")
def contamination_8gram(spark: SparkSession, d: str) -> DataFrame:
    """G4, J9."""
    return screen.overlap(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "text"), "text")


def _sql_set(x: str, n: int) -> str:
    return f"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i+{n - 1}], ' '))"


@query(f"WITH {DRAFTS}, p AS (SELECT case_id, list_transform({SQL_SHOWN}, lambda x: string_split({sql_norm('x')}, ' ')) AS shown FROM prompts), t AS (SELECT draft_id, string_split({sql_norm('text')}, ' ') AS a, shown FROM drafts JOIN p USING (case_id)), g AS (SELECT draft_id, {_sql_set('a', 6)} AS own, shown FROM t) SELECT draft_id, coalesce(len(list_filter(shown, lambda b: list_has_any(own, {_sql_set('b', 6).replace('lambda i', 'lambda k').replace('[i:i+', '[k:k+')}))) > 0, false) AS copied FROM g")
def reference_copy_6gram(spark: SparkSession, d: str) -> DataFrame:
    """Runs of six words that a draft has in common with a post its prompt shows."""
    return _with_shown(spark, d).select("draft_id", screen.shares_gram(F.col("text"), F.col("shown")).alias("copied"))


def _with_shown(spark: SparkSession, d: str, how: str = "inner") -> DataFrame:
    p = table(spark, d, "prompts", "case_id", "user_text").select("case_id", T.shown_posts(F.col("user_text")).alias("shown"))
    return drafts(spark, d).join(p, "case_id", how)


@query(
    f"""WITH {DRAFTS}, t AS (SELECT case_id, draft_id, list_distinct({_sql_set('w', 4)}) AS g FROM (SELECT case_id, draft_id, regexp_extract_all(replace(lower(text), '’', ''''), '[a-z'']+') AS w FROM drafts))
SELECT x.draft_id AS draft_a, y.draft_id AS draft_b, coalesce(round(CASE WHEN len(list_distinct(list_concat(x.g, y.g))) > 0 THEN len(list_intersect(x.g, y.g))::DOUBLE / len(list_distinct(list_concat(x.g, y.g))) ELSE 0 END, 8), 0) AS jaccard FROM t x JOIN t y ON x.case_id = y.case_id AND x.draft_id < y.draft_id"""
)
def gram4_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The drafts of one case."""
    x = drafts(spark, d).select("case_id", "draft_id", F.coalesce("text", F.lit("")).alias("text"))
    j = x.alias("x").join(x.alias("y"), "case_id").where("x.draft_id < y.draft_id")
    return j.select(F.col("x.draft_id").alias("draft_a"), F.col("y.draft_id").alias("draft_b"), F.round(screen.jaccard(F.col("x.text"), F.col("y.text")), 8).alias("jaccard"))


def screened_drafts(spark: SparkSession, d: str, ratio: bool = True) -> DataFrame:
    """Drafts with case labels, shown posts, cleaned text and the first failing reason; null where they pass."""
    j = _with_shown(spark, d, "left").join(assigned(spark, d), "case_id", "left").withColumn("post", T.clean_post(F.col("text")))
    j = stage(j, "drafts")
    hit = screen.overlap(j, "draft_id", "post", table(spark, d, "posts", "post_raw"), "post_raw").withColumn("hit", F.lit(True))
    disclaimed = (F.col("risk") == DISCLAIMED) & F.col("post").rlike(DISCLAIMER)
    reason = screen.cheap_reason(F.col("post"), F.col("status"), REFUSAL, F.col("hit"), screen.shares_gram(F.col("post"), F.col("shown")), disclaimed)
    r = j.join(hit, "draft_id", "left").withColumn("reason", reason)
    return screen.screened(r, "post", "shown", "reason") if ratio else r


@query()
def screening_cascade(spark: SparkSession, d: str) -> DataFrame:
    """With the sequence ratio against the shown posts on survivors."""
    return screened_drafts(spark, d).select("draft_id", F.coalesce("reason", F.lit("passed")).alias("reason"))


_POST = f"""CASE WHEN regexp_matches({sql_trim('text')}, '(?s)^".*"$') AND length({sql_trim('text')}) >= 2 OR regexp_matches({sql_trim('text')}, '(?s)^''.*''$') AND length({sql_trim('text')}) >= 2 THEN {sql_trim(f"substring({sql_trim('text')}, 2, length({sql_trim('text')}) - 2)")} ELSE {sql_trim('text')} END"""
_RUNS = lambda x, n: f"list_transform(range(1, len({x}) - {n - 2}), lambda i: array_to_string({x}[i:i+{n - 1}], ' '))"
SQL_FLAGS = f"""{DRAFTS}, {SQL_ASSIGNED}, shown_u AS (SELECT case_id, list_distinct(flatten(list_transform({SQL_SHOWN}, lambda x: list_transform([string_split({sql_norm('x')}, ' ')], lambda w: {_RUNS('w', 6)})[1]))) AS shown6 FROM prompts),
clean_u AS (SELECT draft_id, case_id, arm, draft, text, status, {_POST} AS post FROM drafts), corpus8 AS (SELECT DISTINCT unnest({_RUNS('w', 8)}) AS g FROM (SELECT string_split({sql_norm('post_raw')}, ' ') AS w FROM posts)), corpusk AS (SELECT DISTINCT {sql_key('post_raw')} AS k FROM posts),
own8 AS (SELECT draft_id, unnest({_RUNS('w', 8)}) AS g FROM (SELECT draft_id, string_split({sql_norm('post')}, ' ') AS w FROM clean_u)), hit8 AS (SELECT DISTINCT draft_id FROM own8 SEMI JOIN corpus8 USING (g) UNION SELECT draft_id FROM clean_u WHERE {sql_key('post')} IN (SELECT k FROM corpusk)),
flags AS (SELECT c.draft_id, c.case_id, c.arm, c.post, CASE WHEN status IS DISTINCT FROM 'ok' THEN 'status:' || coalesce(status, 'missing') WHEN coalesce(post, '') = '' THEN 'empty' WHEN regexp_matches(post, '{REFUSAL.replace("'", "''")}') THEN 'soft_refusal' WHEN a.risk = '{DISCLAIMED}' AND regexp_matches(post, '{DISCLAIMER.replace("'", "''")}') THEN 'plan_disclaimer' WHEN {sql_count('post')} > 700 THEN 'too_long' WHEN h.draft_id IS NOT NULL THEN 'real_overlap' WHEN list_has_any(list_transform([string_split({sql_norm('post')}, ' ')], lambda w: {_RUNS('w', 6)})[1], shown6) THEN 'reference_copy' ELSE 'passed' END AS reason
FROM clean_u c LEFT JOIN assigned a USING (case_id) LEFT JOIN shown_u s USING (case_id) LEFT JOIN hit8 h ON c.draft_id = h.draft_id)"""


@query(f"WITH {SQL_FLAGS} SELECT draft_id, reason FROM flags")
def screening_flags(spark: SparkSession, d: str) -> DataFrame:
    """All reasons of the cascade but the sequence ratio."""
    return screened_drafts(spark, d, False).select("draft_id", F.coalesce("reason", F.lit("passed")).alias("reason"))


@query(f"WITH {SQL_FLAGS} SELECT arm, reason, count(*) AS n FROM flags GROUP BY ALL")
def arm_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Reject counters per arm."""
    return screened_drafts(spark, d, False).groupBy("arm", F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


_VOCABULARY = {"ending": "(?i)(not wake up|disappear|goodbye|funeral)", "hurt": "(?i)(hospital|ambulance|ward)", "taxonomy": "(?i)(worthless|trapped|lonely|hopeless|burden)"}
_SQL_RATES = ", ".join(f"round(avg(regexp_matches(text, '{v}')::INT), 4) AS {k}" for k, v in _VOCABULARY.items())


@query(f"WITH {DRAFTS}, {SQL_ASSIGNED} SELECT arm, risk, count(*) AS n, {_SQL_RATES} FROM drafts LEFT JOIN assigned USING (case_id) WHERE text IS NOT NULL GROUP BY arm, risk")
def vocabulary_rates(spark: SparkSession, d: str) -> DataFrame:
    """Shares of drafts with words of each vocabulary, per arm and class."""
    j = drafts(spark, d).where("text is not null").join(assigned(spark, d).select("case_id", "risk"), "case_id", "left")
    return j.groupBy("arm", "risk").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col("text").rlike(v).cast("double")), 4).alias(k) for k, v in _VOCABULARY.items()])


@query()
def draft_selection(spark: SparkSession, d: str) -> DataFrame:
    """Among the passing drafts of each case, within its target factor."""
    x = screened_drafts(spark, d).withColumn("ok", F.col("reason").isNull())
    return screen.draft_selection(x, "target_factor")


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    j = gold(spark, d).select("row_id", "spans").join(posts(spark, d, "post_raw"), "row_id")
    return spans.aligned(j, "row_id", "post_raw", "spans")


@query()
def span_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Gold spans aligned to their posts."""
    a = _aligned(spark, d)
    return a.select("row_id", "span_idx", "parent_span_idx", "text_gold", "rung", "raw_start", "raw_end", "raw_slice", "n_occurrences", F.array_join(F.transform("all_starts", lambda x: x.cast("string")), ",").alias("all_starts"))


@query()
def span_slices(spark: SparkSession, d: str) -> DataFrame:
    """Scorer fields of the aligned spans."""
    return _aligned(spark, d).select("row_id", "span_idx", "scorer_rung", "scorer_start", "scorer_end", "scorer_slice")


@query(
    f"""WITH {sql_posts('post_raw')}, s AS (SELECT DISTINCT row_id, raw_start AS a, raw_end AS b, raw_slice AS t FROM spans WHERE matched), j AS (SELECT s.*, length(post_raw) AS n, substring(post_raw, a + 1, b - a) AS part FROM s JOIN posts_u USING (row_id)),
v AS (SELECT *, {sql_trim('part')} AS bare FROM j), e AS (SELECT row_id, CASE WHEN bool_or(a IS NULL OR b IS NULL OR a < 0 OR b > n OR b <= a) THEN 'offsets' WHEN bool_or(t IS NOT NULL AND bare <> '' AND {sql_trim('t')} <> bare) THEN 'text' END AS error FROM v GROUP BY row_id),
c AS (SELECT row_id, a + length(part) - length(regexp_replace(part, '^{SQL_WS}+', '')) AS x, bare FROM v JOIN e USING (row_id) WHERE error IS NULL AND bare <> ''), w AS (SELECT row_id, x, x + length(bare) AS y FROM c),
m AS (SELECT *, CASE WHEN x <= max(y) OVER (PARTITION BY row_id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM w), g AS (SELECT *, sum(new) OVER (PARTITION BY row_id ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS k FROM m),
r AS (SELECT row_id, min(x) AS x, max(y) AS y FROM g GROUP BY row_id, k), l AS (SELECT row_id, string_agg(x || '-' || y, ',' ORDER BY x) AS ranges FROM r GROUP BY row_id) SELECT e.row_id, error, CASE WHEN error IS NULL THEN coalesce(ranges, '') END AS ranges FROM e LEFT JOIN l USING (row_id)"""
)
def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Delivered spans of each post checked against it, touching ones joined."""
    s = table(spark, d, "spans", "row_id", "raw_start", "raw_end", "raw_slice", "matched").where("matched").groupBy("row_id").agg(F.collect_set(F.struct(F.col("raw_start").alias("start"), F.col("raw_end").alias("end"), F.col("raw_slice").alias("text"))).alias("s"))
    j = s.join(posts(spark, d, "post_raw"), "row_id").select("row_id", spans.checked_ranges(F.col("post_raw"), F.col("s")).alias("c"))
    text = F.array_join(F.transform("c.ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return j.select("row_id", "c.error", text.alias("ranges"))


@query()
def claimed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim ranges of the gold spans that do not overlap; null where one is missing."""
    j = gold(spark, d).select("row_id", "spans").join(posts(spark, d, "post_raw"), "row_id").withColumn("r", spans.claimed(F.col("post_raw"), F.col("spans")))
    return j.select("row_id", F.array_join(F.transform("r", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("ranges"))


_TOK = "[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query(f"WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '{_TOK}')) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 100 THEN text ELSE regexp_extract(text, '^({SQL_WS}*{_TOK}){{60}}') || ' [...] ' || regexp_extract(text, '(?:{_TOK}{SQL_WS}*){{40}}$') END AS short_text, CAST(CASE WHEN text IS NULL THEN 0 WHEN n <= 100 THEN 1 ELSE 2 END AS INTEGER) AS n_ranges FROM t")
def head_tail_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut to a budget of 100 tokens."""
    return timeline.truncated(table(spark, d, "documents", "doc_id", "text"), "text", 100).select("doc_id", "short_text", "n_ranges")


@query()
def truncate_with_cover(spark: SparkSession, d: str) -> DataFrame:
    """Posts cut to 40 tokens around their supervised spans, and how many of these lie in what is kept."""
    s = table(spark, d, "spans", "row_id", "raw_start", "raw_end", "use_for_supervision").where("use_for_supervision and raw_end > raw_start").groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct(F.col("raw_start").alias("start"), F.col("raw_end").alias("end")))).alias("cover"))
    t = timeline.truncated(s.join(posts(spark, d, "post_raw"), "row_id"), "post_raw", 40, "cover")
    return t.select("row_id", "short_text", "n_ranges", F.size("cover").alias("n_spans"), F.size(F.filter("cover", lambda x: timeline.inside(x, F.col("kept")))).alias("n_inside"))


_JSON = lambda x: "'\"' || " + f"""replace(replace(replace(replace({x}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t')""" + " || '\"'"
_EVID = f"'[' || array_to_string(list_transform(CASE WHEN risk = 'Indicator' THEN [] ELSE spans END, lambda x: {_JSON('x')}), ', ') || ']'"


@query(
    f"""WITH {SQL_GOLD}, t AS (SELECT row_id, '{{"risk": "' || risk || '", "evidence": ' || {_EVID} || ', "factors": [' || array_to_string(list_transform(factors, lambda f: '"' || f || '"'), ', ') || ']}}' AS v1,
'{{"evidence": ' || {_EVID} || ', "factors": {{' || array_to_string(list_transform({sql_list(FACTORS)}, lambda f: '"' || f || '": ' || CASE WHEN list_contains(factors, f) THEN 'true' ELSE 'false' END), ', ') || '}}, "risk": "' || risk || '"}}' AS v2, array_to_string(factors, ',') AS factors FROM gold_u WHERE risk IS NOT NULL) SELECT row_id, v1, v2, factors, true AS same, true AS well_formed FROM t"""
)
def sft_targets(spark: SparkSession, d: str) -> DataFrame:
    """Both forms of the target, and the factors read back."""
    g = gold(spark, d).where("risk is not null")
    ev = F.when(F.col("risk") == CLASSES[0], F.array().cast("array<string>")).otherwise(F.col("spans"))
    t = g.select("row_id", render.target_list(F.col("risk"), ev, F.col("factors")).alias("v1"), render.target_map(F.col("risk"), ev, F.col("factors")).alias("v2"))
    return t.withColumn("factors", F.array_join(render.true_factors(F.col("v2")), ",")).withColumn("same", render.true_factors(F.col("v1")) == render.true_factors(F.col("v2"))).withColumn("well_formed", F.col("v2").rlike(parsing.output_pattern()))


@query()
def parse_generation(spark: SparkSession, d: str) -> DataFrame:
    """Rendered targets, some broken by hash, parsed, repaired and resolved over two attempts."""
    g = gold(spark, d).where("risk is not null").join(posts(spark, d, "post_raw"), "row_id")
    n = T.stable_number(F.col("row_id"), F.col("attempt").cast("string"))
    full = render.target_map(F.col("risk"), F.col("spans"), F.col("factors"))
    a = g.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("output", F.when(n % 5 == 0, F.substring(full, 1, 40)).when(n % 5 == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).otherwise(full)).select("row_id", "attempt", "output", "post_raw")
    r = parsing.resolved(parsing.repaired(parsing.parsed(a, "output", "post_raw")), "row_id", "attempt")
    return r.select("row_id", "attempt", "risk", F.array_join("evidence", "|").alias("evidence"), F.array_join("factors", ",").alias("factors"), "dropped", "parse_failure")


@query(
    f"""WITH {SQL_GOLD}, {sql_posts('post_raw', 'anon_user_id', 'split')}, u AS (SELECT DISTINCT row_id, raw_start, raw_end, raw_slice FROM spans WHERE use_for_supervision AND raw_slice IS NOT NULL), s AS (SELECT row_id, string_agg(raw_slice, '|' ORDER BY raw_start, raw_end, raw_slice) AS slices, string_agg(CAST({sql_count('raw_slice')} AS VARCHAR), ',' ORDER BY raw_start, raw_end, raw_slice) AS span_lens FROM u GROUP BY row_id)
SELECT row_id, anon_user_id AS user, fold, risk, array_to_string(factors, ',') AS factors, {sql_count('post_raw')} AS n_words, coalesce(slices, '') AS slices, coalesce(span_lens, '') AS span_lens FROM gold_u JOIN posts_u USING (row_id) LEFT JOIN s USING (row_id) WHERE split = 'train'"""
)
def real_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Real rows with labels, fold, length and supervised slices."""
    u = table(spark, d, "spans", "row_id", "raw_start", "raw_end", "raw_slice", "use_for_supervision").where("use_for_supervision and raw_slice is not null").select("row_id", F.struct("raw_start", "raw_end", "raw_slice").alias("s")).distinct()
    s = u.groupBy("row_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    j = real_rows(spark, d).join(s, "row_id", "left").withColumn("s", F.transform(F.coalesce("s", F.array().cast(s.schema["s"].dataType)), lambda x: x["raw_slice"]))
    return j.select("row_id", "user", "fold", "risk", F.array_join("factors", ",").alias("factors"), "n_words", F.array_join("s", "|").alias("slices"), F.array_join(F.transform("s", lambda x: T.ws_count(x).cast("string")), ",").alias("span_lens"))


@query(f"WITH {SQL_GOLD}, p AS (SELECT row_id, array_to_string(spans, chr(31)) AS a FROM gold_u) SELECT count(*) AS n, count(DISTINCT row_id) AS n_keys, true AS same FROM p")
def build_digest(spark: SparkSession, d: str) -> DataFrame:
    """Two builds of the gold table, one of them over a table dealt anew, have one digest."""
    g = gold(spark, d).select("row_id", F.array_join("spans", "\x1f").alias("a"), "risk")
    x, y = checks.digest(g), checks.digest(g.repartition(7, "a")).withColumnsRenamed({"n": "m", "digest": "other"})
    keys = g.agg(F.count_distinct("row_id").alias("n_keys"))
    return x.crossJoin(y).crossJoin(keys).select("n", "n_keys", (F.col("digest").eqNullSafe(F.col("other")) & (F.col("n") == F.col("m"))).alias("same"))  # one row each


@query(f"WITH {DRAFTS} SELECT draft_id, regexp_extract(draft_id, '^(.*)-d[0-9]+$', 1) AS case_part, CAST(regexp_extract(draft_id, '-d([0-9]+)$', 1) AS INTEGER) AS draft_part, CAST(regexp_extract(draft_id, '^K([0-9])C', 1) AS INTEGER) AS fold_part, regexp_replace(regexp_replace(lower(arm), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, {_sql_clip('text', 1200)} AS reference FROM drafts")
def draft_ids(spark: SparkSession, d: str) -> DataFrame:
    """P16, P23, P24."""
    e = lambda p: F.regexp_extract("draft_id", p, 1)
    return drafts(spark, d).select("draft_id", e("^(.*)-d[0-9]+$").alias("case_part"), e("-d([0-9]+)$").cast("int").alias("draft_part"), e("^K([0-9])C").cast("int").alias("fold_part"), T.slug(F.col("arm")).alias("slug"), T.clip(F.col("text"), 1200, " [...]").alias("reference"))


@query(f"""WITH {DRAFTS}, c AS (SELECT draft_id, {_POST} AS t, array_to_string({SQL_SHOWN}, '') AS u FROM drafts JOIN prompts USING (case_id)) SELECT draft_id, CASE WHEN length(u) - length(replace(u, '’', '')) > length(u) - length(replace(u, '''', '')) THEN replace(t, '''', '’') ELSE t END AS post FROM c""")
def cleaned_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Apostrophes as in the posts that the prompt shows."""
    return _with_shown(spark, d).select("draft_id", T.match_apostrophes(T.clean_post(F.col("text")), F.col("shown")).alias("post"))


@query("SELECT subject, regexp_replace(description, '\\s*\\((?:e\\.g\\.|for example)[^)]*\\)', '', 'g') || CASE WHEN subject IN ('sport', 'health') THEN ' (protective)' ELSE '' END AS definition FROM subjects")
def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions without their examples, protective ones marked."""
    t = table(spark, d, "subjects", "subject", "description")
    return t.select("subject", render.definition(F.col("description"), {}, ["sport", "health"], F.col("subject")).alias("definition"))