"""Inputs of the queries: one row per record of the delivered tables, and the same as SQL.

The predictions that the scoring queries need are made from hashes of the ids, so both engines make the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import CLASSES, FACTORS, RARE
from quillspark.functions.text import in_taxonomy, risk_norm, risk_ord, stable_number, ws_count
from quillspark.sources.tables import table

SEP = "\x1f"


def posts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per row_id: the greatest value of each column over its deliveries."""
    return table(spark, d, "posts", "row_id", *columns).groupBy("row_id").agg(*[F.max(c).alias(c) for c in columns])


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, risk, risk_ord, spans, factors, weight, fold): one row per row_id, entries that are null left out."""
    text = lambda c: F.max(F.array_join(c, SEP)).alias(c)
    g = table(spark, d, "gold", "row_id", "risk_norm", "gold_eval_spans", "factors_set", "train_weight", "fold").groupBy("row_id").agg(F.max(risk_norm(F.col("risk_norm"))).alias("risk"), text("gold_eval_spans"), text("factors_set"), F.max("train_weight").cast("double").alias("weight"), F.max("fold").cast("int").alias("fold"))
    back = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), SEP), lambda x: x != "")
    return g.select("row_id", "risk", risk_ord(F.col("risk")).alias("risk_ord"), back("gold_eval_spans").alias("spans"), in_taxonomy(back("factors_set"), FACTORS).alias("factors"), "weight", "fold")


def predicted_risk(seed: str) -> Column:
    n = stable_number(F.col("row_id"), F.lit(seed))
    other = F.element_at(F.array(*map(F.lit, CLASSES)), (F.pmod(F.floor(n / 16), F.lit(4)) + 1).cast("int"))
    return F.when(F.col("risk").isNull() | (n % 10 >= 7), other).otherwise(F.col("risk"))


def predicted_factors(seed: str) -> Column:
    def keep(f: Column) -> Column:
        n = stable_number(F.col("row_id"), f, F.lit(seed))
        return F.when(F.array_contains("factors", f), n % 10 >= 2).otherwise(n % 40 == 0)

    return F.filter(F.array(*map(F.lit, FACTORS)), keep)


def scored(spark: SparkSession, d: str, seed: str = "s1") -> DataFrame:
    """Gold rows with pred and pred_factors."""
    return gold(spark, d).withColumn("pred", predicted_risk(seed)).withColumn("pred_factors", predicted_factors(seed))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, risk, factors, target_factor): the labels that cases were written for.

    The delivered tables don't hold them, so they are made from hashes of the case, the same in both engines.
    """
    n = lambda *x: stable_number(F.col("case_id"), *x)
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    c = table(spark, d, "prompts", "case_id").where("case_id is not null").distinct()
    c = c.withColumn("risk", pick(CLASSES, n(F.lit("class")))).withColumn("target_factor", pick(RARE, n(F.lit("target"))))
    some = F.filter(F.array(*map(F.lit, FACTORS)), lambda f: (n(f) % 12 == 0) | (f == F.col("target_factor")))
    return c.withColumn("factors", some)


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """One row per draft of the delivered outputs: the greatest value of each column."""
    c = ["case_id", "text", "status", "draft", "arm"]
    return table(spark, d, "outputs", "draft_id", *c).groupBy("draft_id").agg(*[F.max(x).alias(x) for x in c])


def hosts(spark: SparkSession, d: str) -> DataFrame:
    """(user, n_posts) of authors of train posts."""
    p = posts(spark, d, "anon_user_id", "split").where("split = 'train' and anon_user_id is not null")
    return p.groupBy(F.col("anon_user_id").alias("user")).agg(F.count("*").alias("n_posts"))


def real_rows(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, user, fold, risk, factors, n_words, text): train posts with their labels."""
    p = posts(spark, d, "anon_user_id", "split", "post_raw").where("split = 'train'").select("row_id", F.col("anon_user_id").alias("user"), F.col("post_raw").alias("text"))
    return gold(spark, d).select("row_id", "risk", "factors", "fold").join(p, "row_id").withColumn("n_words", ws_count(F.col("text")))


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def sql_number(*parts: str) -> str:
    return f"CAST('0x' || substr(sha256(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


SQL_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{SQL_WS}+', ' ', 'g')"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_scorer(x: str) -> str:
    return f"lower({sql_trim(sql_collapse(x))})"


def sql_norm(x: str) -> str:
    return sql_scorer(f"replace(translate({x}, '‘’“”' || chr(160), '''''\"\" '), '…', '...')")


def sql_key(x: str) -> str:
    return f"""regexp_replace(regexp_replace({sql_norm(x)}, '\\.{{2,}}', '.', 'g'), '[.!?\\s\\x{{0b}}"]+$', '')"""


def sql_count(x: str) -> str:
    t = sql_trim(sql_collapse(x))
    return f"CAST(CASE WHEN {t} = '' THEN 0 ELSE length({t}) - length(replace({t}, ' ', '')) + 1 END AS INTEGER)"


def sql_posts(*columns: str) -> str:
    return "posts_u AS (SELECT row_id, " + ", ".join(f"max({c}) AS {c}" for c in columns) + " FROM posts GROUP BY row_id)"


_RISK = "regexp_replace(risk_norm, '[^A-Za-z]+', '', 'g')"
SQL_GOLD = f"""gold_r AS (SELECT row_id, upper({_RISK}[1]) || lower({_RISK}[2:]) AS r, array_to_string(gold_eval_spans, chr(31)) AS s, array_to_string(factors_set, chr(31)) AS f, train_weight, fold FROM gold),
gold_m AS (SELECT row_id, max(CASE WHEN r IN ('Indicator', 'Ideation', 'Behavior', 'Attempt') THEN r END) AS risk, max(s) AS s, max(f) AS f, CAST(max(train_weight) AS DOUBLE) AS weight, CAST(max(fold) AS INTEGER) AS fold FROM gold_r GROUP BY row_id),
gold_u AS (SELECT row_id, risk, CAST(list_position({sql_list(CLASSES)}, risk) - 1 AS INTEGER) AS risk_ord, list_filter(string_split(coalesce(s, ''), chr(31)), lambda x: x <> '') AS spans, list_filter({sql_list(FACTORS)}, lambda x: list_contains(string_split(coalesce(f, ''), chr(31)), x)) AS factors, weight, fold FROM gold_m)"""


def sql_scored(seed: str = "s1", name: str = "scored") -> str:
    n, m = sql_number("row_id", f"'{seed}'"), sql_number("row_id", "x", f"'{seed}'")
    return f"""{name} AS (SELECT *, CASE WHEN risk IS NULL OR {n} % 10 >= 7 THEN ({sql_list(CLASSES)})[CAST(({n} // 16) % 4 AS INTEGER) + 1] ELSE risk END AS pred, list_filter({sql_list(FACTORS)}, lambda x: CASE WHEN list_contains(factors, x) THEN {m} % 10 >= 2 ELSE {m} % 40 = 0 END) AS pred_factors FROM gold_u)"""


DRAFTS = "drafts AS (SELECT draft_id, max(case_id) AS case_id, max(text) AS text, max(status) AS status, max(draft) AS draft, max(arm) AS arm FROM outputs GROUP BY draft_id)"


def _sql_pick(items: list[str], n: str) -> str:
    return f"({sql_list(items)})[CAST({n} % {len(items)} AS INTEGER) + 1]"


SQL_ASSIGNED = f"""cases_u AS (SELECT DISTINCT case_id, {_sql_pick(CLASSES, sql_number('case_id', "'class'"))} AS risk, {_sql_pick(RARE, sql_number('case_id', "'target'"))} AS target_factor FROM prompts WHERE case_id IS NOT NULL),
assigned AS (SELECT *, list_filter({sql_list(FACTORS)}, lambda f: {sql_number('case_id', 'f')} % 12 = 0 OR f = target_factor) AS factors FROM cases_u)"""
# The posts that a prompt shows, as a list.
SQL_SHOWN = r"""list_filter(list_transform(string_split_regex(regexp_replace(user_text, '\n[^\n]*$', ''), '(?m)^\[[0-9]+\] ?')[2:], lambda x: """ + sql_trim(r"regexp_replace(x, '\s*\[\.\.\.\]\s*$', '')") + """), lambda x: x <> '')"""
_M32 = 4294967296


def sql_mixed(x: str) -> str:
    """The 32-bit scramble of the bootstrap draws."""
    a = f"((xor(CAST({x} AS BIGINT), CAST({x} AS BIGINT) >> 16) * {0x21F0AAAD}) % {_M32})"
    b = f"((xor({{0}}, {{0}} >> 15) * {0x735A2D97}) % {_M32})"
    return f"list_transform(list_transform([{a}], lambda y: {b.format('y')}), lambda z: xor(z, z >> 15))[1]"
