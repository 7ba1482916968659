"""Rendered targets and prompts.  JSON is built with spaces after commas and colons and keys in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.config import CLIP_MARK, FACTORS, REFERENCE_CLIP, WORD_RANGE
from quillspark.functions.text import clip, in_taxonomy, stable_number, stable_rank
from quillspark.operators.ordering import numbered


def quoted(c: Column) -> Column:
    """A JSON string literal; characters beyond ASCII stay."""
    t = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), t, F.lit('"'))


def listed(c: Column) -> Column:
    items = F.coalesce(c, F.array().cast("array<string>"))
    return F.concat(F.lit("["), F.array_join(F.transform(F.filter(items, lambda x: x.isNotNull()), quoted), ", "), F.lit("]"))


def target_list(risk: Column, evidence: Column, factors: Column, taxonomy: list[str] = FACTORS) -> Column:
    """{"risk", "evidence", "factors"} with the factors as a list."""
    return F.concat(F.lit('{"risk": '), quoted(risk), F.lit(', "evidence": '), listed(evidence), F.lit(', "factors": '), listed(in_taxonomy(factors, taxonomy)), F.lit("}"))


def target_map(risk: Column, evidence: Column, factors: Column, taxonomy: list[str] = FACTORS) -> Column:
    """{"evidence", "factors", "risk"} with every factor as true or false."""
    flag = lambda f: F.when(F.coalesce(F.array_contains(factors, f), F.lit(False)), "true").otherwise("false")
    pairs = F.concat_ws(", ", *[F.concat(quoted(F.lit(f)), F.lit(": "), flag(f)) for f in taxonomy])
    return F.concat(F.lit('{"evidence": '), listed(evidence), F.lit(', "factors": {'), pairs, F.lit('}, "risk": '), quoted(risk), F.lit("}"))


#: Target schemas by name.
SCHEMAS = {"v1": target_list, "v2": target_map}


def true_factors(target: Column, taxonomy: list[str] = FACTORS) -> Column:
    """Factors of a rendered target of either form, in the taxonomy's order; null for other text."""
    by_map = F.from_json(F.get_json_object(target, "$.factors"), "map<string,boolean>")
    by_list = F.from_json(F.get_json_object(target, "$.factors"), "array<string>")
    is_map = F.startswith(F.get_json_object(target, "$.factors"), F.lit("{"))
    names = F.array(*map(F.lit, taxonomy))
    return F.when(is_map, F.filter(names, lambda f: F.coalesce(F.try_element_at(by_map, f), F.lit(False)))).when(by_list.isNotNull(), in_taxonomy(by_list, taxonomy))


def prompts(cases: DataFrame, neighbours: DataFrame, limit: int = REFERENCE_CLIP) -> DataFrame:
    """(case_id, prompt): numbered neighbour posts around a gap marker, then labels and length.

    ``cases``: case_id, gap, label, n_words; ``neighbours``: case_id, position, text.  A case has a handful of neighbours.
    """
    line = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), clip(F.col("text"), limit, CLIP_MARK))
    n = neighbours.join(cases.select("case_id", "gap"), "case_id").select("case_id", F.struct(F.col("position").cast("double").alias("at"), line.alias("line")).alias("x"))
    gap = cases.select("case_id", F.struct((F.col("gap") + 0.5).alias("at"), F.lit("[?]").alias("line")).alias("x"))
    body = n.union(gap).groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    return cases.join(body, "case_id").select("case_id", F.concat(F.col("body"), F.lit("\nlabel: "), F.col("label"), F.lit("\nwords: "), F.col("n_words").cast("string")).alias("prompt"))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def definition(c: Column, overrides: dict[str, str] | None = None, protective: list[str] | None = None, name: Column | None = None) -> Column:
    """A definition without its examples in brackets; overrides by ``name`` first, protective names marked."""
    t = F.regexp_replace(c, r"\s*\((?:e\.g\.|for example)[^)]*\)", "")
    of = c if name is None else name
    for k, text in (overrides or {}).items():
        t = F.when(of == k, F.lit(text)).otherwise(t)
    return F.when(of.isin(protective or []), F.concat(t, F.lit(" (protective)"))).otherwise(t)


def cases(rows: DataFrame, hosts: DataFrame, factors: list[str], n: int, seed: str, high: list[str] | None = None, fold: str = "") -> DataFrame:
    """n cases: (case_id, serial, target_factor, carrier, carrier_user, risk, factors, n_words, host, host_posts, gap).

    ``rows``: row_id, user, risk, factors, n_words of real posts; ``hosts``: user, n_posts of authors with three posts and
    more.  Factors go by turns.  A case's carrier is a row with its factor, by stable order and turn; with ``high``, the
    classes of high severity, turns alternate between rows of these and of the other classes where both exist.  Its host is
    the next author in stable order who is not the carrier's author, so an author hosts at most ceil(n / hosts) + 2 cases
    where the number of hosts allows it.  gap: after how many of the host's posts, at least one on each side.

    Every choice is a number modulo a count, so no state is carried from case to case and the cases are one join.  A factor
    that no row has, or no host, gives no case.
    """
    k = len(factors)
    named = F.array(*map(F.lit, factors))
    case = rows.sparkSession.range(n).select(F.col("id").alias("_i"), (F.col("id") / k).cast("int").alias("serial"), F.element_at(named, (F.col("id") % k + 1).cast("int")).alias("target_factor"))
    band = F.when(F.col("risk").isin(high), 0).otherwise(1) if high else F.lit(0)
    c = rows.where("risk is not null").select("row_id", "user", "risk", "factors", "n_words", band.alias("_band"), F.explode(F.array_intersect("factors", named)).alias("target_factor"))
    ranked = c.withColumn("_k", F.row_number().over(Window.partitionBy("target_factor", "_band").orderBy(stable_rank(F.lit(seed), F.lit("carrier"), F.col("row_id")), "row_id")) - 1)
    size = c.groupBy("target_factor").agg(F.count(F.when(F.col("_band") == 0, 1)).alias("_n0"), F.count(F.when(F.col("_band") == 1, 1)).alias("_n1"))
    want = F.when(F.col("_n1") == 0, 0).when(F.col("_n0") == 0, 1).otherwise(F.col("serial") % 2)
    turn = F.when((F.col("_n0") > 0) & (F.col("_n1") > 0), (F.col("serial") / 2).cast("int")).otherwise(F.col("serial"))
    j = case.join(size, "target_factor").withColumn("_band", want).withColumn("_k", turn % F.when(F.col("_band") == 0, F.col("_n0")).otherwise(F.col("_n1")))
    j = j.join(ranked, ["target_factor", "_band", "_k"]).select("_i", "serial", "target_factor", F.col("row_id").alias("carrier"), F.col("user").alias("carrier_user"), "risk", "factors", clamp(F.col("n_words"), *WORD_RANGE).alias("n_words"))
    h = numbered(hosts.where("user is not null and n_posts >= 3").select("user", "n_posts"), [stable_rank(F.lit(seed), F.lit("host"), F.col("user")), "user"], "_h")
    total = h.count()
    if not total:
        return j.select("serial", "target_factor", "carrier", "carrier_user", "risk", "factors", "n_words", F.lit("").alias("case_id"), F.lit("").alias("host"), F.lit(0).alias("host_posts"), F.lit(0).alias("gap")).where("false")
    near = j.join(h.select(F.col("user").alias("_u0"), F.col("n_posts").alias("_p0"), F.col("_h").alias("_a")), F.col("_i") % total == F.col("_a"))
    near = near.join(h.select(F.col("user").alias("_u1"), F.col("n_posts").alias("_p1"), F.col("_h").alias("_b")), (F.col("_i") + 1) % total == F.col("_b"))
    own = F.col("_u0").eqNullSafe(F.col("carrier_user"))
    d = near.withColumn("host", F.when(own, F.col("_u1")).otherwise(F.col("_u0"))).withColumn("host_posts", F.when(own, F.col("_p1")).otherwise(F.col("_p0")).cast("int")).where(~F.col("host").eqNullSafe(F.col("carrier_user")))
    gap = (F.lit(1) + stable_number(F.lit(seed), F.lit("gap"), F.col("_i").cast("string")) % (F.col("host_posts") - 1)).cast("int")
    name = F.concat(F.lit(f"K{fold}C" if fold else "C"), F.lpad((F.col("_i") + 1).cast("string"), 8, "0"))
    return d.select(name.alias("case_id"), "serial", "target_factor", "carrier", "carrier_user", "risk", "factors", "n_words", "host", "host_posts", gap.alias("gap"))
