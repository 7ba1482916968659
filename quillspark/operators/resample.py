"""Seeded sampling, bootstrap, contrasts and multiple testing.  All draws come from hashes, so any run repeats."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.config import ADOPTION, ALPHA, BOOTSTRAP_SEED, BOOTSTRAPS, CLASSES, FACTORS, RARE, WEIGHTS
from quillspark.functions.text import f1, stable_number, stable_rank
from quillspark.operators.ordering import numbered


def top_by_rank(df: DataFrame, strata: list[str], n: int, *parts: F.Column) -> DataFrame:
    """At most n rows of each stratum, by stable rank: the feature is the limit."""
    w = Window.partitionBy(*strata).orderBy("_rank")
    return df.withColumn("_rank", stable_rank(*parts)).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n).drop("_rank")


def balanced_pick(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows, round-robin over strata: strata and their rows in stable order, one of each stratum per round."""
    d = df.withColumn("_s", stable_rank(F.lit(seed), F.lit("stratum"), F.col(stratum).cast("string"))).withColumn("_k", stable_rank(F.lit(seed), F.col(key).cast("string")))
    d = d.withColumn("round", F.row_number().over(Window.partitionBy(stratum).orderBy("_k", key)))
    return d.where(F.col("round") <= n).orderBy("round", "_s", "_k").limit(n).drop("_s", "_k")


def subset(df: DataFrame, key: str, target: str, is_target: str, stratum: str, per_target: int, others: int, seed: str) -> DataFrame:
    """(key, part): ``per_target`` rows of each target factor, balanced over strata, and ``others`` rows that are no target,
    balanced over target factor and stratum.  ``is_target`` marks rows that hold their target factor.

    Rounds of a factor are numbered within it, so all factors are picked in one window each and not one after the other.
    """
    rank = stable_rank(F.lit(seed), F.col(key).cast("string"))
    hit = df.where(F.col(is_target)).withColumn("_k", rank).withColumn("_s", stable_rank(F.lit(seed), F.lit("stratum"), F.col(target), F.col(stratum)))
    hit = hit.withColumn("_round", F.row_number().over(Window.partitionBy(target, stratum).orderBy("_k", key))).where(F.col("_round") <= per_target)
    first = hit.withColumn("_i", F.row_number().over(Window.partitionBy(target).orderBy("_round", "_s"))).where(F.col("_i") <= per_target).select(key, F.lit("target").alias("part"))
    rest = balanced_pick(df.where(~F.coalesce(F.col(is_target), F.lit(False))).select(key, F.concat_ws("/", target, stratum).alias("_cell")), "_cell", key, others, seed)
    return first.union(rest.select(key, F.lit("other")))


def largest_remainder(counts: DataFrame, group: str, count: str, n: int) -> DataFrame:
    """(group, count, quota): n seats in proportion to the counts; whole parts, then the largest remainders, ties by group."""
    d = counts.withColumn("_t", F.sum(count).over(Window.partitionBy(F.lit(0))))
    whole = F.floor(F.lit(n) * F.col(count) / F.col("_t"))
    d = d.withColumn("_w", whole).withColumn("_rest", F.lit(n) * F.col(count) - F.col("_w") * F.col("_t"))
    left = F.lit(n) - F.sum("_w").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), group))
    return d.select(group, count, (F.col("_w") + (place <= left).cast("long")).alias("quota"))


def quota_rows(df: DataFrame, key: str, group: str, factors: list[str], seats: int, seed: str) -> list[dict]:
    """The rows (key, group, factors) that :func:`quota_pick` over all rows can choose, in stable order.

    A group has at most ``seats`` seats in all, so of its rows, and of those with one factor, only the first ``seats``
    can be chosen: before a later one is, the seats are used up.
    """
    cells = F.explode(F.array_union(F.array(F.lit("")), F.array_intersect(F.coalesce("factors", F.array().cast("array<string>")), F.array(*map(F.lit, factors)))))
    order = stable_rank(F.lit(seed), F.col(key))
    top = top_by_rank(df.select(key, group, "factors", cells.alias("_cell")), [group, "_cell"], seats, F.lit(seed), F.col(key))
    return [r.asDict() for r in top.select(key, group, "factors", order.alias("_order")).dropDuplicates([key]).orderBy("_order").drop("_order").collect()]


def quota_pick(rows: list[dict], group: str, factors: list[str], quota: dict[str, int], per_factor: int) -> list[dict]:
    """Rows chosen factor by factor under shared quotas per group, in the given order, then filled up.

    Sequential by nature; :func:`quota_rows` brings the rows of a large table that matter.
    """
    left = dict(quota)
    chosen: dict[int, dict] = {}
    for f in factors:
        got = 0
        for i, r in enumerate(rows):
            if got < per_factor and i not in chosen and f in (r["factors"] or []) and left.get(r[group], 0) > 0:
                chosen[i] = r
                left[r[group]] -= 1
                got += 1
    for i, r in enumerate(rows):
        if i not in chosen and left.get(r[group], 0) > 0:
            chosen[i] = r
            left[r[group]] -= 1
    return [chosen[i] for i in sorted(chosen)]


def upsample(df: DataFrame, key: str, target: int, seed: str) -> DataFrame:
    """``df`` with copy: every row floor(target / n) times, and the first rows by stable rank once more, target rows in all."""
    n = df.count()
    if n == 0:
        return df.withColumn("copy", F.lit(0))
    whole, rest = divmod(target, n)
    d = numbered(df, [stable_rank(F.lit(seed), F.col(key).cast("string")), key], "_i").withColumn("_n", F.lit(whole) + (F.col("_i") < rest).cast("int")).where("_n > 0")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_i")


def reweight(df: DataFrame, items: str, rare: list[str], factor: float = 3.0) -> DataFrame:
    """``df`` with weight: the factor for rows with any rare item, else 1."""
    hit = F.coalesce(F.arrays_overlap(F.col(items), F.array(*map(F.lit, rare))), F.lit(False))
    return df.withColumn("weight", F.when(hit, factor).otherwise(1.0))


def epoch_order(df: DataFrame, key: str, seed: str, epochs: int) -> DataFrame:
    """(key, epoch, position): a seeded order of all rows in each epoch."""
    d = df.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    n = df.count()
    rank = stable_rank(F.lit(seed), F.col("epoch").cast("string"), F.col(key).cast("string"))
    return numbered(d, ["epoch", rank, key], "_i").select(key, "epoch", (F.col("_i") - F.col("epoch") * n).cast("int").alias("position"))


def draws(spark: SparkSession, units: list, b: int = BOOTSTRAPS, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(b, unit, mult): how often each of the units falls into each bootstrap draw; units with zero are left out.

    One generator draws all, as it must for a pinned seed; units are clusters such as persons, given in order.
    """
    rng = np.random.default_rng(seed)
    out = []
    for i in range(b):
        at, n = np.unique(rng.integers(0, len(units), len(units)), return_counts=True)
        out += [(i, units[j], int(k)) for j, k in zip(at, n, strict=True)]
    return spark.createDataFrame(out, "b int, unit string, mult int")


def pinned_bootstrap(stats: DataFrame, unit: str, sums: list[str], b: int = BOOTSTRAPS, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(b, sums): as :func:`bootstrap` over :func:`draws`, for many units.

    One generator draws all, so it is one task, which holds the units but never the pairs of units and draws.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(unit)
        rng, x = np.random.default_rng(seed), pdf[sums].to_numpy(np.int64)
        out = [np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)) @ x for _ in range(b)]
        return pd.DataFrame(out, columns=sums).assign(b=range(b))[["b", *sums]]

    return stats.where(F.col(unit).isNotNull()).select(unit, *sums).groupBy().applyInPandas(run, ", ".join(["b int", *(f"{c} long" for c in sums)]))


#: Least 32-bit numbers at which a Poisson(1) draw is one more than 0, 1, 2, ...
CUTS: list[int] = []
_total, _p = Fraction(0), Fraction(1)
for _k in range(12):
    _total += _p
    _p /= _k + 1
    CUTS.append(int(_total * (1 << 32) / Fraction(2718281828459045, 10**15)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A scramble of 32-bit numbers, the same in every engine: shifts and products modulo 2^32."""
    x = x & np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x21F0AAAD)) & np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x735A2D97)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(15))


def replicates(stats: DataFrame, unit: str, sums: list[str], b: int = BOOTSTRAPS, seed: str = "boot") -> DataFrame:
    """(b, sums): sums of per-unit sufficient statistics under Poisson(1) multiplicities, for any number of units.

    The multiplicity of a unit in a draw comes from a hash of both, so every contrast uses the same draws.  Each task adds up
    its units for all draws as a matrix product and hands on one row per draw: units never meet draws as rows.  Null units
    are left out; sums are doubles.
    """
    base = stats.where(F.col(unit).isNotNull()).select(stable_number(F.lit(seed), F.col(unit).cast("string")).alias("_u"), *[F.col(c).cast("double").alias(c) for c in sums])

    def run(batches):  # noqa: ANN001, ANN202
        total, seen = np.zeros((b, len(sums))), False
        step = mixed(np.arange(b, dtype=np.uint64) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF))
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                u = part["_u"].to_numpy(np.uint64)
                at = mixed((u[None, :] + step[:, None]) & np.uint64(0xFFFFFFFF))
                total += np.searchsorted(np.array(CUTS, np.uint64), at, "right").astype(np.float64) @ part[sums].to_numpy(np.float64)
                seen = True
        if seen:
            yield pd.DataFrame(total, columns=sums).assign(b=np.arange(b))[["b", *sums]]

    part = base.mapInPandas(run, ", ".join(["b int", *(f"{c} double" for c in sums)]))
    return part.groupBy("b").agg(*[F.sum(c).alias(c) for c in sums])


def bootstrap(stats: DataFrame, draw: DataFrame, unit: str, sums: list[str]) -> DataFrame:
    """(b, sums): per-unit sufficient statistics summed with their multiplicities; records never meet the draws."""
    return draw.join(stats, unit).groupBy("b").agg(*[F.sum(F.col("mult") * F.col(c)).alias(c) for c in sums])


STATS = ["n", *[f"c{g}{p}" for g in range(len(CLASSES)) for p in range(len(CLASSES))], *[f"{k}{i}" for i in range(len(FACTORS)) for k in ("tp", "fp", "fn")]]


def sufficient(df: DataFrame, unit: str, gold: str, pred: str, gold_factors: str, pred_factors: str) -> DataFrame:
    """(unit, :data:`STATS`): counts of which all class and factor scores are made; a null class is in no cell of them."""
    cells = [F.count(F.when((F.col(gold) == a) & (F.col(pred) == b), 1)).alias(f"c{i}{j}") for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)]
    for i, f in enumerate(FACTORS):
        g, p = (F.coalesce(F.array_contains(F.col(c), f), F.lit(False)) for c in (gold_factors, pred_factors))
        cells += [F.count(F.when(x, 1)).alias(f"{k}{i}") for k, x in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p))]
    return df.groupBy(F.col(unit).alias("unit")).agg(F.count("*").alias("n"), *cells)


def scores(sums: DataFrame) -> DataFrame:
    """``sums`` of :data:`STATS` with risk_wf1, factors_macro_f1, rare_f1, other_f1 and no_evidence, other columns kept."""
    k = range(len(CLASSES))
    support = [sum((F.col(f"c{i}{j}") for j in k), F.lit(0.0)) for i in k]
    called = [sum((F.col(f"c{i}{j}") for i in k), F.lit(0.0)) for j in k]
    own = [f1(F.col(f"c{i}{i}"), called[i] - F.col(f"c{i}{i}"), support[i] - F.col(f"c{i}{i}")) for i in k]
    total = sum(support, F.lit(0.0))
    risk = F.when(total > 0, sum((s * f for s, f in zip(support, own, strict=True)), F.lit(0.0)) / total).otherwise(0.0)
    per = {f: f1(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")) for i, f in enumerate(FACTORS)}
    mean = lambda names: sum((per[f] for f in names), F.lit(0.0)) / len(names)
    a, _, c = WEIGHTS
    d = sums.withColumns({"risk_wf1": risk, "factors_macro_f1": mean(FACTORS), "rare_f1": mean(RARE), "other_f1": mean([f for f in FACTORS if f not in RARE])})
    return d.withColumn("no_evidence", (a * F.col("risk_wf1") + c * F.col("factors_macro_f1")) / (a + c)).drop(*STATS)


SCORES = ["risk_wf1", "factors_macro_f1", "rare_f1", "other_f1", "no_evidence"]


def long_scores(df: DataFrame, keep: list[str], names: list[str] = SCORES) -> DataFrame:
    """(keep, metric, value)."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in names])).alias("x")).select(*keep, "x.*")


def summarize(replicates: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, mean, low, high, positive, p): 2.5 and 97.5 percentiles (linear), share above 0, two-sided p."""
    v = F.col(value)
    share = lambda c: F.avg(c.cast("double"))
    return replicates.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.025)).alias("low"), F.percentile(v, F.lit(0.975)).alias("high"), share(v > 0).alias("positive"), F.least(F.lit(1.0), 2 * F.least(share(v <= 0), share(v >= 0))).alias("p"))


def holm(df: DataFrame, name: str, p: str, alpha: float = ALPHA) -> DataFrame:
    """``df`` with place, bound and rejected: step-down, none after the first failure; ties by name."""
    one = Window.partitionBy(F.lit(0))
    d = df.withColumn("place", F.row_number().over(one.orderBy(p, name)) - 1).withColumn("_m", F.count("*").over(one))
    d = d.withColumn("bound", F.lit(alpha) / (F.col("_m") - F.col("place"))).withColumn("_ok", (F.col(p) <= F.col("bound")).cast("int"))
    return d.withColumn("rejected", F.min("_ok").over(one.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_m", "_ok")


def contrast(replicates: DataFrame, arm: str, treated: str, reference: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(b, by, delta): treated minus reference in each replicate, which both share."""
    keys = ["b", *(by or [])]
    t = replicates.where(F.col(arm) == treated).select(*keys, F.col(value).alias("_t"))
    r = replicates.where(F.col(arm) == reference).select(*keys, F.col(value).alias("_r"))
    return t.join(r, keys).select(*keys, (F.col("_t") - F.col("_r")).alias("delta"))


def adoption(replicates: DataFrame, arm: str, treated: list[str], base: str, control: str, value: str, bar: float = ADOPTION) -> DataFrame:
    """(arm, delta_base, delta_control, adopt): mean gains of each treated arm; adopted with at least ``bar`` over the base and
    any gain over the control."""
    m = replicates.groupBy(arm).agg(F.avg(value).alias("_m"))
    one = lambda name: m.where(F.col(arm) == name).select(F.col("_m").alias(f"_{name}"))
    j = m.where(F.col(arm).isin(treated)).crossJoin(F.broadcast(one(base))).crossJoin(F.broadcast(one(control)))  # one row each
    d = j.select(arm, (F.col("_m") - F.col(f"_{base}")).alias("delta_base"), (F.col("_m") - F.col(f"_{control}")).alias("delta_control"))
    return d.withColumn("adopt", (F.col("delta_base") >= bar) & (F.col("delta_control") > 0))
