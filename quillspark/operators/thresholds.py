"""Cutoffs fitted on other folds, checkpoint choice and merging of two runs.  Null scores or labels are left out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.config import BOOTSTRAP_SEED
from quillspark.functions.text import f1


def best_cutoffs(df: DataFrame, by: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """(by, tau, f1): best F1 of predicting score >= tau; candidates 0, 1 and midpoints of distinct scores; ties to the
    largest; 0.5 without positives.

    Distinct scores are counted first, so the sweep is one sort per group over counts: no row meets every candidate.
    ``weight``: how many rows a row stands for.
    """
    n = F.col(weight) if weight else F.lit(1)
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label), n).otherwise(0)).alias("_p"), F.sum(n).alias("_n"))
    up = Window.partitionBy(*by).orderBy("_s")
    down = Window.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    d = per.withColumns({"_tp": F.sum("_p").over(down), "_k": F.sum("_n").over(down), "_total": F.sum("_p").over(whole), "_low": F.lag("_s").over(up), "_high": F.lead("_s").over(up)})
    at = F.when(F.col("_low").isNull(), F.lit(0.0)).otherwise((F.col("_low") + F.col("_s")) / 2)
    one = F.col("_s") >= 1.0
    ends = F.struct(F.when(F.col("_high").isNull(), F.lit(1.0)).alias("tau"), F.when(one, F.col("_p")).otherwise(0).alias("tp"), F.when(one, F.col("_n")).otherwise(0).alias("k"))
    cand = d.select(*by, "_total", F.explode(F.array(F.struct(at.alias("tau"), F.col("_tp").alias("tp"), F.col("_k").alias("k")), ends)).alias("_c")).where("_c.tau is not null")
    score_of = F.round(f1(F.col("_c.tp"), F.col("_c.k") - F.col("_c.tp"), F.col("_total") - F.col("_c.tp")), 12)
    best = cand.groupBy(*by).agg(F.max(F.struct(score_of.alias("f1"), F.col("_c.tau").alias("tau"))).alias("_b"), F.max("_total").alias("_total"))
    none = F.col("_total") == 0
    return best.select(*by, F.when(none, 0.5).otherwise(F.col("_b.tau")).alias("tau"), F.when(none, 0.0).otherwise(F.col("_b.f1")).alias("f1"))


def _others(per: DataFrame, fold: str) -> DataFrame:
    """Counted rows with held_out: each fold but their own.  The folds go along as a list, bounded by the number of folds."""
    folds = per.agg(F.array_sort(F.collect_set(fold)).alias("_folds"))
    j = per.crossJoin(F.broadcast(folds))  # one row
    return j.withColumn("held_out", F.explode(F.filter("_folds", lambda k: k != F.col(fold)))).drop("_folds")


def nested_cutoffs(df: DataFrame, fold: str, by: list[str], score: str, label: str) -> DataFrame:
    """(held_out, by, tau, f1): cutoffs of each fold fitted on the rows of all other folds.  Rows meet folds as counts."""
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(fold).isNotNull()).groupBy(fold, *by, score, label).agg(F.count("*").alias("_n"))
    return best_cutoffs(_others(per, fold), ["held_out", *by], score, label, "_n")


def apply_cutoffs(df: DataFrame, cutoffs: DataFrame, fold: str, by: list[str], score: str) -> DataFrame:
    """``df`` with pred = score >= the cutoff of its own fold."""
    c = cutoffs.select(F.col("held_out").alias(fold), *by, "tau")
    return df.join(c, [fold, *by]).withColumn("pred", F.col(score) >= F.col("tau"))


def bagged_cutoffs(df: DataFrame, fold: str, by: str, score: str, label: str, bags: int = 200, seed: int = BOOTSTRAP_SEED, order: list[str] | None = None) -> DataFrame:
    """(held_out, by, tau): mean cutoff over bootstrap resamples of the other folds, seeded per fold and place in ``order``.

    A resample of n rows is a multinomial draw over the distinct scores, so a task holds counts and never rows.  Resamples
    without positives have no cutoff and are left out; 0.5 where no row is positive.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & F.col(fold).isNotNull()).groupBy(F.col(fold).cast("int").alias("_f"), F.col(by).alias("item"), F.col(score).cast("double").alias("s")).agg(F.count(F.when(F.col(label), 1)).alias("p"), F.count("*").alias("n"))
    place = {x: i for i, x in enumerate(order or [])}

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.groupby("s", as_index=False)[["p", "n"]].sum().sort_values("s")
        u, p, n = own["s"].to_numpy(), own["p"].to_numpy(), own["n"].to_numpy()
        total, taus = n.sum(), []
        rng = np.random.default_rng([seed, int(key[0]) + 1, place.get(key[1], len(place))])
        cells = np.concatenate([p, n - p])
        for _ in range(bags if p.any() else 0):
            drawn = rng.multinomial(total, cells / total)
            pos = drawn[: len(u)]
            if pos.any():
                taus.append(counted_cutoff(u, pos + drawn[len(u) :], pos))
        return pd.DataFrame({"held_out": [key[0]], "item": [key[1]], "tau": [float(np.mean(taus)) if taus else counted_cutoff(u, n, p) if p.any() else 0.5]})

    return _others(per, "_f").groupBy("held_out", "item").applyInPandas(fit, "held_out int, item string, tau double").withColumnRenamed("item", by)


def cutoff(s: np.ndarray, y: np.ndarray) -> float:
    """The best cutoff of one sample, by the rule of :func:`best_cutoffs`."""
    if not y.any():
        return 0.5
    u = np.unique(s)
    cand = np.unique(np.concatenate([[0.0, 1.0], (u[1:] + u[:-1]) / 2]))
    order = np.sort(s)
    pos = np.sort(s[y])
    tp = len(pos) - np.searchsorted(pos, cand, "left")
    k = len(order) - np.searchsorted(order, cand, "left")
    score = np.where(k + len(pos) > 0, 2 * tp / np.maximum(k + len(pos), 1), 0.0)
    return float(cand[np.flatnonzero(np.isclose(score, score.max(), atol=1e-12))[-1]])


def counted_cutoff(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> float:
    """:func:`cutoff` of a sample given as its rows ``n`` and positives ``p`` at each of the rising scores ``u``."""
    there = n > 0
    u, n, p = u[there], n[there], p[there]
    cand = np.unique(np.concatenate([[0.0, 1.0], (u[1:] + u[:-1]) / 2]))
    first = np.searchsorted(u, cand, "left")
    above = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])[first]
    tp, k, total = above(p), above(n), p.sum()
    score = np.where(k + total > 0, 2 * tp / np.maximum(k + total, 1), 0.0)
    return float(cand[np.flatnonzero(np.isclose(score, score.max(), atol=1e-12))[-1]])


def nested_checkpoint(metrics: DataFrame, fold: str, step: str, value: str) -> DataFrame:
    """(fold, step, mean_others): per fold the step with the best mean over the other folds; ties to the first step."""
    m = metrics.groupBy(fold, step).agg(F.avg(value).alias("v"))
    other = m.select(F.col(fold).alias("_o"), step, "v")
    folds = m.select(fold).distinct()
    mean = folds.join(other, F.col(fold) != F.col("_o")).groupBy(fold, step).agg(F.round(F.avg("v"), 10).alias("mean_others"))
    w = Window.partitionBy(fold).orderBy(F.desc("mean_others"), step)
    return mean.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def selected_steps(metrics: DataFrame, fold: str, step: str, value: str) -> DataFrame:
    """(fold, step, value): the first step with the best value of each fold."""
    m = metrics.groupBy(fold, step).agg(F.round(F.avg(value), 10).alias("value"))
    return m.groupBy(fold).agg(F.max(F.struct("value", (-F.col(step)).alias("_s"))).alias("_b")).select(fold, (-F.col("_b._s")).alias(step), F.col("_b.value").alias("value"))


def class_probabilities(logprobs: F.Column, classes: list[str], risk: F.Column | None = None) -> F.Column:
    """Array of class probabilities from (token, logprob) pairs of the first step.

    A token, without blanks and a quote before it, counts for the only class that it begins or that begins it.  Where nothing
    counts, all of it goes to ``risk`` (none: all zero).
    """
    def of(c: str) -> F.Column:
        def own(x: F.Column) -> F.Column:
            t = F.regexp_replace(F.regexp_replace(x["tok"], r"^\s+", ""), '^"', "")
            fits = [F.startswith(F.lit(k), t) | F.startswith(t, F.lit(k)) for k in classes]
            unique = sum((f.cast("int") for f in fits), F.lit(0)) == 1
            return (t != "") & fits[classes.index(c)] & unique

        return F.aggregate(F.filter(F.coalesce(logprobs, F.array().cast("array<struct<tok:string,lp:double>>")), own), F.lit(0.0), lambda s, x: s + F.exp(x["lp"]))

    mass = [of(c) for c in classes]
    total = sum(mass[1:], mass[0])
    other = lambda c: F.when(risk == c, 1.0).otherwise(0.0) if risk is not None else F.lit(0.0)
    return F.array(*[F.when(total > 0, m / total).otherwise(other(c)) for m, c in zip(mass, classes, strict=True)])


def merge_runs(a: DataFrame, b: DataFrame, key: str, classes: list[str]) -> DataFrame:
    """Two runs (key, probs, spans, risk) as one: mean probabilities, the first largest class, spans of A, else of B.

    A row that only one run has is taken from it.  The lowest class keeps no spans; a class above it for which neither
    run has spans falls back to A's class.
    """
    j = a.select(key, F.struct(*[c for c in a.columns if c != key]).alias("x")).join(b.select(key, F.struct(*[c for c in b.columns if c != key]).alias("y")), key, "full")
    probs = F.when(F.col("x").isNull(), F.col("y.probs")).when(F.col("y").isNull(), F.col("x.probs")).otherwise(F.zip_with("x.probs", "y.probs", lambda p, q: (p + q) / 2))
    named = F.array(*map(F.lit, classes))
    risk = F.element_at(named, F.array_position(F.col("probs"), F.array_max("probs")).cast("int"))
    full = lambda s: F.when(F.size(s) > 0, F.col(s))
    spans = F.coalesce(full("x.spans"), full("y.spans"), F.array().cast("array<string>"))
    d = j.withColumn("probs", probs).withColumn("risk", risk).withColumn("spans", spans)
    back = (F.col("risk") != classes[0]) & (F.size("spans") == 0)
    d = d.withColumn("risk", F.when(back, F.coalesce("x.risk", "y.risk", "risk")).otherwise(F.col("risk")))
    return d.select(key, "risk", F.when(F.col("risk") == classes[0], F.array().cast("array<string>")).otherwise(F.col("spans")).alias("spans"), "probs")


#: How cutoffs are fitted, by name: (frame, fold, item, score, label) to (held_out, item, tau).  A project adds its own.
FITTERS = {"argmax": lambda df, fold, by, score, label: nested_cutoffs(df, fold, [by], score, label), "bagged": bagged_cutoffs}


def fitted(df: DataFrame, fold: str, by: str, score: str, label: str, fitter: str = "argmax") -> DataFrame:
    """``df`` with pred by the cutoffs that the named fitter finds on the other folds."""
    return apply_cutoffs(df, FITTERS[fitter](df, fold, by, score, label), fold, [by], score)
