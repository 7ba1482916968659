"""Screening of written text against real text, and choice among drafts.

Cheap reasons are Catalyst columns; the one quadratic measure runs in Python on the survivors only.  Null texts are empty.
"""

from __future__ import annotations

import difflib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.config import COPY_GRAM, COPY_RATIO, OVERLAP_GRAM, TOO_LONG_WORDS
from quillspark.functions.text import alpha_tokens, grams, let, near_dup_key, normalized, ws_count, ws_tokens, ws_trim
from quillspark.sources.staging import stage


#: Runs of a corpus that are broadcast: 8 bytes each.
SMALL = 500_000


def overlap(df: DataFrame, key: str, text: str, corpus: DataFrame, corpus_text: str, n: int = OVERLAP_GRAM) -> DataFrame:
    """(key): rows that share a run of n normalised tokens, or the near-duplicate key, with the corpus.

    Runs are 64-bit digests, distinct per row before they are shuffled, so a hot run costs one row per text.  Digests of a
    corpus of at most ``SMALL`` runs, which is counted first, are broadcast, and then no run of the rows is shuffled at all.
    """
    marks = lambda d, c: F.explode(F.transform(F.array_append(grams(ws_tokens(normalized(F.col(c))), n), F.concat(F.lit("key:"), near_dup_key(F.col(c)))), lambda g: F.xxhash64(g)))  # noqa: E731, ARG005
    known = corpus.where(F.col(corpus_text).isNotNull()).select(marks(corpus, corpus_text).alias("_g")).distinct()
    known = stage(known, "runs")
    known = F.broadcast(known) if known.count() <= SMALL else known
    return df.where(F.col(text).isNotNull()).select(key, marks(df, text).alias("_g")).join(known, "_g", "left_semi").select(key).distinct()


def shares_gram(a: Column, shown: Column, n: int = COPY_GRAM) -> Column:
    """Whether a text shares a run of n normalised tokens with any of the ``shown`` texts (an array); false for null."""
    g = lambda c: grams(ws_tokens(normalized(c)), n)
    return F.coalesce(let(g(a), lambda own: F.exists(shown, lambda x: F.coalesce(F.arrays_overlap(own, g(x)), F.lit(False)))), F.lit(False))


def jaccard(a: Column, b: Column, n: int = 4) -> Column:
    """Jaccard of the runs of n alphabetic tokens (curly apostrophes count as straight ones); 0 where both have none."""
    def share(x: Column, y: Column) -> Column:
        same = F.size(F.array_intersect(x, y))
        return let(F.struct(same.alias("i"), (F.size(x) + F.size(y)).alias("n")), lambda s: F.when(s["n"] > s["i"], s["i"] / (s["n"] - s["i"])).otherwise(0.0))

    return let(F.struct(gram4(a, n).alias("x"), gram4(b, n).alias("y")), lambda s: share(s["x"], s["y"]))


def gram4(c: Column, n: int = 4) -> Column:
    """Distinct runs of n alphabetic tokens."""
    return grams(alpha_tokens(F.replace(c, F.lit("’"), F.lit("'"))), n)


def sequence_ratio(a: str, b: str) -> float:
    """Twice the matching characters over the sum of lengths (recursive longest blocks)."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, shown: pd.Series) -> pd.Series:
    """The greatest sequence ratio of a text with any of the shown texts; 0 without one."""
    return pd.Series([max((sequence_ratio(x, y) for y in (ys if ys is not None else [])), default=0.0) if x is not None else 0.0 for x, ys in zip(a, shown, strict=True)], dtype="float64")


def may_reach(a: Column, b: Column, ratio: float = COPY_RATIO) -> Column:
    """Whether lengths alone allow the ratio."""
    x, y = F.length(a), F.length(b)
    return 2 * F.least(x, y) >= ratio * (x + y)


def cheap_reason(text: Column, status: Column, refusal: str, overlapping: Column, copied: Column, disclaimed: Column | None = None) -> Column:
    """The first failing reason of the cascade, in its order; null if none.

    ``disclaimed``: whether the text disclaims a plan in a case of the class where that counts.
    """
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(~F.coalesce(status == "ok", F.lit(False)), F.concat(F.lit("status:"), F.coalesce(status, F.lit("missing"))))
        .when(ws_trim(t) == "", "empty")
        .when(t.rlike(refusal), "soft_refusal")
        .when(F.coalesce(disclaimed, F.lit(False)) if disclaimed is not None else F.lit(False), "plan_disclaimer")
        .when(ws_count(t) > TOO_LONG_WORDS, "too_long")
        .when(F.coalesce(overlapping, F.lit(False)), "real_overlap")
        .when(F.coalesce(copied, F.lit(False)), "reference_copy")
    )


def screened(df: DataFrame, text: str, shown: str, reason: str, ratio: float = COPY_RATIO) -> DataFrame:
    """``df`` with the reason completed by the greatest sequence ratio with a shown text (an array), on survivors only.

    Only shown texts whose length allows the ratio are measured.
    """
    own = normalized(F.col(text))
    near = let(own, lambda t: F.filter(F.transform(F.coalesce(F.col(shown), F.array().cast("array<string>")), normalized), lambda x: F.coalesce(may_reach(t, x, ratio), F.lit(False))))
    d = df.withColumn("_near", F.when(F.col(reason).isNull() & F.col(text).isNotNull(), near))
    todo = F.coalesce(F.size("_near") > 0, F.lit(False))
    # The lists are cut from the plan: the optimizer would copy their lambdas into the arguments of the Python function.
    slow = stage(d.where(todo).withColumn("_own", own), "survivors").withColumn(reason, F.when(ratio_udf(F.col("_own"), F.col("_near")) >= ratio, "reference_copy")).drop("_own")
    return d.where(~todo).unionByName(slow).drop("_near")


class Kept:
    """The gram sets kept so far, met through an index of their grams, so that only sets with a common gram are compared."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.holders: dict[object, list[int]] = {}

    def add(self, grams: frozenset) -> None:
        for g in grams:
            self.holders.setdefault(g, []).append(len(self.sizes))
        self.sizes.append(len(grams))

    def likeness(self, grams: frozenset) -> float:
        """The greatest Jaccard with a kept set; 0 where none has a common gram."""
        shared = Counter(k for g in grams for k in self.holders.get(g, ()))
        return max((n / (len(grams) + self.sizes[k] - n) for k, n in shared.items()), default=0.0)


def pick_drafts(rows: list[tuple[str, int, list[str] | None, bool]]) -> list[tuple[str, int, int, float | None]]:
    """(case, chosen draft, passing drafts, likeness to those kept before), cases in order.

    ``rows``: case, draft, runs of the text, whether it passes.  Of the passing drafts the one least like those kept before
    is kept, ties to the lower number; a case whose drafts all fail keeps its first, without a likeness.
    """
    cases: dict[str, list[tuple[int, frozenset, bool]]] = {}
    for case, draft, runs, ok in rows:
        cases.setdefault(case, []).append((draft, frozenset(runs if runs is not None else ()), ok))
    kept = Kept()
    out = []
    for case in sorted(cases):
        drafts = sorted(cases[case], key=lambda x: x[0])
        passing = [(round(kept.likeness(g), 12), d, g) for d, g, ok in drafts if ok]
        if not passing:
            out.append((case, drafts[0][0], 0, None))
            continue
        like, draft, runs = min(passing, key=lambda x: x[:2])
        kept.add(runs)
        out.append((case, draft, len(passing), round(like, 4)))
    return out


def draft_selection(df: DataFrame, group: str) -> DataFrame:
    """(group, case_id, draft, n_passing, likeness): sequential choice within each group.

    ``df``: group, case_id, draft, text, ok.  The kept drafts of one group must be seen in order, so a group (a target
    factor) is one task, which holds hashes of word runs and no texts; the kept ones are met through an index of their runs.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = pick_drafts(list(pdf[["case_id", "draft", "runs", "ok"]].itertuples(index=False, name=None)))
        return pd.DataFrame({group: [key[0]] * len(got), **dict(zip(("case_id", "draft", "n_passing", "likeness"), map(list, zip(*got, strict=True)) if got else ([],) * 4, strict=True))})

    runs = F.transform(gram4(F.coalesce(F.col("text"), F.lit(""))), lambda g: F.xxhash64(g))
    return df.select(group, "case_id", "draft", runs.alias("runs"), "ok").groupBy(group).applyInPandas(run, f"{group} string, case_id string, draft int, n_passing int, likeness double")
