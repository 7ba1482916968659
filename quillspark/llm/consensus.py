"""Problem 1: consensus from several annotators' labels, by a mean-field variational confusion model.

Every annotator has a confusion row per true class with a Dirichlet prior, the class shares have one too.  The posterior
of a case is proportional to exp(E[log share] + sum over its answers of E[log confusion]); the expectations are digammas
of the Dirichlet counts, and both steps are group-bys over the answers.  Annotators are never collected.

Usable answers: complete ones with one of the four classes, in any spelling.  The last complete answer of an annotator to
a case holds; if it is not usable, the annotator has none.  Defined results: null cases, annotators or dates (oldest) are
handled as no case, no annotator and first; cases without a usable answer have no class; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.sources.staging import stage

CLASSES = ["Indicator", "Ideation", "Behavior", "Attempt"]
#: Prior counts: of each class, and of an annotator's answer at a distance of 0, 1, 2, 3 classes from the true one.
SHARE_PRIOR, ANSWER_PRIOR = 1.0, [4.0, 1.0, 0.6, 0.4]
ROUNDS, STILL = 25, 1e-3


def digamma(x: Column) -> Column:
    """The digamma function of a positive column: recurrence up to six and more, then the asymptotic series."""
    y = x + 6
    low = sum((1 / (x + i) for i in range(6)), F.lit(0.0))
    z = 1 / (y * y)
    return F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - low


def digamma_of(x: float) -> float:
    """:func:`digamma` of a number."""
    low = sum(1 / (x + i) for i in range(6))
    y = x + 6
    z = 1 / (y * y)
    return math.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - low


def answers(annotations: DataFrame) -> DataFrame:
    """(case_id, annotator, batch_id, label): the usable answers, label from 0 to 3."""
    a = annotations.where("case_id is not null and annotator is not null and lower(trim(status)) = 'complete'")
    order = F.struct(F.coalesce("submitted_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), F.coalesce("risk", F.lit("")).alias("risk"), "batch_id")
    last = a.groupBy("case_id", F.lower(F.trim("annotator")).alias("annotator")).agg(F.max(order).alias("o"))
    word = F.initcap(F.regexp_replace("o.risk", "[^\\p{L}]+", ""))
    label = F.array_position(F.array(*map(F.lit, CLASSES)), word) - 1
    return last.select("case_id", "annotator", "o.batch_id", label.cast("int").alias("label")).where("label >= 0")


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs)
    parts = [F.exp(x - top) for x in logs]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def fit(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posterior per case: case_id, q0..q3; confusion per annotator and answer: annotator, label, n0..n3), staged."""
    k = range(len(CLASSES))
    # Start: the share of each class among the answers of the case.
    case = Window.partitionBy("case_id")
    base = stage(usable.select("case_id", "annotator", "label").withColumn("w", 1 / F.count("*").over(case)), "answers")
    q = stage(base.groupBy("case_id").agg(*[F.avg((F.col("label") == c).cast("double")).alias(f"q{c}") for c in k]), "posterior")
    n = None
    for _ in range(ROUNDS):
        held = base.join(q, "case_id")
        n = stage(held.groupBy("annotator", "label").agg(*[F.sum(f"q{c}").alias(f"n{c}") for c in k], *[F.sum(F.col("w") * F.col(f"q{c}")).alias(f"s{c}") for c in k]), "confusion")
        prior = [F.element_at(F.array(*map(F.lit, ANSWER_PRIOR)), F.abs(F.col("label") - c).cast("int") + 1) for c in k]
        of = Window.partitionBy("annotator")
        rows = [sum(ANSWER_PRIOR[abs(c - x)] for x in k) for c in k]
        e = n.select("annotator", "label", *[(digamma(F.col(f"n{c}") + prior[c]) - digamma(F.sum(f"n{c}").over(of) + F.lit(rows[c]))).alias(f"e{c}") for c in k])
        shares = n.agg(*[(F.sum(f"s{c}") + SHARE_PRIOR).alias(f"t{c}") for c in k]).first()
        if shares[0] is None:
            break
        whole = digamma_of(sum(shares))
        log_share = [digamma_of(x) - whole for x in shares]
        sums = base.join(e, ["annotator", "label"]).groupBy("case_id").agg(*[(F.sum(f"e{c}") + log_share[c]).alias(f"l{c}") for c in k])
        now = stage(sums.select("case_id", *[x.alias(f"q{c}") for c, x in zip(k, _softmax([F.col(f"l{c}") for c in k]), strict=True)]), "posterior")
        moved = now.alias("x").join(q.alias("y"), "case_id").agg(F.max(F.greatest(*[F.abs(F.col(f"x.q{c}") - F.col(f"y.q{c}")) for c in k]))).first()[0]
        q = now
        if moved is None or moved < STILL:
            break
    return q, n


def consensus(annotations: DataFrame) -> DataFrame:
    """(case_id, risk): the class of highest posterior; a tie goes to the higher class."""
    q, _ = fit(answers(annotations))
    best = F.greatest(*[F.struct(F.col(f"q{c}").alias("p"), F.lit(c).alias("c")) for c in range(len(CLASSES))])
    return q.select("case_id", F.element_at(F.array(*map(F.lit, CLASSES)), best["c"] + 1).alias("risk"))


def reliability(annotations: DataFrame) -> DataFrame:
    """(annotator, n_answers, reliability, low, high): expected share of right answers with its 95 % posterior interval.

    Mean and variance are those of the Dirichlet rows, weighted by the shares of the true classes.
    """
    k = range(len(CLASSES))
    _, n = fit(answers(annotations))
    total = n.agg(*[F.sum(f"s{c}") for c in k]).first()
    sums = n.groupBy("annotator").agg(F.sum(sum((F.col(f"n{c}") for c in k), F.lit(0.0))).alias("n"), *[F.sum(f"n{c}").alias(f"all{c}") for c in k], *[F.sum(F.when(F.col("label") == c, F.col(f"n{c}")).otherwise(0.0)).alias(f"own{c}") for c in k])
    whole = sum(x or 0.0 for x in total) or 1.0
    mean = variance = F.lit(0.0)
    for c in k:
        a, b = F.col(f"own{c}") + ANSWER_PRIOR[0], F.col(f"all{c}") + sum(ANSWER_PRIOR[abs(c - x)] for x in k)
        share = (total[c] or 0.0) / whole
        mean = mean + share * a / b
        variance = variance + share * share * a * (b - a) / (b * b * (b + 1))
    spread = 1.96 * F.sqrt(variance)
    return sums.select("annotator", F.round("n").cast("long").alias("n_answers"), F.round(mean, 6).alias("reliability"), F.round(F.greatest(F.lit(0.0), mean - spread), 6).alias("low"), F.round(F.least(F.lit(1.0), mean + spread), 6).alias("high"))


def agreement(annotations: DataFrame) -> DataFrame:
    """(batch_id, n_cases, risk_exact_agreement, risk_fleiss_kappa, risk_alpha, majority_cases) per batch.

    Over cases with two and more usable answers: share of unanimous cases, Fleiss' kappa (mean pairwise agreement of the
    cases against the squared class shares), Krippendorff's nominal alpha; and the cases without unanimity, sorted.
    Undefined figures (no such case, one class only) are null.
    """
    k = range(len(CLASSES))
    case = answers(annotations).groupBy("batch_id", "case_id").agg(F.count("*").alias("m"), *[F.count(F.when(F.col("label") == c, 1)).alias(f"c{c}") for c in k])
    pair = sum((F.col(f"c{c}") * (F.col(f"c{c}") - 1) for c in k), F.lit(0))
    two = F.col("m") >= 2
    agree = F.when(two, pair / (F.col("m") * (F.col("m") - 1)))
    g = case.withColumn("agree", agree).groupBy("batch_id").agg(
        F.count("*").alias("n_cases"),
        F.round(F.avg((F.col("agree") == 1).cast("double")), 6).alias("risk_exact_agreement"),
        F.avg("agree").alias("p"),
        F.sum(F.when(two, pair / (F.col("m") - 1))).alias("same"),
        F.sum(F.when(two, F.col("m"))).alias("total"),
        *[F.sum(F.when(two, F.col(f"c{c}"))).alias(f"t{c}") for c in k],
        F.array_sort(F.collect_list(F.when(F.col("agree") < 1, F.col("case_id")))).alias("majority_cases"),
    )
    chance = sum(((F.col(f"t{c}") / F.col("total")) ** 2 for c in k), F.lit(0.0))
    off = 1 - sum((F.col(f"t{c}") * (F.col(f"t{c}") - 1) for c in k), F.lit(0)) / (F.col("total") * (F.col("total") - 1))
    kappa = F.when(chance < 1, (F.col("p") - chance) / (1 - chance))
    alpha = F.when(off > 0, 1 - (1 - F.col("same") / F.col("total")) / off)
    return g.select("batch_id", "n_cases", "risk_exact_agreement", F.round(kappa, 6).alias("risk_fleiss_kappa"), F.round(alpha, 6).alias("risk_alpha"), "majority_cases")
