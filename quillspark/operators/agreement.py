"""Agreement of annotators.  Ratings are (item, rater, label); a null label is no rating, a repeated rating counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.metrics import phrase_f1, set_micro


def ratings(annotations: DataFrame, label: Column) -> DataFrame:
    """(case_id, annotator, label): the last complete answer of each annotator; ties by label."""
    a = annotations.where("status = 'complete' and case_id is not null and annotator is not null").select("case_id", "annotator", "submitted_at", label.alias("label"))
    return a.groupBy("case_id", "annotator").agg(F.max(F.struct("submitted_at", "label"))["label"].alias("label")).where("label is not null")


def cohen_kappa(r: DataFrame) -> DataFrame:
    """(a, b, n, agreement, kappa) of every pair of annotators with common items.

    Pairs come from the items two annotators share; an item has as many ratings as annotators.  kappa is 1 where chance
    agreement is 1 and they always agree, null where it is 1 otherwise.
    """
    x, y = r.alias("x"), r.alias("y")
    j = x.join(y, "case_id").where("x.annotator < y.annotator").select(F.col("x.annotator").alias("a"), F.col("y.annotator").alias("b"), F.col("x.label").alias("p"), F.col("y.label").alias("q"))
    cell = j.groupBy("a", "b", "p", "q").agg(F.count("*").alias("n"))
    total = cell.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p") == F.col("q"), F.col("n")).otherwise(0)).alias("same"))
    left = cell.groupBy("a", "b", F.col("p").alias("label")).agg(F.sum("n").alias("l"))
    right = cell.groupBy("a", "b", F.col("q").alias("label")).agg(F.sum("n").alias("r"))
    chance = left.join(right, ["a", "b", "label"]).groupBy("a", "b").agg(F.sum(F.col("l") * F.col("r")).alias("lr"))
    k = total.join(chance, ["a", "b"], "left").withColumn("e", F.coalesce("lr", F.lit(0)) / (F.col("n") * F.col("n"))).withColumn("o", F.col("same") / F.col("n"))
    kappa = F.when(F.col("e") < 1, (F.col("o") - F.col("e")) / (1 - F.col("e"))).when(F.col("o") == 1, 1.0)
    return k.select("a", "b", "n", F.round("o", 8).alias("agreement"), F.round(kappa, 8).alias("kappa"))


def fleiss_kappa(r: DataFrame, by: str | None = None) -> DataFrame:
    """(by, n_items, kappa): mean pairwise agreement of items with two and more ratings against squared label shares."""
    keys = [by] if by else []
    cell = r.groupBy(*keys, "case_id", "label").agg(F.count("*").alias("c"))
    item = cell.groupBy(*keys, "case_id").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("s")).where("m >= 2")
    p = item.groupBy(*keys).agg(F.count("*").alias("n_items"), F.avg(F.col("s") / (F.col("m") * (F.col("m") - 1))).alias("p"), F.sum("m").alias("total"))
    share = cell.join(item, [*keys, "case_id"], "left_semi").groupBy(*keys, "label").agg(F.sum("c").alias("n"))
    chance = share.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n")).alias("sq"))
    j = p.join(chance, keys) if keys else p.withColumn("sq", F.lit(chance.first()[0]))
    e = F.col("sq") / (F.col("total") * F.col("total"))
    return j.select(*keys, "n_items", F.round(F.when(e < 1, (F.col("p") - e) / (1 - e)), 8).alias("kappa"))


def majority(r: DataFrame, unclear: str = "Unclear") -> DataFrame:
    """(case_id, n_ratings, top_votes, risk): the label of more than half of the ratings, else unclear."""
    cell = r.groupBy("case_id", "label").agg(F.count("*").alias("c"))
    top = cell.groupBy("case_id").agg(F.sum("c").alias("n_ratings"), F.max(F.struct("c", "label")).alias("t"))
    return top.select("case_id", "n_ratings", F.col("t.c").alias("top_votes"), F.when(2 * F.col("t.c") > F.col("n_ratings"), F.col("t.label")).otherwise(unclear).alias("risk"))


def voted_items(lists: DataFrame, key: str, item: str, votes: int = 2) -> DataFrame:
    """(key, item, votes): list entries (key, rater, item) that at least ``votes`` raters gave."""
    return lists.groupBy(key, item).agg(F.count_distinct("annotator").alias("votes")).where(F.col("votes") >= votes)


def medians(annotations: DataFrame) -> DataFrame:
    """(case_id, naturalness, confidence): median naturalness and least confidence over the complete answers."""
    done = annotations.where("status = 'complete' and case_id is not null")
    return done.groupBy("case_id").agg(F.percentile("naturalness", F.lit(0.5)).alias("naturalness"), F.min("confidence").alias("confidence"))


def answers(annotations: DataFrame, risk: Column) -> DataFrame:
    """(case_id, annotator, risk, evidence, factors, issue_tags, naturalness, confidence): the last complete answer of each
    annotator to each case; ties by class name.  Null lists are unclear and stay null; a list counts each entry once."""
    a = annotations.where("status = 'complete' and case_id is not null and annotator is not null").withColumn("_r", risk)
    tidy = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))).alias(c)
    last = F.max(F.struct("submitted_at", "_r", tidy("evidence"), tidy("factors"), tidy("issue_tags"), "naturalness", "confidence")).alias("o")
    return a.groupBy("case_id", "annotator").agg(last).select("case_id", "annotator", F.col("o._r").alias("risk"), "o.evidence", "o.factors", "o.issue_tags", "o.naturalness", "o.confidence")


def answer_pairs(r: DataFrame) -> DataFrame:
    """(case_id, a, b, x, y): the answers of every two annotators of a case, a before b.  A case has as many answers as it
    has annotators, so pairs are bounded by the design of the audit."""
    body = F.struct(*[c for c in r.columns if c not in ("case_id", "annotator")])
    s = r.select("case_id", "annotator", body.alias("v"))
    j = s.alias("p").join(s.alias("q"), "case_id").where("p.annotator < q.annotator")
    return j.select("case_id", F.col("p.annotator").alias("a"), F.col("q.annotator").alias("b"), F.col("p.v").alias("x"), F.col("q.v").alias("y"))


def pairwise_sets(r: DataFrame, unclear: str = "Unclear") -> DataFrame:
    """(a, b, n_cases, risk_n, risk_exact, factor_n, factor_exact, tp, fp, fn, precision, recall, f1, naturalness_a, naturalness_b).

    Unclear classes and null factor lists are left out of their figures; figures without cases are null.
    """
    j = answer_pairs(r)
    clear = (F.col("x.risk") != unclear) & (F.col("y.risk") != unclear)
    both = F.col("x.factors").isNotNull() & F.col("y.factors").isNotNull()
    g = j.groupBy("a", "b").agg(F.count("*").alias("n_cases"), F.count(F.when(clear, 1)).alias("risk_n"), F.avg(F.when(clear, (F.col("x.risk") == F.col("y.risk")).cast("double"))).alias("risk_exact"), F.avg("x.naturalness").alias("naturalness_a"), F.avg("y.naturalness").alias("naturalness_b"))
    s = set_micro(j.where(both).select("a", "b", F.col("x.factors").alias("p"), F.col("y.factors").alias("g")), "g", "p", ["a", "b"])
    return g.join(s.withColumnRenamed("n", "factor_n").withColumnRenamed("exact", "factor_exact"), ["a", "b"], "left").withColumn("factor_n", F.coalesce("factor_n", F.lit(0)))


def pairwise_evidence(r: DataFrame) -> DataFrame:
    """(a, b, evidence_n, evidence_f1): mean phrase F1 of both directions over cases where both evidence lists are clear."""
    j = answer_pairs(r).where("x.evidence is not null and y.evidence is not null").select("a", "b", F.col("x.evidence").alias("p"), F.col("y.evidence").alias("g"))
    back = j.select("a", "b", F.col("g").alias("p"), F.col("p").alias("g"))
    return phrase_f1(j.union(back), "g", "p").groupBy("a", "b").agg((F.count("*") / 2).cast("long").alias("evidence_n"), F.avg("phrase_f1").alias("evidence_f1"))


def consensus(r: DataFrame, classes: list[str], unclear: str = "Unclear") -> DataFrame:
    """(case_id, n_answers, risk, evidence_from, evidence, factors, issue_tags, confidence, naturalness, source).

    risk: the class of at least two and of more than half of the answers, else unclear.  Factors and tags: those that more than half
    give.  Evidence: of the annotator with the majority class whose evidence has the highest mean phrase F1 with the others
    (ties to the first name); none for the lowest class.  confidence: least of the majority; naturalness: median of all.
    With an unclear class everybody counts as the majority.
    """
    votes = r.where("risk is not null").groupBy("case_id", "risk").agg(F.count("*").alias("c")).groupBy("case_id").agg(F.max(F.struct("c", "risk")).alias("t"), F.sum("c").alias("n_answers"))
    won = (F.col("t.c") >= 2) & (2 * F.col("t.c") > F.col("n_answers"))
    top = votes.select("case_id", "n_answers", F.when(won, F.col("t.risk")).otherwise(unclear).alias("_risk"), F.when(F.col("t.c") == F.col("n_answers"), "agreement").otherwise("majority").alias("source"))
    d = r.where("risk is not null").join(top, "case_id")
    many = d.groupBy("case_id").agg(F.count(F.when(F.col("risk") == F.col("_risk"), 1)).alias("_m"))
    d = d.join(many, "case_id").withColumn("_major", (F.col("_m") == 0) | (F.col("risk") == F.col("_risk")))
    pair = answer_pairs(r.where("risk is not null"))
    empty = F.array().cast("array<string>")
    one = pair.select("case_id", F.col("a").alias("annotator"), F.coalesce("x.evidence", empty).alias("p"), F.coalesce("y.evidence", empty).alias("g"))
    two = pair.select("case_id", F.col("b").alias("annotator"), F.coalesce("y.evidence", empty).alias("p"), F.coalesce("x.evidence", empty).alias("g"))
    like = phrase_f1(one.union(two), "g", "p").groupBy("case_id", "annotator").agg(F.round(F.avg("phrase_f1"), 12).alias("_like"))
    e = d.where("_major").join(like, ["case_id", "annotator"], "left").withColumn("_like", F.coalesce("_like", F.lit(0.0)))
    best = e.withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("_like"), "annotator"))).where("_r = 1").select("case_id", F.col("annotator").alias("evidence_from"), "evidence")
    least = e.groupBy("case_id").agg(F.min("confidence").alias("confidence"))
    out = d.groupBy("case_id", "n_answers", F.col("_risk").alias("risk"), "source").agg(F.percentile("naturalness", F.lit(0.5)).alias("naturalness")).join(best, "case_id").join(least, "case_id")
    for c in ("factors", "issue_tags"):
        kept = d.select("case_id", "n_answers", F.explode(c).alias("_x")).groupBy("case_id", "n_answers", "_x").agg(F.count("*").alias("_c")).where("_c >= 2 and 2 * _c > n_answers").groupBy("case_id").agg(F.array_sort(F.collect_list("_x")).alias(c))
        out = out.join(kept, "case_id", "left").withColumn(c, F.coalesce(c, empty))
    low = F.col("risk") == classes[0]
    return out.withColumn("evidence", F.when(low, empty).otherwise(F.coalesce("evidence", empty))).withColumn("evidence_from", F.when(~low, F.col("evidence_from"))).select("case_id", "n_answers", "risk", "evidence_from", "evidence", "factors", "issue_tags", "confidence", "naturalness", "source")


def fidelity(r: DataFrame, key: DataFrame, unclear: str = "Unclear") -> DataFrame:
    """(annotator, figures): each annotator's answers against the assigned labels ``key`` (case_id, risk, factors).

    n_cases, unclear_risk, unclear_factors, risk_accuracy, exact factor sets, tp, fp, fn, affirmed (share of assigned factors
    found), extra (factors not assigned, per case), naturalness, confidence, n_flagged (answers with issue tags).
    """
    j = r.join(key.select("case_id", F.col("risk").alias("_risk"), F.col("factors").alias("_factors")), "case_id")
    clear = F.col("risk") != unclear
    f = F.col("factors")
    g = j.groupBy("annotator").agg(
        F.count("*").alias("n_cases"), F.count(F.when(~F.coalesce(clear, F.lit(False)), 1)).alias("unclear_risk"), F.count(F.when(f.isNull(), 1)).alias("unclear_factors"),
        F.avg(F.when(clear, (F.col("risk") == F.col("_risk")).cast("double"))).alias("risk_accuracy"),
        F.avg(F.when(f.isNotNull(), (F.array_sort(f) == F.array_sort("_factors")).cast("double"))).alias("factor_exact"),
        F.sum(F.size(F.array_intersect(f, "_factors"))).alias("tp"), F.sum(F.size(F.array_except(f, "_factors"))).alias("fp"), F.sum(F.size(F.array_except("_factors", f))).alias("fn"),
        F.avg("naturalness").alias("naturalness"), F.avg("confidence").alias("confidence"), F.count(F.when(F.size("issue_tags") > 0, 1)).alias("n_flagged"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    g = g.withColumns({c: z(c) for c in ("tp", "fp", "fn")})
    return g.withColumn("affirmed", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("extra", F.col("fp") / F.col("n_cases"))


def factor_fidelity(r: DataFrame, key: DataFrame, taxonomy: list[str]) -> DataFrame:
    """(factor, assigned, affirmed, extra, rate): over all clear answers, how often each assigned factor is found."""
    j = r.where("factors is not null").join(key.select("case_id", F.col("factors").alias("_factors")), "case_id")
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("factor"), F.array_contains("_factors", x).alias("g"), F.array_contains("factors", x).alias("p")) for x in taxonomy]))
    s = j.select(cells.alias("c")).groupBy("c.factor").agg(F.count(F.when(F.col("c.g"), 1)).alias("assigned"), F.count(F.when(F.col("c.g") & F.col("c.p"), 1)).alias("affirmed"), F.count(F.when(~F.col("c.g") & F.col("c.p"), 1)).alias("extra"))
    return s.withColumn("rate", F.try_divide(F.col("affirmed"), F.col("assigned")))


def target_recall(rows: DataFrame, target: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by, target, n, hits, recall): how often the target factor is among the predicted ones."""
    hit = F.coalesce(F.array_contains(F.col(pred), F.col(target)), F.lit(False))
    return rows.where(F.col(target).isNotNull()).groupBy(*(by or []), target).agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("hits"), F.avg(hit.cast("double")).alias("recall"))


def shifts(rows: DataFrame, gold: str, pred: str, by: list[str] | None = None, limit: int = 8) -> DataFrame:
    """(by, gold, pred, n): the most frequent mistakes, at most ``limit`` per group; ties by name.  The limit is the feature."""
    c = rows.where(F.col(gold) != F.col(pred)).groupBy(*(by or []), gold, pred).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("n"), gold, pred)
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def pair_match_table(r: DataFrame) -> DataFrame:
    """(label, both, a_only, b_only, neither) over items rated by exactly two annotators, in order of their names."""
    w = Window.partitionBy("case_id").orderBy("annotator")
    d = r.withColumn("i", F.row_number().over(w)).withColumn("m", F.count("*").over(Window.partitionBy("case_id"))).where("m = 2")
    two = d.groupBy("case_id").agg(F.max(F.when(F.col("i") == 1, F.col("label"))).alias("x"), F.max(F.when(F.col("i") == 2, F.col("label"))).alias("y"))
    labels = r.select("label").distinct()
    hit = two.select(F.col("x").alias("label"), (F.col("x") == F.col("y")).cast("int").alias("both"), (F.col("x") != F.col("y")).cast("int").alias("a_only"), F.lit(0).alias("b_only")).union(two.where("x <> y").select("y", F.lit(0), F.lit(0), F.lit(1)))
    n = two.count()
    s = hit.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("both", "a_only", "b_only")])
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return labels.join(s, "label", "left").select("label", z("both").alias("both"), z("a_only").alias("a_only"), z("b_only").alias("b_only"), (F.lit(n) - z("both") - z("a_only") - z("b_only")).alias("neither"))
