"""How far generated rows can be told from real ones: length matching, term weights, grouped cross-validation, style."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import let, normalized, stable_rank, ws_count, ws_tokens
from quillspark.operators.metrics import rank_auc
from quillspark.sources.staging import stage


def decile_edges(df: DataFrame, value: str) -> list[float]:
    """Nine linear quantile edges of the values."""
    return df.agg(F.percentile(value, F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("e")).first()["e"] or []


def decile(c: Column, edges: list[float]) -> Column:
    """Number of edges below the value: 0 to 9."""
    return sum((F.when(c > e, 1).otherwise(0) for e in edges), F.lit(0))


def matched_reals(synthetic: DataFrame, real: DataFrame, cell: str, key: str, seed: str) -> DataFrame:
    """(key, decile, real_decile, real_key): each synthetic row with a real one of its cell and the nearest decile there.

    Both sides hold key, ``cell`` and decile; rows of one cell take its real rows by turns, in stable order.  The nearest
    decile is found on the small table of cells that exist.
    """
    have = real.select(cell, F.col("decile").alias("real_decile")).distinct()
    want = synthetic.select(cell, "decile").distinct()
    near = want.join(have, cell).groupBy(cell, "decile").agg(F.min(F.struct(F.abs(F.col("decile") - F.col("real_decile")).alias("d"), "real_decile"))["real_decile"].alias("real_decile"))
    s = synthetic.join(near, [cell, "decile"]).withColumn("_i", F.row_number().over(Window.partitionBy(cell, "real_decile").orderBy(stable_rank(F.lit(seed), F.col(key)), key)) - 1)
    w = Window.partitionBy(cell, "real_decile")
    r = real.select(F.col(key).alias("real_key"), cell, F.col("decile").alias("real_decile")).withColumn("_k", F.row_number().over(w.orderBy(stable_rank(F.lit(seed), F.col("real_key")), "real_key")) - 1)
    size = r.groupBy(cell, "real_decile").agg(F.count("*").alias("_m"))
    s = s.join(size, [cell, "real_decile"]).withColumn("_k", F.pmod(F.col("_i"), F.col("_m")))
    return s.join(r, [cell, "real_decile", "_k"]).select(key, "decile", "real_decile", "real_key")


def char_word_grams(c: Column) -> Column:
    """Words and word pairs, and runs of 2 to 5 characters within padded words."""
    return let(ws_tokens(normalized(c)), _word_grams)


def _word_grams(w: Column) -> Column:
    pairs = F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.array_join(F.slice(w, i, 2), " ")))

    def runs(x: Column, n: int) -> Column:
        padded = F.concat(F.lit(" "), x, F.lit(" "))
        some = F.transform(F.sequence(F.lit(1), F.length(x) + 3 - n), lambda i: F.concat(F.lit("#"), F.substring(padded, i, F.lit(n))))
        return F.when(F.length(x) + 2 >= n, some).otherwise(F.array().cast("array<string>"))

    inner = F.flatten(F.transform(w, lambda x: F.concat(*[runs(x, n) for n in (2, 3, 4, 5)])))
    return F.concat(w, pairs, inner)


def counted_terms(df: DataFrame, text: str, features: int = 1 << 18) -> DataFrame:
    """``df`` with tf: counts of words, pairs and character runs, hashed into ``features`` buckets."""
    d = df.withColumn("_g", char_word_grams(F.coalesce(F.col(text), F.lit(""))))
    return HashingTF(inputCol="_g", outputCol="tf", numFeatures=features).transform(d).drop("_g")


def weighted_terms(train: DataFrame) -> Transformer:
    """The weighting fitted on training rows alone: inverse document frequencies of terms in two documents and more, then
    length 1."""
    return PipelineModel([IDF(inputCol="tf", outputCol="_w", minDocFreq=2).fit(train), Normalizer(inputCol="_w", outputCol="features")])


def grouped_auc(df: DataFrame, group: str, label: str, folds: int = 5, seed: str = "folds") -> DataFrame:
    """(fold, n_pos, n_neg, auc): term weights and logistic regression fitted without the fold's groups.

    ``df`` has tf; everything that is learnt, the weights of terms included, is learnt from the other folds.  One class among
    the rows of a fold, or among those it learns from, raises.
    """
    fold = F.pmod(F.conv(F.substring(stable_rank(F.lit(seed), F.col(group).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")
    d = stage(df.select("tf", fold.alias("fold"), F.col(label).cast("double").alias("label")), "terms")
    sides = {(r["fold"], r["label"]) for r in d.select("fold", "label").distinct().collect()}
    out = None
    for k in range(folds):
        if len({y for f, y in sides if f == k}) < 2 or len({y for f, y in sides if f != k}) < 2:
            raise ValueError(f"fold {k} holds or learns from one class")
        train = d.where(F.col("fold") != k)
        weigh = weighted_terms(train)
        model = LogisticRegression(maxIter=10, regParam=1e-3).fit(weigh.transform(train))
        s = model.transform(weigh.transform(d.where(F.col("fold") == k))).select("fold", vector_to_array("probability")[1].alias("p"), (F.col("label") == 1).alias("y"))
        part = rank_auc(s, "p", "y", ["fold"])
        out = part if out is None else out.unionByName(part)
    return out


def realism_auc(made: DataFrame, real: DataFrame, features: int = 1 << 18, vectoriser: Callable[[DataFrame, str, int], DataFrame] = counted_terms) -> DataFrame:
    """(fold, n_pos, n_neg, auc) of telling written rows from real ones of the same class and nearest length decile.

    ``vectoriser``: adds tf, the counts of terms, to a frame.  Both sides: row_id, text, grp, risk.  Written rows of a class without real ones are left out.
    """
    real = real.withColumn("w", ws_count(F.col("text")))
    edges = decile_edges(real, "w")
    m = made.withColumn("decile", decile(ws_count(F.col("text")), edges))
    r = real.withColumn("decile", decile(F.col("w"), edges))
    pairs = stage(matched_reals(m.select("row_id", "risk", "decile"), r.select("row_id", "risk", "decile"), "risk", "row_id", "match"), "matched")
    pos = m.join(pairs.select("row_id"), "row_id", "left_semi").select("text", "grp", F.lit(True).alias("made"))
    neg = pairs.select(F.col("real_key").alias("row_id")).join(real, "row_id").select("text", "grp", F.lit(False).alias("made"))
    return grouped_auc(vectoriser(pos.unionByName(neg), "text", features), "grp", "made")


def style(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, upper, lone_i, emoji, comma, question, mean_words): shares of texts with each mark, rounded to 4 and 2."""
    c = F.col(text)
    share = lambda p: F.round(F.avg(c.rlike(p).cast("double")), 4)
    return df.where(c.isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), share("[A-Z]").alias("upper"), share(r"(?:^|[^A-Za-z0-9_])i(?:$|[^A-Za-z0-9_])").alias("lone_i"), share("[\\x{1F300}-\\x{1FAFF}]").alias("emoji"), share(",").alias("comma"), share("\\?").alias("question"), F.round(F.avg(ws_count(c)), 2).alias("mean_words"))


def top_openings(df: DataFrame, text: str, words: int = 3, limit: int = 10) -> DataFrame:
    """(opening, n): the most frequent first words, more than once; ties alphabetically."""
    t = let(ws_tokens(normalized(F.col(text))), lambda w: F.when(F.size(w) >= words, F.array_join(F.slice(w, 1, words), " ")))
    o = df.select(t.alias("opening")).where("opening is not null")
    return o.groupBy("opening").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "opening").limit(limit)
