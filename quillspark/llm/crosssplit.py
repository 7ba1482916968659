"""Problem 4: same or near-same records across splits.

Aho-Corasick automata over the normalised passages (runs of five words) of the evaluation records scan the training texts;
matched intervals are merged into the covered share of every evaluation record, per training record.

The automata are sharded: a shard holds up to ``BLOCK`` evaluation records.  Every training text scans the shards that hold
an evaluation record with which it has enough word runs in common (:func:`neardup.near`, which loses no pair), and there meets
all the records of the shard.  A shard with many training texts is salted, and one with many evaluation records is cut into
blocks, so no automaton or task grows with it.  The pairs themselves come from the automata; a check of the whole texts of
both follows.

Defined results: null or wordless texts are the same as nothing; a record delivered twice is one; rows of other splits
are left out; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import neardup
from quillspark.llm.ids import slug
from quillspark.llm.words import overlap, words
from quillspark.sources.staging import release, stage

#: Evaluation classes and training classes of one shard of a cluster.
BLOCK, SALT = 400, 4000


def automaton(passages: dict[int, list[str]], k: int) -> ahocorasick.Automaton | None:
    """An automaton over all runs of ``k`` words; its values are the (record, place) where each run stands."""
    places: dict[str, list[tuple[int, int]]] = {}
    for key, w in passages.items():
        for i in range(max(1, len(w) - k + 1)):
            places.setdefault(f" {' '.join(w[i : i + k])} ", []).append((key, i))
    if not places:
        return None
    auto = ahocorasick.Automaton()
    for passage, at in places.items():
        auto.add_word(passage, at)
    auto.make_automaton()
    return auto


def covered(starts: set[int], k: int, n: int) -> float:
    """Share of ``n`` words that lie in the union of the intervals [s, s + k)."""
    total, end = 0, 0
    for s in sorted(starts):
        total += max(0, min(s + k, n) - max(s, end))
        end = max(end, min(s + k, n))
    return total / n if n else 0.0


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = neardup.WORDS
    shard, held, raw, auto = None, {}, {}, None
    for b in batches:
        out: list[tuple[int, int, float]] = []
        for key, role, node, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != shard:
                shard, held, raw, auto = key, {}, {}, None
            if role == 0:
                held[node], raw[node] = words(text), text
                continue
            if auto is None and held:
                auto = automaton(held, k)
            if auto is None:
                continue
            hits: dict[int, set[int]] = {}
            for _, places in auto.iter(f" {' '.join(words(text))} "):
                for e, i in places:
                    hits.setdefault(e, set()).add(i)
            for e, starts in hits.items():
                share = covered(starts, k, len(held[e]))
                if share >= neardup.SHARE and overlap(raw[e], text, k) >= neardup.SHARE:
                    out.append((e, node, share))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["eval_node", "train_node", "coverage"])


def shards(members: DataFrame) -> DataFrame:
    """(shard, role, node, text) of ``members`` (cluster, node, role, text): role 0 evaluation, 1 training."""
    size = members.groupBy("cluster").agg(F.ceil(F.count(F.when(F.col("role") == 0, 1)) / BLOCK).alias("blocks"), F.ceil(F.count(F.when(F.col("role") == 1, 1)) / SALT).alias("salts")).where("blocks > 0 and salts > 0")
    m = members.join(size, "cluster")
    spot = F.pmod(F.xxhash64("node"), F.when(F.col("role") == 0, F.col("blocks")).otherwise(F.col("salts")))
    m = m.withColumn("own", spot).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("role") == 0, F.col("salts")).otherwise(F.col("blocks")) - 1)))
    pair = F.when(F.col("role") == 0, F.struct(F.col("own").alias("b"), F.col("other").alias("s"))).otherwise(F.struct(F.col("other").alias("b"), F.col("own").alias("s")))
    return m.withColumn("p", pair).select(F.xxhash64("cluster", "p.b", "p.s").alias("shard"), "role", "node", "text")


def overlaps(posts: DataFrame, evaluation: str = "leaderboard", training: str = "train") -> tuple[DataFrame, DataFrame]:
    """(pairs of classes: eval_node, train_node, coverage; membership: row_id, split, node), both staged."""
    base = posts.where(F.col("row_id").isNotNull() & F.col("split").isin(evaluation, training)).select("row_id", "split", F.col("post_raw").alias("text"))
    rows = stage(neardup.packed(base), "packed")
    side = lambda x: F.max(F.col("split") == x)
    member = stage(rows.select("row_id", "split", "node").distinct(), "member")
    # Runs of training classes are never moved: they are read where they stand, for every block of evaluation classes.
    runs = rows.where("runs is not null")
    held = stage(runs.where(F.col("split") == evaluation).groupBy("node").agg(F.first("runs").alias("runs")), "evaluation")
    near = neardup.near(held, runs.where(F.col("split") == training), neardup.often(runs), False)
    same = member.groupBy("node").agg(side(evaluation).alias("e"), side(training).alias("t")).where("e and t").select(F.col("node").alias("e"), F.col("node").alias("t"))
    met = near.select(F.col("a").alias("e"), F.col("b").alias("t")).union(same).distinct()
    many = max(1, -(-held.count() // BLOCK))
    met = stage(met.withColumn("cluster", F.pmod(F.xxhash64("e"), F.lit(many))), "met")
    release(rows)
    release(held)
    members = met.select("cluster", F.col("e").alias("node"), F.lit(0).alias("role")).union(met.select("cluster", "t", F.lit(1))).distinct()
    # The texts of one class are the same to the automata, whichever side they come from.
    texts = neardup.class_texts(members.select("node").distinct(), member, base, "row_id")
    held = members.join(texts, "node").select("cluster", "node", "role", "text")
    parts = shards(stage(held, "held"))
    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = parts.repartition(n, "shard").sortWithinPartitions("shard", "role").mapInArrow(_scan, "eval_node long, train_node long, coverage double")
    return stage(found.distinct(), "overlaps"), member


def pairs(posts: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): same or near-same posts, one in train and one in leaderboard; the smaller id first."""
    found, member = overlaps(posts)
    e = member.where("split = 'leaderboard'").select(F.col("node").alias("eval_node"), F.col("row_id").alias("e"))
    t = member.where("split = 'train'").select(F.col("node").alias("train_node"), F.col("row_id").alias("t"))
    both = found.join(e, "eval_node").join(t, "train_node").where("e <> t")
    return both.select(F.least("e", "t").alias("row_id_a"), F.greatest("e", "t").alias("row_id_b")).distinct()


def counts(posts: DataFrame) -> DataFrame:
    """(split, origin, n_posts, n_overlapping) over all posts, origins in one spelling; a null origin stays null."""
    found, member = overlaps(posts)
    hit = found.select(F.col("eval_node").alias("node"), F.lit("leaderboard").alias("split")).union(found.select("train_node", F.lit("train"))).distinct()
    over = member.join(hit, ["node", "split"], "left_semi").select("row_id").distinct().withColumn("hit", F.lit(1))
    p = posts.where("row_id is not null").groupBy("row_id").agg(F.max("split").alias("split"), F.max(slug(F.col("origin"))).alias("origin"))
    return p.join(over, "row_id", "left").groupBy("split", "origin").agg(F.count("*").alias("n_posts"), F.count("hit").alias("n_overlapping"))
