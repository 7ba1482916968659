"""Problem 9: mixing sources to target weights.

Tokens of a public tokenizer are counted per source; the repetition rate of a source is its share of the mixture over its
own tokens.  Every document is emitted in floor(rate) rows plus one with the probability of the fraction, drawn from a
hash of the seed and its id, so that a run can be repeated and a lost task gives the same rows again.

Without ``total`` the mixture is as large as the caps allow while all shares are exact.  With a given ``total`` a source
that reaches its cap stays there and the others share what it leaves.  Defined results: sources are compared in one
spelling; sources without target, with target 0 or without tokens get no document; targets of absent sources are shared
out among the others; a repeated target counts once (the largest); null texts have no tokens; a null source has no target.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ids import slug
from quillspark.sources.staging import stage

TOKENIZERS, RANKS = "/opt/tokenizers", "byte_bpe_50k.tiktoken"


def load(folder: str = TOKENIZERS, ranks: str = RANKS) -> tuple[str, bytes]:
    """(pattern, ranks file) of a byte-level tokenizer, read where the job is started; the folder's own module holds its
    pattern.  Executors need no such folder: both are sent with the job, a megabyte at most whatever the data."""
    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{ranks}", "rb") as f:
        return module.PATTERN, f.read()


def tokenizer(pattern: str, ranks: bytes):  # noqa: ANN201
    """The tokenizer of what :func:`load` gives."""
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def counted(documents: DataFrame, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, tokens) of every document; source in one spelling."""
    held = documents.sparkSession.sparkContext.broadcast(load(folder, ranks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(*held.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), slug(F.col("source")).alias("source"), "text")
    return docs.mapInArrow(count, "doc_id long, source string, tokens long")


def rates(sizes: dict[str, int], targets: dict[str, tuple[float, float]], total: float | None = None) -> dict[str, float]:
    """Repetition rate of each source.  ``targets``: source to (share, cap)."""
    live = {s: (w, cap) for s, (w, cap) in targets.items() if w > 0 and cap > 0 and sizes.get(s, 0) > 0}
    weight = sum(w for w, _ in live.values())
    if not live:
        return {}
    if total is None:
        total = min(cap * sizes[s] * weight / w for s, (w, cap) in live.items())
    out: dict[str, float] = {}
    left = float(total)
    while live:
        weight = sum(w for w, _ in live.values())
        full = [s for s, (w, cap) in live.items() if left * w / weight > cap * sizes[s] * (1 + 1e-12)]
        if not full:
            return out | {s: left * w / weight / sizes[s] for s, (w, _) in live.items()}
        for s in full:
            out[s] = live.pop(s)[1]
            left -= out[s] * sizes[s]
    return out


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, folder: str = TOKENIZERS, ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copy) of the emitted documents, a row per copy, and the report per source.

    The report: source, n_docs, tokens, target_share, rate, mixed_tokens, actual_share.  Sources are counted with partial
    aggregation; only those that have a target come to the driver, as many as the table of targets has.
    """
    spark = documents.sparkSession
    docs = stage(counted(documents, folder, ranks), "tokens")
    per = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
    goal = targets.select(slug(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("cap")).where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("cap").alias("cap"))
    known = {r["source"]: r for r in per.join(goal, "source").toLocalIterator()}
    rate = rates({s: r["tokens"] for s, r in known.items()}, {s: (r["target_share"] or 0.0, r["cap"] or 0.0) for s, r in known.items()}, total)
    rated = spark.createDataFrame(list(rate.items()), "source string, rate double")
    whole = F.floor("rate")
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    times = (whole + (draw < F.col("rate") - whole).cast("long")).cast("int")
    kept = docs.join(F.broadcast(rated), "source").withColumn("copies", times).where("copies > 0")  # rates: rows of the targets
    emitted = kept.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    mixed = kept.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    every = mixed.agg(F.sum("mixed_tokens")).first()[0]
    report = per.join(goal.drop("cap"), "source", "full").join(rated, "source", "left").join(mixed, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return emitted, report.select("source", zero("n_docs").alias("n_docs"), zero("tokens").alias("tokens"), "target_share", F.round(F.coalesce("rate", F.lit(0.0)), 6).alias("rate"), zero("mixed_tokens").alias("mixed_tokens"), F.round(F.try_divide(zero("mixed_tokens"), F.lit(every)), 6).alias("actual_share"))
