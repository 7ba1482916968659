"""Problem 6: long exact spans shared between records, by hashing text units.

Lines and sentences do not align with a run that may start anywhere, so the units are cut by content: of every window of
``WINDOW`` places the run of ``UNIT`` characters with the least hash is a unit (ties: all of them).  Every stretch of
``UNIT`` + ``WINDOW`` - 1 <= ``LENGTH`` characters then holds a whole unit, and two records that share the stretch share
the unit.  Unit digests are grouped globally over classes of equal texts.

Pairs of records, where they are asked for, come from units that grow to their maximal common runs on the whole texts.  What
a record shares, and what is removed where repeated text goes, needs no pairs: stretches of ``LENGTH`` characters all of
whose units are shared are digested and grouped globally in turn, so that a stretch in m records costs m rows.  The earliest
ranked occurrence of a stretch is kept, and every other one is reported with its original offsets.

Characters are compared one for one; nothing is normalised away.  Defined results: null and short texts share nothing; a
record delivered twice is one; records of one id are never a pair; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import mixed
from quillspark.operators.ordering import numbered
from quillspark.sources.staging import stage

LENGTH, UNIT, WINDOW = 260, 100, 161
#: Texts hashed at a time, by characters.
CHUNK = 1_000_000
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _slide(x: np.ndarray, w: int, pick: np.ufunc, rest: np.uint64) -> np.ndarray:
    """pick over x[i : i + w] at every i; past the end counts as ``rest``."""
    x = np.concatenate([x, np.full(w, rest, np.uint64)])
    have = 1
    while have * 2 <= w:
        x = pick(x[: len(x) - have], x[have:])
        have *= 2
    if have < w:
        x = pick(x[: len(x) - (w - have)], x[w - have :])
    return x


def _rolled(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest of the ``width`` characters from each place of all texts, text of each place, place in it, sizes of the texts).

    Digests that would run over the end of a text are the greatest number.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = mixed(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(chars)
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BASE, np.uint64))])
    back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64))])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * power[:n])])
    digest = np.full(n, np.uint64(2**64 - 1), np.uint64)
    if n >= width:
        digest[: n - width + 1] = mixed((total[width:] - total[: n - width + 1]) * back[: n - width + 1])
    own = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n) - (np.cumsum(sizes) - sizes)[own]
    digest[place + width > sizes[own]] = np.uint64(2**64 - 1)
    return digest, own, place, sizes


def units(texts: list[str], unit: int = UNIT, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place, digest) of all units of texts of at least ``unit`` characters each."""
    top, bottom = np.uint64(2**64 - 1), np.uint64(0)
    digest, own, place, sizes = _rolled(texts, unit)
    n = len(digest)
    whole = place + unit <= sizes[own]
    least = _slide(digest, window, np.minimum, top)[:n]
    # A text with fewer places than a window is one window.
    least[~((place + unit + window - 1 <= sizes[own]) | ((place == 0) & (sizes[own] < unit + window - 1)))] = bottom
    kept = whole & (digest == _slide(least[::-1], window, np.maximum, bottom)[:n][::-1])
    # Within a run of one character all units are equal, and the longest common runs go through its first or its last one.
    inner = np.zeros(n, bool)
    inner[1:-1] = (digest[1:-1] == digest[:-2]) & (digest[1:-1] == digest[2:]) & kept[:-2] & kept[2:] & (own[:-2] == own[2:])
    at = np.flatnonzero(kept & ~inner)
    return own[at], place[at], digest[at]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, nodes = b.column("text").to_pylist(), b.column("node").to_numpy()
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j]) <= CHUNK):
                held += len(texts[j])
                j += 1
            own, place, digest = units(texts[i:j])
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(nodes[i:j][own]), pa.array(place.astype(np.int32))], ["digest", "node", "place"])
            i = j


def reach(a: str, b: str, i: int, j: int) -> tuple[int, int]:
    """(characters that a[i:], b[j:] have in common, characters that a[:i], b[:j] have in common at their ends)."""
    def forward() -> int:
        n, step, most = 0, 64, min(len(a) - i, len(b) - j)
        while step:
            if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
                n += step
                step *= 2
            else:
                step //= 2
        return n

    def backward() -> int:
        n, step, most = 0, 64, min(i, j)
        while step:
            if n + step <= most and a[i - n - step : i - n] == b[j - n - step : j - n]:
                n += step
                step *= 2
            else:
                step //= 2
        return n

    return forward(), backward()


def runs(a: str, b: str, spots: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start in a, start in b, characters) of the maximal common runs of ``length`` and more through the spots."""
    found = set()
    done: dict[int, int] = {}
    for i, j in sorted(spots):
        if done.get(i - j, -1) > i:
            continue
        ahead, behind = reach(a, b, i, j)
        done[i - j] = i + ahead
        if ahead + behind >= length:
            found.add((i - behind, j - behind, ahead + behind))
    return sorted(found)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        out = []
        for a, b, x, y, spots in zip(*(t.column(c).to_pylist() for c in ("a", "b", "ta", "tb", "spots")), strict=True):
            out += [(a, b, i, j, n) for i, j, n in runs(x, y, [(s["i"], s["j"]) for s in spots])]
        cols = list(zip(*out, strict=True)) or [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["a", "b", "start_a", "start_b", "chars"])


def _classes(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base: rec, text, node; members: rec, node, chars, staged; units of the classes: digest, node, place, staged).

    Classes hold equal texts (64-bit digest); a class of several records is one row in the units.
    """
    base = records.where(F.col("rec").isNotNull() & (F.length("text") >= LENGTH)).withColumn("node", F.xxhash64("text"))
    member = stage(base.select("rec", "node", F.length("text").alias("chars")).distinct(), "members")
    return base, member, stage(base.select("node", "text").mapInArrow(_cut, "digest long, node long, place int").distinct(), "units")


def _held(base: DataFrame, member: DataFrame, used: DataFrame) -> DataFrame:
    """(node, rec, text): the first record of each class of ``used`` (node) and its text."""
    first = member.groupBy("node").agg(F.min("rec").alias("rec")).join(used, "node", "left_semi")
    return first.join(base.select("rec", "node", "text"), ["rec", "node"]).groupBy("node", "rec").agg(F.min("text").alias("text"))


def shared(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs between classes: a, b, start_a, start_b, chars; membership: rec, node, chars), staged.  ``records``: (rec, text)."""
    base, member, unit = _classes(records)
    many = unit.groupBy("digest").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("digest")
    met = unit.join(many, "digest")
    x, y = met.alias("x"), met.alias("y")
    pair = x.join(y, "digest").where("x.node < y.node").groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.collect_set(F.struct(F.col("x.place").alias("i"), F.col("y.place").alias("j"))).alias("spots"))
    pair = stage(pair, "pairs")
    used = pair.select(F.col("a").alias("node")).union(pair.select("b")).distinct()
    texts = stage(_held(base, member, used), "texts")
    j = pair.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    grown = stage(j.select("a", "b", "ta", "tb", "spots").mapInArrow(_grow, "a long, b long, start_a int, start_b int, chars int"), "runs")
    return grown, member


def pairs(records: DataFrame) -> DataFrame:
    """(rec_a, rec_b): pairs of different records with a common run, the smaller id first."""
    grown, member = shared(records)
    link = grown.select("a", "b").distinct()
    own = member.groupBy("node").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo < hi").select(F.col("node").alias("a"), F.col("node").alias("b"))
    both = link.union(own)
    x, y = member.select(F.col("node").alias("a"), F.col("rec").alias("p")), member.select(F.col("node").alias("b"), F.col("rec").alias("q"))
    return both.join(x, "a").join(y, "b").where("p <> q").select(F.least("p", "q").alias("rec_a"), F.greatest("p", "q").alias("rec_b")).distinct()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, node, rank, place) of the stretches of ``LENGTH`` characters whose unit of least hash is a shared one.

    A stretch that stands elsewhere has the same unit there, so no other one can be shared.
    """
    for b in batches:
        texts, ranks, nodes, digests = b.column("text").to_pylist(), b.column("rank").to_numpy(), b.column("node").to_numpy(), b.column("digests").to_pylist()
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j]) <= CHUNK):
                held += len(texts[j])
                j += 1
            digest, own, place, sizes = _rolled(texts[i:j], LENGTH)
            unit, top = _rolled(texts[i:j], UNIT)[0], np.uint64(2**64 - 1)
            ends = np.cumsum(sizes)
            known = np.full(len(unit), top, np.uint64)
            for k, d in enumerate(digests[i:j]):
                part = unit[ends[k] - sizes[k] : ends[k]]
                known[ends[k] - sizes[k] : ends[k]] = np.where(np.isin(part, np.array(d, np.int64).view(np.uint64)), part, top)
            least = _slide(unit, WINDOW, np.minimum, top)[: len(unit)]
            keep = np.flatnonzero((place + LENGTH <= sizes[own]) & (least == _slide(known, WINDOW, np.minimum, top)[: len(unit)]))
            yield pa.RecordBatch.from_arrays([pa.array(digest[keep].view(np.int64)), pa.array(nodes[i:j][own[keep]]), pa.array(ranks[i:j][own[keep]]), pa.array(place[keep].astype(np.int32))], ["digest", "node", "rank", "place"])
            i = j


def stretches(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shared stretches of classes: node, places, later; membership: rec, node, chars), staged.

    places: starts of the stretches that another class has too; later: those among them of which an earlier occurrence is
    kept.  Both are bounded by the length of one text.
    """
    base, member, unit = _classes(records)
    many = unit.groupBy("digest").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("digest")
    met = stage(unit.join(many, "digest").groupBy("node").agg(F.collect_set("digest").alias("digests")), "digests")
    texts = numbered(_held(base, member, met.select("node")).join(met, "node"), ["rec", "node"], "rank")
    found = stage(texts.select("text", "rank", "node", "digests").mapInArrow(_stretches, "digest long, node long, rank long, place int"), "stretches")
    per = found.groupBy("digest").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(F.struct("rank", "place")).alias("kept")).where("lo < hi").select("digest", "kept")
    j = found.join(per, "digest")
    later = (F.col("rank") != F.col("kept.rank")) | (F.col("place") != F.col("kept.place"))
    return stage(j.groupBy("node").agg(F.array_sort(F.collect_set("place")).alias("places"), F.array_sort(F.collect_set(F.when(later, F.col("place")))).alias("later")), "shared"), member


def _ranges(places: F.Column) -> F.Column:
    """Sorted stretch starts as the array of (start, end) that they cover."""
    last = lambda s: F.element_at(s, -1)
    new = lambda x: F.array(F.struct(x.alias("start"), (x + LENGTH).alias("end")))
    step = lambda s, x: F.when((F.size(s) > 0) & (x <= last(s)["end"]), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(last(s)["start"].alias("start"), (x + LENGTH).alias("end"))))).otherwise(F.concat(s, new(x)))
    return F.aggregate(places, F.array().cast("array<struct<start:int,end:int>>"), step)


def _length(ranges: F.Column) -> F.Column:
    return F.aggregate(ranges, F.lit(0), lambda s, r: s + r["end"] - r["start"])


def shares(records: DataFrame) -> DataFrame:
    """(rec, chars, shared_chars, shared, is_earliest) of the records that share a run.

    shared_chars: characters of the record that lie in a run of ``LENGTH`` and more which another record has too.
    is_earliest: nothing of it is removed where the earliest occurrence of repeated text is kept.
    """
    span, member = stretches(records)
    many = member.groupBy("node").agg(F.min("rec").alias("first"), F.max("rec").alias("last"))
    m = member.join(many, "node").join(span, "node", "left").where("places is not null or first < last")
    covered = F.when(F.col("first") < F.col("last"), F.col("chars")).otherwise(_length(_ranges(F.col("places"))))
    early = (F.col("rec") == F.col("first")) & (F.coalesce(F.size("later"), F.lit(0)) <= 0)
    return m.select("rec", "chars", covered.alias("shared_chars"), F.round(covered / F.col("chars"), 6).alias("shared"), early.alias("is_earliest"))


def removed(records: DataFrame) -> DataFrame:
    """(rec, start, end): what goes where of every repeated run only the earliest ranked occurrence is kept, in the offsets of
    the record.  Of records with one text all but the first go whole."""
    span, member = stretches(records)
    first = member.groupBy("node").agg(F.min("rec").alias("first"))
    m = member.join(first, "node").join(span.select("node", "later"), "node", "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("chars").cast("int").alias("end")))
    cut = F.when(F.col("rec") != F.col("first"), whole).otherwise(_ranges(F.coalesce("later", F.array().cast("array<int>"))))
    return m.select("rec", F.explode(cut).alias("r")).select("rec", "r.start", "r.end")


def post_and_draft_records(posts: DataFrame, outputs: DataFrame) -> DataFrame:
    return posts.select(F.col("row_id").alias("rec"), F.col("post_raw").alias("text")).union(outputs.select("draft_id", "text"))
