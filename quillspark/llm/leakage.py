"""Problem 8: evaluation texts leaking into training text, by training suffix arrays.

Training documents stay where they are.  Each partition builds suffix arrays over the normalised words of its documents,
shard by shard, and every suffix of every evaluation item is binary-searched in them.  Only suffixes that begin with words
of the items can match at all, so only those are sorted.  Hits on one diagonal are joined to the longest verbatim matches of
one item in one document, with their places.

An item leaks into a document if a stretch of at least ``LEAST`` of its words stands in the document with at most
``DIFFER`` of the words differing (substituted, left out or added).  A verbatim match of that many words decides by itself;
shorter ones are chained, with the shorter runs around them, over differing words.  A stretch of n words with 0.15 n
differing ones holds a verbatim run of ``SEED`` words for every n from 20 on, so no leak is without a match.  Case,
punctuation, layout and character forms do not matter.

The items are a stated query set: they are sent out in blocks of at most ``BLOCK`` words, and every document is read and cut
into words once for all blocks.  Defined results: null or wordless texts leak nothing; items shorter than ``LEAST`` words
never match; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.words import words

LEAST, DIFFER, SEED = 20, 0.15, 5
#: Words of evaluation items sent out at a time, and words of training text in one suffix array.
BLOCK, SHARD = 2_000_000, 500_000
_BITS = np.uint64(21)


class Suffixes:
    """A suffix array over word numbers (0: a word of no item) to the depth of six words."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = np.concatenate([codes, np.zeros(6, np.uint64)])
        first, second = self._keys(self.codes, len(codes))
        at = np.flatnonzero((self.codes[: len(codes)] > 0) & (self.codes[1 : len(codes) + 1] > 0) & (self.codes[2 : len(codes) + 2] > 0))
        self.order = at[np.lexsort((second[at], first[at]))]
        self.first, self.second = first[self.order], second[self.order]

    @staticmethod
    def _keys(padded: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        pack = lambda i: (padded[i : i + n] << _BITS * np.uint64(2)) | (padded[i + 1 : i + 1 + n] << _BITS) | padded[i + 2 : i + 2 + n]
        return pack(0), pack(3)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the queries, place in the text) of all equal runs of ``SEED`` words, by binary search."""
        padded = np.concatenate([queries, np.zeros(6, np.uint64)])
        first, second = self._keys(padded, len(queries))
        low, high = np.searchsorted(self.first, first, "left"), np.searchsorted(self.first, first, "right")
        size = np.where(queries > 0, high - low, 0)
        q = np.repeat(np.arange(len(queries)), size)
        within = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
        at = low[q] + within
        drop = _BITS * np.uint64(6 - SEED)
        same = self.second[at] >> drop == second[q] >> drop
        for k in range(3, SEED):
            same &= padded[q + k] > 0
        return q[same], self.order[at[same]]


def stretch(doc: list[str], item: list[str]) -> tuple[int, int]:
    """(words of the item, differing words) of the best stretch of the item in the document.

    Maximal common runs of two words and more are chained in order; between two of them there can't be more words than may
    differ in the whole item.  From each run as the start, every run that can be reached gets the least number of differing
    words on the way; the longest stretch with at most ``DIFFER`` of them counts.
    """
    gap = int(DIFFER * len(item))
    where: dict[tuple[str, str], list[int]] = {}
    for i in range(len(item) - 1):
        where.setdefault((item[i], item[i + 1]), []).append(i)
    found: list[tuple[int, int, int]] = []
    for j in range(len(doc) - 1):
        for i in where.get((doc[j], doc[j + 1]), ()):
            if i and j and item[i - 1] == doc[j - 1]:
                continue
            n = 2
            while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
                n += 1
            found.append((i, j, n))
    after: list[list[tuple[int, int]]] = [[] for _ in found]  # (later run, differing words up to it)
    for k, (i, j, n) in enumerate(found):
        for m in range(k + 1, len(found)):
            ni, nj, nn = found[m]
            gi, gj = ni - i - n, nj - j - n
            if gj > gap:
                break
            cut = max(0, -gi, -gj)
            if cut < nn and i < ni and j < nj and gi <= gap:
                after[k].append((m, max(gi + cut, gj + cut)))
    best = (0, 0)
    for k, (start, _, _) in enumerate(found):
        most = DIFFER * (len(item) - start)
        if len(item) - start <= best[0]:
            continue
        differ = {k: 0}
        todo = [k]
        while todo:
            m = heapq.heappop(todo)  # runs in order: all ways to this one are known
            length = found[m][0] + found[m][2] - start
            if differ[m] <= DIFFER * length and length > best[0]:
                best = (length, differ[m])
            for x, gap in after[m]:
                d = differ[m] + gap
                if d <= most and d < differ.get(x, d + 1):
                    if x not in differ:
                        heapq.heappush(todo, x)
                    differ[x] = d
    return best


def matches(q: np.ndarray, at: np.ndarray, item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest verbatim matches of search hits: rows of (document, item, place in the items, place in the text, words).

    ``item`` and ``doc``: of each hit.  Hits that follow each other on both sides are one match.
    """
    if not len(q):
        return np.empty((0, 5), np.int64)
    order = np.lexsort([q, at - q, item, doc])
    q, at, item, doc = q[order], at[order], item[order], doc[order]
    new = np.concatenate([[True], (np.diff(q) != 1) | (np.diff(at) != 1) | (np.diff(item) != 0) | (np.diff(doc) != 0)])
    first = np.flatnonzero(new)
    return np.stack([doc[first], item[first], q[first], at[first], np.diff(np.append(first, len(q))) + SEED - 1], axis=1)


class Finder:
    """Finds the items of one block in documents."""

    def __init__(self, items: dict[int, list[str]]) -> None:
        self.items, self.keys = items, list(items)
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(x for w in items.values() for x in w))}
        self.flat = np.array([c for k in self.keys for c in [*(self.vocabulary[x] for x in items[k]), 0]], np.uint64)
        self.owner = np.repeat(np.arange(len(self.keys)), [len(items[k]) + 1 for k in self.keys])

    def leaks(self, ids: list[int], texts: list[list[str]]) -> list[tuple[int, int]]:
        """(doc id, item id) of the documents given as words."""
        get = self.vocabulary.get
        codes = np.array([c for t in texts for c in [*(get(x, 0) for x in t), 0]], np.uint64)
        sizes = np.array([len(t) + 1 for t in texts])
        place, start = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        q, at = Suffixes(codes).search(self.flat)
        found = matches(q, at, self.owner[q], place[at])
        if not len(found):
            return []
        out = []
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(found)], strict=True):
            d, k = int(found[a, 0]), int(found[a, 1])
            item = self.items[self.keys[k]]
            if found[a:b, 4].max() >= LEAST or self._chained(texts[d], item, np.sort(found[a:b, 3] - start[d])):
                out.append((ids[d], self.keys[k]))
        return out

    @staticmethod
    def _chained(doc: list[str], item: list[str], places: np.ndarray) -> bool:
        """Whether matches at these places of the document, with what is around them, are a stretch of the item."""
        reach = int(len(item) * (1 + DIFFER)) + 1
        for part in np.split(places, np.flatnonzero(np.diff(places) > reach) + 1):
            if stretch(doc[max(0, int(part[0]) - reach) : int(part[-1]) + reach + SEED], item)[0] >= LEAST:
                return True
        return False


def _scanner(blocks: list):  # noqa: ANN202
    """(doc_id, item_id) of the leaks of all blocks of items (broadcast), documents read once in shards of ``SHARD`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = [Finder(b.value) for b in blocks] if len(blocks) <= 4 else None

        def out(ids: list[int], texts: list[list[str]]) -> pa.RecordBatch:
            found = [f for one in (few or (Finder(b.value) for b in blocks)) for f in one.leaks(ids, texts)]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["doc_id", "item_id"])

        ids: list[int] = []
        texts: list[list[str]] = []
        held = 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(d)
                texts.append(words(t))
                held += len(texts[-1])
                if held >= SHARD:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield out(ids, texts)

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): the document holds at least ``LEAST`` words in a row of the item, about one in ten differing."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    send = documents.sparkSession.sparkContext.broadcast
    blocks, block, held = [], {}, 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").toLocalIterator():
        w = words(r["text"])
        if len(w) < LEAST:
            continue
        if held + len(w) > BLOCK and block:
            blocks.append(send(block))
            block, held = {}, 0
        block[r["item_id"]] = w
        held += len(w)
    if block:
        blocks.append(send(block))
    return docs.mapInArrow(_scanner(blocks), "doc_id long, item_id long").distinct()


def clean(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` without those that leak an item; the columns stay as they are."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
