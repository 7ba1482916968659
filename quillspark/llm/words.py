"""Normalised words of texts and their 64-bit codes, the shared ground of the near-duplicate and overlap operators.

Words are compared without case, accents, apostrophes, punctuation, layout and character forms.  Whole texts are used.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from quillspark.llm.charforms import PLAIN, one_form

_PLAIN = re.compile(PLAIN)
_WORD = re.compile(r"[^\W_]+")
_DROP = re.compile("['’‘ʼ`´]")
_MARKS = re.compile("[̀-ͯ]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(31)


def folded(text: str) -> str:
    """The text in one character form, lower case and without accents and apostrophes."""
    if not text.isascii():
        if not _PLAIN.match(text):
            text = one_form(text)
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _DROP.sub("", text)))
    return text.replace("'", "").casefold()


def words(text: str | None) -> list[str]:
    """Normalised words; none for null, empty or wordless text."""
    return _WORD.findall(folded(text)) if text else []


class Codes(dict):
    """Word to 64-bit code, the same on every machine.  Forgets what it holds when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def coded(texts: list[str | None], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words of all texts in order, number of words of each text)."""
    flat: list[int] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        sizes[i] = len(w)
        flat += map(codes.__getitem__, w)
    return np.array(flat, np.uint64), sizes


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` characters of the column (or one row), so that long texts fit in memory."""
    for b in batches:
        sizes = np.array([0 if x is None else x for x in pc.utf8_length(b.column(column)).to_pylist()], np.int64)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held + n > limit and i > start:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MUL
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> _SHIFT)


def shingles(flat: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words (one of all words where a text has fewer), and their number per text.

    Texts without words get none.
    """
    n = len(flat)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
    count = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    padded = np.concatenate([flat, np.zeros(k, np.uint64)])
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(n)
    run = np.zeros(n, np.uint64)
    short = np.repeat(sizes < k, sizes)
    for j in range(k):
        step = padded[j : j + n]
        if short.any():
            step = np.where(short & (at + j >= ends), np.uint64(0), step)
        run = run * _MIX + step
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = at - first < np.repeat(count, sizes)
    return mixed(run[keep]), count


def overlap(a: str | None, b: str | None, k: int = 5) -> float:
    """Share of the runs of ``k`` words that two texts have in common, of the text that has more.  0 without words."""
    x, y = words(a), words(b)
    if not x or not y:
        return 0.0
    grams = lambda w: [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    p, q = grams(x), grams(y)
    left: dict[tuple[str, ...], int] = {}
    for g in p:
        left[g] = left.get(g, 0) + 1
    common = 0
    for g in q:
        if left.get(g, 0):
            left[g] -= 1
            common += 1
    return common / max(len(p), len(q))
