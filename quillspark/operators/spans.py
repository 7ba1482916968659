"""Alignment of quoted phrases to their text.

Offsets count code points.  A phrase is looked for in four forms of the text, one after the other: as it is, in lower case,
normalised, and normalised without closing marks; the first form with a hit wins.  All phrases of a text go through one
call, so its forms are made once.  Null texts and blank phrases never align.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillspark.config import CURLY, EDGE_MARKS, ELLIPSIS, GAP

_EDGE, _GAP, _WORD = re.compile(EDGE_MARKS), re.compile(GAP), re.compile(r"\S+")
_PIECE = re.compile(rf"(?P<blank>\s+)|(?P<dots>{ELLIPSIS})|(?:(?!\s|{ELLIPSIS}).)+", re.DOTALL)
_STRAIGHT = str.maketrans({k: v for k, v in CURLY.items() if v != " "})


def occurrences(text: str, needle: str) -> list[int]:
    """Starts of all occurrences, overlapping ones too."""
    return [m.start() for m in re.finditer(f"(?={re.escape(needle)})", text)] if needle else []


def lower_same_length(text: str) -> str:
    """Lower case, where a character whose lower case has another length stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Mapped:
    """A normal form with the range of the raw text behind each of its characters.

    Runs of white space become one space that stands for the whole run; those at the ends go; the parts of an expanded
    ellipsis all stand for it.  Without ``char_map`` quotes and ellipses stay.
    """

    def __init__(self, raw: str, char_map: bool = True) -> None:
        text, starts, ends = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        last = len(raw.rstrip())
        for m in _PIECE.finditer(raw, len(raw) - len(raw.lstrip()), last):
            a, b = m.span()
            if m["blank"]:
                piece, at, to = " ", [a], [b]
            elif m["dots"] and char_map:
                piece, at, to = "...", np.repeat(np.arange(a, b), 3), np.repeat(np.arange(a, b) + 1, 3)
            else:
                piece, at, to = lower_same_length(m[0].translate(_STRAIGHT) if char_map else m[0]), np.arange(a, b), np.arange(a, b) + 1
            text.append(piece)
            starts.append(np.asarray(at))
            ends.append(np.asarray(to))
        self.text = "".join(text)
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)

    def range(self, a: int, b: int) -> tuple[int, int]:
        """The raw range of the characters from a to b, without blanks at its ends."""
        part = self.text[a:b]
        a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())
        return int(self.starts[a]), int(self.ends[b - 1])


class Forms:
    """The forms of one text, made when they are needed and once for all its phrases."""

    def __init__(self, raw: str) -> None:
        self.raw = raw

    @cached_property
    def lower(self) -> str:
        return lower_same_length(self.raw)

    @cached_property
    def norm(self) -> Mapped:
        return Mapped(self.raw)

    @cached_property
    def plain(self) -> Mapped:
        """The scorer's form: lower case and single spaces, no other character mapped."""
        return Mapped(self.raw, char_map=False)

    def find(self, phrase: str) -> tuple[str, list[tuple[int, int]]]:
        """(rung, all raw ranges) of the first rung with a hit; unmatched without one."""
        if not phrase.strip():
            return "unmatched", []
        own = Mapped(phrase).text
        for rung, text, needle in (
            ("exact", lambda: self.raw, phrase),
            ("casefold", lambda: self.lower, phrase.lower()),
            ("normalized", lambda: self.norm.text, own),
            ("trimmed", lambda: self.norm.text, _EDGE.sub("", own).strip()),
        ):
            at = occurrences(text(), needle)
            if at and rung in ("exact", "casefold"):
                return rung, [(a, a + len(needle)) for a in at]
            if at:
                return rung, [self.norm.range(a, a + len(needle)) for a in at]
        return "unmatched", []


def official(pred: str, gold: str, limit: int = 3) -> bool:
    """Containment either way on scorer forms, with at most ``limit`` times the gold's tokens; false for blanks."""
    p, g = " ".join(pred.lower().split()), " ".join(gold.lower().split())
    return bool(p and g) and (p in g or g in p) and len(p.split()) <= limit * len(g.split())


def longest_common(text: str, phrase: str) -> tuple[int, int]:
    """(start in the text, length) of the longest common part, the first to end in the text among equals.

    The text runs through the suffix automaton of the phrase, so the time is the sum of both lengths.
    """
    step: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in phrase:
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    at = have = 0
    best = (0, 0)
    for i, c in enumerate(text):
        while at and c not in step[at]:
            at = link[at]
            have = size[at]
        if c in step[at]:
            at = step[at][c]
            have += 1
            if have > best[1]:
                best = (i - have + 1, have)
    return best


def scorer_slice(gold: str, forms: Forms) -> tuple[int, int] | None:
    """Raw range that the scorer matches with the phrase: the whole words inside the longest common part.

    It needs two words or the whole phrase, and must match officially.
    """
    g = " ".join(gold.lower().split())
    start, n = longest_common(forms.plain.text, g)
    inside = [m.span() for m in _WORD.finditer(forms.plain.text) if start <= m.start() and m.end() <= start + n]
    if not inside:
        return None
    a, b = inside[0][0], inside[-1][1]
    if len(inside) < 2 and forms.plain.text[a:b] != g:
        return None
    x, y = forms.plain.range(a, b)
    return (x, y) if official(forms.raw[x:y], gold) else None


def align(phrases: list[str], raw: str) -> list[dict]:
    """One row per phrase, and per part of a phrase with a gap, which follow after all phrases.

    A phrase without a hit but with an ellipsis is ``split``; its parts that match are its children.  A repeated phrase takes
    its next occurrence (exact and case-folded rungs; the last one holds).  Scorer fields: ``direct`` where the slice matches
    officially, ``lcs`` where a part does, else none; a split phrase with a child that has them has none of its own.
    """
    forms = Forms(raw)
    rows: list[dict] = []
    later: list[dict] = []
    used: dict[str, int] = {}

    def scored(text: str, hit: tuple[int, int] | None) -> dict:
        if hit and official(raw[hit[0] : hit[1]], text):
            kind, at = "direct", hit
        else:
            at = scorer_slice(text, forms)
            kind = "lcs" if at else "none"
        return {"scorer_rung": kind, "scorer_start": at[0] if at else -1, "scorer_end": at[1] if at else -1, "scorer_slice": raw[at[0] : at[1]] if at else ""}

    def row(parent: int, text: str, rung: str, hits: list[tuple[int, int]], hit: tuple[int, int] | None) -> dict:
        count = max(len(occurrences(forms.lower, text.lower())), len(hits)) if hits else 0
        return {"parent_span_idx": parent, "text_gold": text, "rung": rung, "raw_start": hit[0] if hit else -1, "raw_end": hit[1] if hit else -1, "raw_slice": raw[hit[0] : hit[1]] if hit else None, "n_occurrences": count, "all_starts": [a for a, _ in hits]}

    for i, p in enumerate(phrases):
        rung, hits = forms.find(p)
        if hits:
            k = used.get(p, 0) if rung in ("exact", "casefold") else 0
            used[p] = used.get(p, 0) + 1
            hit = hits[min(k, len(hits) - 1)]
            rows.append(row(-1, p, rung, hits, hit) | scored(p, hit))
        elif _GAP.search(p):
            children = []
            for part in filter(None, map(str.strip, _GAP.split(p))):
                r, h = forms.find(part)
                if h:
                    children.append(row(i, part, r, h, h[0]) | scored(part, h[0]))
            none = {"scorer_rung": "none", "scorer_start": -1, "scorer_end": -1, "scorer_slice": ""}
            rows.append(row(-1, p, "split", [], None) | (none if any(c["scorer_rung"] != "none" for c in children) else scored(p, None)))
            later += children
        else:
            rows.append(row(-1, p, "unmatched", [], None) | scored(p, None))
    return [{"span_idx": k} | r for k, r in enumerate(rows + later)]


SPAN = "array<struct<span_idx int, parent_span_idx int, text_gold string, rung string, raw_start int, raw_end int, raw_slice string, n_occurrences int, all_starts array<int>, scorer_rung string, scorer_start int, scorer_end int, scorer_slice string>>"


def aligned(df: DataFrame, key: str, text: str, phrases: str) -> DataFrame:
    """(key, and the fields of :func:`align`), one row per span.  Null texts and lists give no rows, null phrases none."""
    @F.pandas_udf(SPAN)
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([align([x for x in (v if v is not None else []) if x is not None], r) if r is not None else [] for r, v in zip(t, p, strict=True)])

    some = df.where(F.col(text).isNotNull() & (F.size(phrases) > 0))
    return some.select(key, F.explode(run(text, phrases)).alias("s")).select(key, "s.*")


def realign(phrases: list[str], raw: str | None) -> list[str]:
    """The phrases as they stand in another text, first hits; those without one are dropped."""
    forms = Forms(raw or "")
    hits = [forms.find(p)[1] for p in phrases if p is not None]
    return [(raw or "")[h[0][0] : h[0][1]] for h in hits if h]


@F.pandas_udf(ArrayType(StringType()))
def realigned(phrases: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([realign(list(p) if p is not None else [], r) for p, r in zip(phrases, raw, strict=True)])


def ranges(raw: str | None, phrases: list[str] | None) -> list[tuple[int, int]] | None:
    """Verbatim ranges that do not overlap, claimed in phrase order and returned sorted; None if one is missing."""
    if raw is None:
        return None
    taken: list[tuple[int, int]] = []
    for p in phrases if phrases is not None else []:
        spot = next(((a, a + len(p)) for a in occurrences(raw, p) if all(a + len(p) <= x or a >= y for x, y in taken)), None)
        if spot is None:
            return None
        taken.append(spot)
    return sorted(taken)


RANGES = "array<struct<start:int,end:int>>"


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def claimed(raw: pd.Series, phrases: pd.Series) -> pd.Series:
    """:func:`ranges` as a column; null if a phrase is missing."""
    found = [ranges(r, list(p) if p is not None else []) for r, p in zip(raw, phrases, strict=True)]
    return pd.Series([None if f is None else [{"start": a, "end": b} for a, b in f] for f in found])


def checked_ranges(text: Column, spans: Column) -> Column:
    """Delivered (start, end, text) spans as struct(error, ranges): validated against the text, without blanks at their ends.

    error: the first of ``offsets`` (outside the text, or empty) and ``text`` (not what stands there) that any span has, else
    null.  Blank spans go.  ranges: overlapping and touching ones joined, sorted; null with an error.
    """
    n = F.length(text)
    bad = lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["end"] > n) | (s["end"] <= s["start"])
    part = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    blank = r"[\s\x1c-\x1f\x85\p{Z}]+"
    bare = lambda c: F.regexp_replace(c, f"^{blank}|{blank}$", "")
    lead = lambda s: F.length(part(s)) - F.length(F.regexp_replace(part(s), f"^{blank}", ""))
    claim = lambda s: s["text"].isNotNull() & (bare(part(s)) != "") & (bare(s["text"]) != bare(part(s)))
    error = F.when(F.exists(spans, bad), "offsets").when(F.exists(spans, claim), "text")
    own = F.transform(F.filter(spans, lambda s: bare(part(s)) != ""), lambda s: F.struct((s["start"] + lead(s)).alias("start"), (s["start"] + lead(s) + F.length(bare(part(s)))).alias("end")))
    return F.struct(error.alias("error"), F.when(error.isNull(), merge_ranges(own)).alias("ranges"))


def merge_ranges(c: Column) -> Column:
    """Sorted array of (start, end) with overlapping and touching ranges joined; a fold in the JVM."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(c), F.array().cast(RANGES), step)
