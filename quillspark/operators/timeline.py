"""Timelines of an author's posts: positions, neighbours, insertion and truncation.  Order is always (order column, key)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.config import CLIP_MARK, COVER_MARGIN, CUT_MARK, HEAD_SHARE, NEIGHBOUR_CLIP, TOKEN_BUDGET
from quillspark.functions.text import clip
from quillspark.operators import ordering


def positioned(df: DataFrame, user: str, order: str, key: str) -> DataFrame:
    """``df`` with position (from 1) and n_posts of its user, however many posts one user has."""
    return ordering.positioned(df, user, [order, key], "position", "n_posts").drop("_g")


def context(df: DataFrame, user: str, order: str, key: str, text: str, limit: int = NEIGHBOUR_CLIP) -> DataFrame:
    """(key, position, n_posts, context): two earlier and one later post, clipped and labelled by their distance."""
    d = ordering.positioned(df.select(key, user, order, clip(F.col(text), limit, CLIP_MARK).alias("_t")), user, [order, key], "position", "n_posts")
    near = ordering.neighbours(d, user, "_g", "_t", [-2, -1, 1])
    label = lambda x: F.concat(F.lit("["), F.when(x["offset"] > 0, "+").otherwise(""), x["offset"].cast("string"), F.lit("] "), x["value"])
    lines = F.array_join(F.transform("near", label), "\n")
    return d.join(near, "_g").select(key, "position", "n_posts", lines.alias("context"))


def gaps(df: DataFrame, user: str, order: str) -> DataFrame:
    """(user, n, n_wrong): users whose order numbers are not 0 to n - 1."""
    d = ordering.positioned(df.select(user, order), user, [order], "_i", "n")
    return d.groupBy(user).agg(F.max("n").alias("n"), F.count(F.when(F.col("_i") - 1 != F.col(order), 1)).alias("n_wrong")).where("n_wrong > 0")


def around_gap(cases: DataFrame, posts: DataFrame, user: str, order: str, key: str, before: int = 2, after: int = 1) -> DataFrame:
    """(case_id, n_host, earlier, later): keys of the posts around an insertion after the first ``gap`` posts of the user.

    ``cases``: case_id, user, gap.  Joined on the user; only the few positions around the gap stay.
    """
    p = positioned(posts, user, order, key).select(user, F.col(key).alias("_key"), "position", "n_posts")
    j = cases.join(p, user).where((F.col("position") > F.col("gap") - before) & (F.col("position") <= F.col("gap") + after))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("position", "_key")))), lambda x: x["_key"]), ",")
    return j.groupBy("case_id").agg(F.max("n_posts").alias("n_host"), listed(F.col("position") <= F.col("gap")).alias("earlier"), listed(F.col("position") > F.col("gap")).alias("later"))


def head_tail(raw: str | None, budget: int = TOKEN_BUDGET, cover: list[tuple[int, int]] | None = None) -> tuple[str | None, list[tuple[int, int]]]:
    """(text within the budget of tokens, kept character ranges).

    Within the budget all stays.  Else the text from its start through the head's last token and from the tail's first token
    to its end stay, by the head's share.  If none of the cover spans lies inside them, a middle from the first to the last
    of the cover (with a margin, at most half the budget, from its start) is kept too, and head and tail halve the rest.
    Ranges that meet are one.
    """
    if raw is None:
        return None, []
    at = [m.span() for m in re.finditer(r"\S+", raw)]
    if len(at) <= budget:
        return raw, [(0, len(raw))]

    def ends(head: int, tail: int) -> list[tuple[int, int]]:
        return [(0, at[head - 1][1]), (at[len(at) - tail][0], len(raw))]

    head = int(HEAD_SHARE * budget)
    keep = ends(head, budget - head)
    if cover and not any(a <= s and e <= b for s, e in cover for a, b in keep):
        low, high = min(s for s, _ in cover), max(e for _, e in cover)
        own = [i for i, (x, y) in enumerate(at) if y > low and x < high] or [next((i for i, (_, y) in enumerate(at) if y > low), len(at) - 1)]
        first = max(0, own[0] - COVER_MARGIN)
        last = min(len(at) - 1, first + min(own[-1] - own[0] + 1 + 2 * COVER_MARGIN, budget // 2) - 1)
        rest = budget - (last - first + 1)
        half = max(1, rest // 2)
        keep = sorted([*ends(half, max(1, rest - half)), (at[first][0], at[last][1])])
    merged = keep[:1]
    for a, b in keep[1:]:
        if a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return CUT_MARK.join(raw[a:b] for a, b in merged), merged


def truncated(df: DataFrame, text: str, budget: int = TOKEN_BUDGET, cover: str | None = None) -> DataFrame:
    """``df`` with short_text, n_ranges and kept (start, end).  Texts within the budget by length never leave the JVM.

    ``cover``: a column of (start, end) spans in the text.
    """
    @F.pandas_udf("struct<short_text string, n_ranges int, kept array<struct<start:int,end:int>>>")
    def cut(s: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = [head_tail(t, budget, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in (v if v is not None else [])]) for t, v in zip(s, c, strict=True)]
        return pd.DataFrame({"short_text": [o[0] for o in out], "n_ranges": [len(o[1]) for o in out], "kept": [[{"start": a, "end": b} for a, b in o[1]] for o in out]})

    span = F.col(cover) if cover else F.lit(None).cast("array<struct<start:int,end:int>>")
    small = F.coalesce(F.length(text) <= budget, F.lit(True))
    whole = F.when(F.col(text).isNull(), F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"))))
    short = df.where(small).withColumns({"short_text": F.col(text), "n_ranges": F.size(whole), "kept": whole})
    long = df.where(~small).withColumn("_c", cut(F.col(text), span))
    return short.unionByName(long.select("*", "_c.*").drop("_c"))


def inside(span: F.Column, kept: F.Column) -> F.Column:
    """Whether a (start, end) span lies within one of the kept ranges."""
    return F.exists(kept, lambda k: (span["start"] >= k["start"]) & (span["end"] <= k["end"]))
