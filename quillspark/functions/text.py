"""Text expressions: pure Catalyst columns, no Python in the row path.  Null in gives null out unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.config import CLASSES, CURLY, ELLIPSIS, WS


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: the optimizer would repeat it wherever it stands, even per element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ws_trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def ws_collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def char_map(c: Column) -> Column:
    """Curly quotes straight, ellipsis as three dots, no-break space as space."""
    return F.replace(F.translate(c, "".join(CURLY), "".join(CURLY.values())), F.lit(ELLIPSIS), F.lit("..."))


def normalized(c: Column) -> Column:
    """Character map, white space collapsed and stripped, lower case."""
    return F.lower(ws_trim(ws_collapse(char_map(c))))


def scorer_norm(c: Column) -> Column:
    """Lower case, stripped, white space collapsed; the scorer's form."""
    return F.lower(ws_trim(ws_collapse(c)))


def near_dup_key(c: Column) -> Column:
    """Normalised text with runs of dots as one and without closing marks."""
    return F.regexp_replace(F.regexp_replace(normalized(c), r"\.{2,}", "."), r'[.!?\s"]+$', "")


def ws_tokens(c: Column) -> Column:
    """Tokens between white space; an empty list for blank text."""
    return let(ws_trim(ws_collapse(c)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " ")))


def ws_count(c: Column) -> Column:
    """Number of tokens between white space."""
    return let(ws_trim(ws_collapse(c)), lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1))


def alpha_tokens(c: Column) -> Column:
    """Lower-case tokens of ASCII letters and apostrophes."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), 1)


def grams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by spaces, distinct; empty where there are fewer."""
    def runs(w: Column) -> Column:
        return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))))

    return let(tokens, runs)


def risk_norm(c: Column) -> Column:
    """The class name of any spelling, else null."""
    t = F.initcap(F.regexp_replace(ws_trim(c), r"[^A-Za-z]+", ""))
    return F.when(t.isin(CLASSES), t)


def risk_ord(c: Column) -> Column:
    """0 to 3 of a class name, else null."""
    at = F.array_position(F.array(*map(F.lit, CLASSES)), c)
    return F.when(at > 0, (at - 1).cast("int"))


def parse_evidence(c: Column) -> Column:
    """Evidence cell to spans: null and none are empty, a leaked preamble up to an ellipsis and colon goes, parts by ;."""
    t = F.regexp_replace(c, r"(?s)^.*?\x{2026}:\s*", "")
    parts = F.filter(F.transform(F.split(t, ";"), ws_trim), lambda x: x != "")
    return F.when(c.isNull() | (F.lower(ws_trim(t)) == "none"), F.array().cast("array<string>")).otherwise(parts)


def in_taxonomy(items: Column, taxonomy: list[str]) -> Column:
    """Items of the list that the taxonomy has, in its order."""
    return F.filter(F.array(*map(F.lit, taxonomy)), lambda f: F.coalesce(F.array_contains(items, f), F.lit(False)))


def clean_post(c: Column) -> Column:
    """Stripped, without one pair of the same straight quote around it."""
    t = ws_trim(c)
    outer = t.rlike('(?s)^".*"$') | t.rlike("(?s)^'.*'$")
    return F.when(outer & (F.length(t) >= 2), ws_trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def match_apostrophes(post: Column, around: Column) -> Column:
    """Curly apostrophes if the surrounding posts (an array of texts) have more curly than straight ones."""
    whole = F.array_join(around, "")
    n = lambda ch: F.length(whole) - F.length(F.replace(whole, F.lit(ch), F.lit("")))
    return F.when(n("’") > n("'"), F.replace(post, F.lit("'"), F.lit("’"))).otherwise(post)


def shown_posts(prompt: Column) -> Column:
    """The numbered posts that a rendered prompt shows, without their clip marks; what stands before the first number and the
    request in the last line are no posts.  Null for a null prompt."""
    body = F.regexp_replace(prompt, r"\n[^\n]*$", "")
    parts = F.split(body, r"(?m)^\[[0-9]+\] ?")
    return F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ws_trim(F.regexp_replace(x, r"\s*\[\.\.\.\]\s*$", ""))), lambda x: x != "")


def focal(rendered: Column, start: str = "[?] ", after: str = "\n[") -> Column:
    """The focal text of a rendered timeline: what stands behind the start mark, up to the next mark; null without a start."""
    t = F.substring_index(rendered, start, -1)
    return F.when(F.contains(rendered, F.lit(start)), F.substring_index(t, after, 1))


def clip(c: Column, limit: int, mark: str) -> Column:
    """White space collapsed; beyond the limit cut, right-stripped and marked."""
    t = ws_trim(ws_collapse(c))
    return F.when(F.length(t) > limit, F.concat(F.regexp_replace(F.substring(t, 1, limit), f"{WS}+$", ""), F.lit(mark))).otherwise(t)


def strip_fence(c: Column) -> Column:
    """Model text without a surrounding code fence."""
    return ws_trim(F.regexp_replace(ws_trim(c), r"(?s)^```[A-Za-z0-9]*\s*\n?|\n?```$", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stable_rank(*parts: Column) -> Column:
    """The canonical sampler: sha-256 of the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def literal_list(c: Column) -> Column:
    """A cell with a list of quoted strings, either quote, as an array; null for anything else.

    Items may hold the other quote, and their own quote behind a backslash.
    """
    item = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
    whole = ws_trim(c).rlike(rf"^\[\s*(?:(?:{item})(?:\s*,\s*(?:{item}))*)?\s*,?\s*\]$")
    bare = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
    return F.when(whole, F.transform(F.regexp_extract_all(c, F.lit(f"({item})"), 1), bare))


def stable_number(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 from the first eight hex digits of the stable rank."""
    return F.conv(F.substring(stable_rank(*parts), 1, 8), 16, 10).cast("long")


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 with 0 where nothing is there."""
    den = 2 * tp + fp + fn
    return F.when(den > 0, 2.0 * tp / den).otherwise(0.0)


def official_match(pred: Column, gold: Column, limit: int = 3) -> Column:
    """Containment either way on scorer forms, with at most ``limit`` times the gold's tokens; false for blanks."""
    p, g = scorer_norm(pred), scorer_norm(gold)
    return (p != "") & (g != "") & (F.contains(p, g) | F.contains(g, p)) & (ws_count(pred) <= limit * ws_count(gold))
