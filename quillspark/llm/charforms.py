"""Problem 7: text that looks ordinary but is made of other characters.

Each token gets the intersection of its letters' *resolved script sets*: a letter that has a look-alike in another script
counts for both scripts, Latin letters too.  A token whose own letters mix scripts, or whose letters are all look-alikes of
the script around it, is respelled in the one script that the intersection leaves, which need not be Latin.  The other forms (full width, mathematical letters,
invisible characters, odd blanks, accents kept apart from their letter) are then brought to the ordinary form.

Defined results: null text gives null and no flag; empty text stays empty; whole texts are processed, however long.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters that they look like.
CYRILLIC = dict(zip("аеорсухіѕјԁһԛԝґАВЕКМНОРСТУХЅІЈԚԜҮ", "aeopcyxisjdhqwrABEKMHOPCTYXSIJQWY", strict=True)) | {"ӏ": "l", "Ӏ": "I", "ү": "y"}
GREEK = dict(zip("αοντιρυκγχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aovtipukyxABEZHIKMNOPTYX", strict=True))
ARMENIAN = dict(zip("օսոհցզԼՍՕ", "ounhgqLUO", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏃᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHZWVSLCPKB", strict=True))
LISU = dict(zip("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ", strict=True))
COPTIC = dict(zip("ⲟⲣⲥⲓⲞⲢⲤⲒⲔⲘⲚⲦⲨ", "opciOPCIKMNTY", strict=True))
LATIN_EXTRA = {"ɑ": "a", "ɡ": "g", "ı": "i", "ꞵ": "b", "ƽ": "s"}
LOOKALIKE = {"Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE, "Lisu": LISU, "Coptic": COPTIC}
# Small capitals, by their names: each imitates the small letter.
for _n in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800)):
    _name = unicodedata.name(chr(_n), "").removeprefix("LATIN LETTER SMALL CAPITAL ")
    if len(_name) == 1:
        LATIN_EXTRA[chr(_n)] = _name.lower()
# Marks that imitate an ordinary one (typographic quotes are ordinary and not listed).
MARKS = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "․": ".", "ꓸ": ".", "։": ":", "꞉": ":", "∶": ":", ";": ";", "‚": ",", "ǃ": "!", "⁄": "/", "∕": "/", "∣": "|"}

_FROM_SCRIPT = {c: (script, to) for script, table in LOOKALIKE.items() for c, to in table.items()}
#: Latin letters and the letters of each other script that look like them, the first of several.
_TO_SCRIPT: dict[str, dict[str, str]] = {script: {} for script in LOOKALIKE}
for _c, (_script, _to) in _FROM_SCRIPT.items():
    _TO_SCRIPT[_script].setdefault(_to, _c)
_SCRIPT_RANGES = (("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x530, 0x58F), ("Cherokee", 0x13A0, 0x13FF), ("Lisu", 0xA4D0, 0xA4FF), ("Coptic", 0x2C80, 0x2CFF))
_BLANK = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     ⠀　]")
_EMOJI = "[©®‼-↪⌚-⏿▪-➿⤴-⭕〰〽㊗㊙\U0001f000-\U0001faff]"
_INVISIBLE = re.compile("[\xad͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff]")
_IN_EMOJI = re.compile(f"(?<={_EMOJI})[︎️]?‍(?={_EMOJI})|(?<={_EMOJI})[︎️]|(?<=[0-9#*])️(?=⃣)")
_WIDE = re.compile("[Ⅰ-ⅿ！-～\U0001d400-\U0001d7ffﬀ-ﬆ｡-ﾜℂℊ-ℓℕℙ-ℝℤℨ-ℭℯ-ℴ]+")
_APART = re.compile("[^\\W\\d_][̀-ͯ]+")
_TOKEN = re.compile("[^\\W_]+", re.UNICODE)
_MARK = re.compile("[" + "".join(map(re.escape, MARKS)) + "]")
#: What no rule here can touch: a text made of these alone is in the one form already.  Used as a scan-side filter.
PLAIN = "^[\\t\\n\\r\\x20-\\x7e¡-¨ª-¬¯-İĲ-Ƽƾ-ɏ–—‘’“-„†-•…€]*$"


def script_of(c: str) -> str:
    """The script of a letter, as far as it matters here: Latin, one with look-alikes of Latin, or Other."""
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "Latin"
    for name, low, high in _SCRIPT_RANGES:
        if low <= n <= high:
            return name
    return "Latin" if c in LATIN_EXTRA else "Other"


def resolved_scripts(token: str) -> set[str]:
    """Intersection over the token's letters of the scripts that each letter can belong to by its look."""
    left: set[str] | None = None
    for c in token:
        if c.isalpha():
            latin = _FROM_SCRIPT[c][1] if c in _FROM_SCRIPT else LATIN_EXTRA.get(c, c)
            own = {script_of(c), *(k for k, table in _TO_SCRIPT.items() if latin in table)} | ({"Latin"} if c in _FROM_SCRIPT else set())
            left = own if left is None else left & own
    return left if left is not None else {"Latin"}


def _in_script(c: str, script: str) -> str:
    """The letter as it looks in the script, or itself."""
    if not c.isalpha() or script_of(c) == script and c not in LATIN_EXTRA:
        return c
    latin = _FROM_SCRIPT[c][1] if c in _FROM_SCRIPT else LATIN_EXTRA.get(c, c)
    return latin if script == "Latin" else _TO_SCRIPT.get(script, {}).get(latin, c)


def respell(token: str, around: str = "Latin") -> str:
    """The token in its one consistent script.

    Mixed scripts go to the script that the intersection leaves; to Latin if it leaves that too, unless the text around is in
    another script that it leaves and fewer of the token's letters are Latin.  If nothing is left, look-alikes follow Latin
    letters of the token.  A whole-script confusable (all letters look Latin, none is) follows the script ``around`` it.  A
    word wholly in another script stays.
    """
    letters = [script_of(c) for c in token if c.isalpha()]
    own = set(letters)
    if own <= {"Latin"}:
        return "".join(LATIN_EXTRA.get(c, c) for c in token)
    left = resolved_scripts(token)
    if len(own) == 1:
        return "".join(_in_script(c, "Latin") for c in token) if "Latin" in left and around == "Latin" else token
    others = sorted(left & own - {"Latin"})
    if "Latin" in left and not (others and around != "Latin" and 2 * letters.count("Latin") < len(letters)):
        return "".join(_in_script(c, "Latin") for c in token)
    if others:
        return "".join(_in_script(c, others[0]) for c in token)
    return "".join(_in_script(c, "Latin") for c in token) if "Latin" in own else token


def _around(text: str) -> str:
    latin = other = 0
    for w in _TOKEN.findall(text):
        own = {script_of(c) for c in w if c.isalpha()}
        latin += own == {"Latin"}
        other += bool(own) and "Latin" not in own and "Latin" not in resolved_scripts(w)
    return "Latin" if latin > other else "Other"


def one_form(text: str | None) -> str | None:
    """The text in its one form; case, quotes, emoji and words wholly in another script stay as they are."""
    if text is None or text.isascii() and not _BLANK.search(text):
        return text
    kept = _IN_EMOJI.sub(lambda m: m[0].translate({0xFE0E: 0xF0000, 0xFE0F: 0xF0001, 0x200D: 0xF0002}), text)
    out = _INVISIBLE.sub("", kept)
    out = _BLANK.sub(" ", out)
    out = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), out)
    out = _MARK.sub(lambda m: MARKS[m[0]], out)
    out = unicodedata.normalize("NFC", out)
    if any(c in _FROM_SCRIPT or c in LATIN_EXTRA for c in out):
        around = _around(out)
        out = _TOKEN.sub(lambda m: m[0] if m[0].isascii() else respell(m[0], around), out)
    return out.translate({0xF0000: 0xFE0E, 0xF0001: 0xFE0F, 0xF0002: 0x200D})


def has_other_forms(text: str | None) -> bool:
    """Whether the text holds any character form that :func:`one_form` changes."""
    return bool(text) and (one_form(text) != text or bool(_APART.search(text)))


def look_same(a: str | None, b: str | None) -> bool:
    """Whether two texts differ in characters but not in look.  False if either is null."""
    return a is not None and b is not None and a != b and one_form(a) == one_form(b)


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, c = b.column("a").to_pylist(), b.column("b").to_pylist()
        span = b.column("span_idx").to_pylist()
        keep = [has_other_forms(x) if s < 0 else look_same(x, y) for x, y, s in zip(a, c, span, strict=True)]
        yield b.select(["row_id", "span_idx"]).filter(pa.array(keep, pa.bool_()))


def other_form_texts(posts: DataFrame, spans: DataFrame) -> DataFrame:
    """(row_id, span_idx): posts (span_idx -1) with other character forms, and spans that look like their slice but differ.

    Null ids, span numbers or texts give no row; a negative span_idx in ``spans`` is no span; repeated rows give one.  The
    scan-side filter leaves out only texts that no rule can touch, or span pairs that are equal or both plain.
    """
    p = posts.select("row_id", F.lit(-1).alias("span_idx"), F.col("post_raw").alias("a"), F.lit(None).cast("string").alias("b")).where(~F.col("a").rlike(PLAIN))
    s = spans.select("row_id", F.col("span_idx").cast("int").alias("span_idx"), F.col("text_gold").alias("a"), F.col("raw_slice").alias("b"))
    s = s.where((F.col("span_idx") >= 0) & (F.col("a") != F.col("b")) & ~(F.col("a").rlike(PLAIN) & F.col("b").rlike(PLAIN)))
    both = p.unionByName(s).where(F.col("row_id").isNotNull())
    return both.mapInArrow(_flags, "row_id string, span_idx int").distinct()


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("one_form")
        yield b.set_column(at, "one_form", pa.array([one_form(x) for x in b.column("one_form").to_pylist()], pa.string()))


def with_one_form(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` and the column's text in its one form as ``to``; texts that are plain never leave the JVM."""
    @F.pandas_udf("string")
    def convert(s):  # noqa: ANN001, ANN202
        return s.map(one_form, na_action="ignore")

    c = F.col(column)
    plain = df.where(c.isNull() | c.rlike(PLAIN)).withColumn(to, c)
    return plain.unionByName(df.where(~c.rlike(PLAIN)).withColumn(to, convert(c)))


def found_spans(posts: DataFrame, spans: DataFrame) -> DataFrame:
    """(row_id, span_idx, as_given, in_one_form): whether text_gold is found in its post, before and after.

    A null span text or post is not found; rows without a post give false.  A row delivered twice counts once.
    """
    p = with_one_form(posts.select("row_id", "post_raw").where(F.col("row_id").isNotNull()), "post_raw", "post_form").groupBy("row_id").agg(F.max(F.struct("post_raw", "post_form")).alias("p")).select("row_id", "p.*")
    s = with_one_form(spans.select("row_id", "span_idx", "text_gold").distinct(), "text_gold", "gold_form")
    j = s.join(p, "row_id", "left")
    found = lambda t, g: F.coalesce(F.col(t).contains(F.col(g)), F.lit(False))
    return j.groupBy("row_id", "span_idx").agg(F.max(found("post_raw", "text_gold")).alias("as_given"), F.max(found("post_form", "gold_form")).alias("in_one_form"))
