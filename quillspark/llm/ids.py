"""Keys that are not always written alike, and entries that say nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entries that stand for nothing.
MEANINGLESS = ["", "n/a", "na", "null", "none", "nan", "unknown", "tbd", "?", "-", "--", "."]
_UNSEEN = "[\\p{Cf}\\p{Z}\\p{Cc}]+"


def said(c: Column) -> Column:
    """The text, or null where it says nothing."""
    t = F.lower(F.regexp_replace(c, f"^{_UNSEEN}|{_UNSEEN}$", ""))
    return F.when(~t.isin(MEANINGLESS), F.regexp_replace(c, f"^{_UNSEEN}|{_UNSEEN}$", ""))


def person(c: Column) -> Column:
    """A person's id in one spelling: no invisible characters, blanks or marks, lower case, no leading zeros of a number."""
    t = F.regexp_replace(F.lower(said(c)), "[^\\p{L}\\p{N}]+", "")
    return F.when(t != "", F.regexp_replace(t, "^(\\p{L}*)0+(?=\\p{N})", "$1"))


def slug(c: Column) -> Column:
    """A name in one spelling: lower case words joined by underscores."""
    t = F.regexp_replace(F.regexp_replace(F.lower(said(c)), "[^\\p{L}\\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(t != "", t)


def some(items: Column) -> Column:
    """Whether a list holds an entry that says something."""
    return F.coalesce(F.exists(items, lambda x: said(x).isNotNull()), F.lit(False))
