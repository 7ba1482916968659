"""Taxonomy and constants as configuration; every operator takes them as parameters with these defaults."""

from __future__ import annotations

# The classes in order, the factors of the test set, and pinned settings.
CLASSES = ["Indicator", "Ideation", "Behavior", "Attempt"]
FACTORS = [
    "low mood", "sleep loss", "isolation", "self-blame", "good coping", "money strain", "exam pressure", "job strain", "family conflict", "peer support", "breakup grief", "bereavement",
    "chronic pain", "bullying", "plans ahead", "relocation", "legal trouble", "faith or purpose", "memory lapses", "pet at home", "identity stress", "addiction worry", "care duties", "housing worry",
]
RARE = ["memory lapses", "pet at home", "identity stress", "addiction worry", "care duties", "housing worry"]
WS = r"[\s\x1c-\x1f\x85\xa0  -     　]"
CURLY = {"‘": "'", "’": "'", "“": '"', "”": '"', " ": " "}
ELLIPSIS = "…"
EDGE_MARKS = r"[.!?,;:\"]+$"
GAP = r"\.\.\.|…"
FOLDS, RARE_MINIMUM = 5, 15
NEIGHBOUR_CLIP, REFERENCE_CLIP, CLIP_MARK = 300, 1200, " [...]"
TOKEN_BUDGET, HEAD_SHARE, COVER_MARGIN = 1024, 0.6, 4
CUT_MARK = " [...] "
WORD_RANGE = (15, 350)
TOO_LONG_WORDS, COPY_RATIO, OVERLAP_GRAM, COPY_GRAM = 700, 0.55, 8, 6
WEIGHTS = (0.4, 0.3, 0.3)
BOOTSTRAPS, BOOTSTRAP_SEED, ALPHA, ADOPTION = 2000, 20260815, 0.05, 0.01
