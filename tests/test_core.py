from __future__ import annotations

import hashlib
import itertools
import json
import math
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.config import BOOTSTRAPS, CLASSES, FACTORS, RARE
from quillspark.functions import text as T
from quillspark.operators import agreement, assembly, checks, dedup, metrics, ordering, parse, render, resample, screen, spans, thresholds, timeline
from quillspark.plans import prep, sampling, scoring
from quillspark.sources import files, staging
from quillspark.streaming.screening import screen_stream

TEXT = st.text(alphabet="ab .… '’AB\n", max_size=30)


@given(TEXT, st.integers(0, 29), st.integers(0, 29))
def test_offset_map_points_back(raw, i, j):
    m = spans.Mapped(raw)
    assert len(m.text) == len(m.starts) == len(m.ends)
    if m.text:
        a, b = sorted((i % len(m.text), j % len(m.text)))
        if m.text[a : b + 1].strip():
            x, y = m.range(a, b + 1)
            assert 0 <= x < y <= len(raw) and not raw[x].isspace() and not raw[y - 1].isspace()
            assert m.text[a : b + 1].strip() in spans.Mapped(raw[x:y]).text


@given(TEXT)
def test_normal_form_is_the_column_form(raw):
    chars = {"‘": "'", "’": "'", "“": '"', "”": '"', "…": "..."}
    assert spans.Mapped(raw).text == " ".join("".join(chars.get(c, c) for c in raw).lower().split())
    assert spans.Mapped(raw, char_map=False).text == " ".join(raw.lower().split())


@given(st.lists(st.sampled_from(["a", "a b", "b c", "a b c", "d"]), max_size=4), st.lists(st.sampled_from(["a", "a b", "b c", "c d e", "d"]), max_size=4))
@settings(max_examples=60)
def test_matching_is_largest(p, g):
    ok = lambda x, y: (x in y or y in x) and len(x.split()) <= 3 * len(y.split())
    small, large, turn = (p, g, ok) if len(p) <= len(g) else (g, p, lambda x, y: ok(y, x))
    best = max((sum(turn(x, large[k]) for x, k in zip(small, perm, strict=True)) for perm in itertools.permutations(range(len(large)), len(small))), default=0)
    assert metrics.matched(p, g) == best


@given(st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]), st.booleans()), min_size=1, max_size=12))
@settings(max_examples=60)
def test_cutoff_against_all_candidates(rows):
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = thresholds.cutoff(s, y)
    if not y.any():
        assert got == 0.5
        return
    u = np.unique(s)
    score = lambda t: 2 * (y & (s >= t)).sum() / ((s >= t).sum() + y.sum())
    cand = [0.0, 1.0, *((u[1:] + u[:-1]) / 2)]
    top = max(map(score, cand))
    assert got == max(c for c in cand if math.isclose(score(c), top))


def test_cutoffs_in_spark_equal_the_sweep(spark):
    rng = np.random.default_rng(1)
    rows = [("k%d" % (i % 3), float(round(rng.random(), 1)), bool(rng.random() < 0.4)) for i in range(120)]
    got = {r["k"]: r["tau"] for r in thresholds.best_cutoffs(spark.createDataFrame(rows, "k string, p double, y boolean"), ["k"], "p", "y").collect()}
    for k in got:
        own = [r for r in rows if r[0] == k]
        assert got[k] == pytest.approx(thresholds.cutoff(np.array([r[1] for r in own]), np.array([r[2] for r in own])))


def test_ladder_and_gap():
    raw = "First line.  It’s LATE now, and then it went on. Late now."
    rows = spans.align(["It’s LATE", "late now", "it's late now", "First ... went on", "gone ... away", "nowhere", "late now"], raw)
    assert [r["rung"] for r in rows] == ["exact", "casefold", "normalized", "split", "split", "unmatched", "casefold", "exact", "exact"]
    assert all(r["raw_slice"] == raw[r["raw_start"] : r["raw_end"]] for r in rows if r["raw_start"] >= 0)
    assert [r["parent_span_idx"] for r in rows[7:]] == [3, 3] and rows[3]["scorer_rung"] == "none" and rows[7]["scorer_rung"] == "direct"
    assert rows[6]["raw_start"] > rows[1]["raw_start"] and rows[1]["all_starts"] == rows[6]["all_starts"] and rows[1]["n_occurrences"] == 2
    assert spans.occurrences("aaa", "aa") == [0, 1] and spans.occurrences("a.b", ".") == [1] and spans.occurrences("a", "") == []
    assert spans.realign(["it's late", "First", "gone", None], raw) == ["It’s LATE", "First"]


def test_ranges_and_slices(spark):
    assert spans.ranges("aa aa", ["aa", "aa"]) == [(0, 2), (3, 5)]
    assert spans.ranges("aa", ["aa", "aa"]) is None
    assert spans.ranges(None, []) is None
    cut = lambda gold, raw: (x := spans.scorer_slice(gold, spans.Forms(raw))) and raw[x[0] : x[1]]
    assert cut("I was very tired today", "Well, I was very tiredd") == "I was very" and cut("zzz", "abc") is None
    assert cut("a b c", "x a b y b c z") == "a b" and cut("", "abc") is None and cut("tired", "so  Tired.") == "Tired."[:5] or cut("tired", "so  Tired.") is None
    rows = [("ab  cd ef", [(0, 4, "ab"), (2, 6, None), (6, 9, "ef")]), ("ab", [(1, 5, None)]), ("ab cd", [(0, 2, "xx")]), ("ab", [])]
    d = spark.createDataFrame(rows, "t string, s array<struct<start:int,end:int,text:string>>")
    got = [(r[0]["error"], r[0]["ranges"] and [tuple(x) for x in r[0]["ranges"]]) for r in d.select(spans.checked_ranges(F.col("t"), F.col("s"))).collect()]
    assert got == [(None, [(0, 2), (4, 6), (7, 9)]), ("offsets", None), ("text", None), (None, [])]


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_longest_common(a, b):
    i, n = spans.longest_common(a, b)
    cells = [(x, m) for m in range(1, len(a) + 1) for x in range(len(a) - m + 1) if a[x : x + m] in b]
    most = max((m for _, m in cells), default=0)
    assert n == most and (not n or i == min(x for x, m in cells if m == most))


def _head_tail(raw, budget, cover):
    """The rule of the truncation, spelled out for texts without blanks at their ends."""
    w = [(m.start(), m.end()) for m in re.finditer(r"\S+", raw)]
    if len(w) <= budget:
        return [(0, len(raw))]
    h = int(budget * 0.6)
    keep = [(0, w[h - 1][1]), (w[len(w) - budget + h][0], len(raw))]
    if cover and not any(any(a <= s and e <= b for a, b in keep) for s, e in cover):
        s, e = min(x for x, _ in cover), max(y for _, y in cover)
        i, j = min(k for k, x in enumerate(w) if x[1] > s), max(k for k, x in enumerate(w) if x[0] < e)
        i0 = max(0, i - 4)
        j0 = min(len(w) - 1, i0 + min(j - i + 9, budget // 2) - 1)
        rest = budget - (j0 - i0 + 1)
        h = max(1, rest // 2)
        t = max(1, rest - h)
        keep = sorted([(0, w[h - 1][1]), (w[i0][0], w[j0][1]), (w[len(w) - t][0], len(raw))])
        out = [keep[0]]
        for a, b in keep[1:]:
            out = [*out[:-1], (out[-1][0], max(b, out[-1][1]))] if a <= out[-1][1] else [*out, (a, b)]
        return out
    return keep


@given(st.integers(1, 60), st.integers(4, 30), st.lists(st.tuples(st.integers(0, 55), st.integers(1, 12)), max_size=3))
def test_head_tail(n, budget, words):
    raw = " ".join(f"w{i:02d}" for i in range(n))
    cover = [(4 * min(a, n - 1), min(4 * (a + k), len(raw))) for a, k in words if 4 * min(a, n - 1) < min(4 * (a + k), len(raw))]
    short, kept = timeline.head_tail(raw, budget, cover)
    assert kept == _head_tail(raw, budget, cover) and short == " [...] ".join(raw[a:b] for a, b in kept)


def test_head_tail_keeps_outer_blanks(spark):
    short, kept = timeline.head_tail("  " + " ".join(f"w{i}" for i in range(50)) + "\n", 10)
    assert len(kept) == 2 and short.startswith("  w0 ") and short.endswith("w49\n")
    assert timeline.head_tail("", 5) == ("", [(0, 0)]) and timeline.head_tail(None) == (None, [])
    d = timeline.truncated(spark.createDataFrame([("a b c", [(0, 1)]), (None, None)], "t string, c array<struct<start:int,end:int>>"), "t", 2, "c").collect()
    assert [(r["short_text"], r["n_ranges"], len(r["kept"])) for r in d] in ([("a [...] c", 2, 2), (None, 0, 0)], [(None, 0, 0), ("a [...] c", 2, 2)])


def test_parse_repair_resolve(spark):
    full = json.dumps({"evidence": ["Felt LOW", "absent"], "factors": {f: f == "isolation" for f in FACTORS}, "risk": "Ideation"})
    r = parse.parse_one(f"```json\n{full}\n```", "I felt low.")
    assert r == {"ok": True, "risk": "Ideation", "evidence": ["felt low"], "factors": ["isolation"], "dropped": 1}
    some = parse.parse_one('{"risk": "Ideation", "evidence": [1, " ", "low"], "factors": {"isolation": true, "zz": true}}', "Low")
    assert some == {"ok": True, "risk": "Ideation", "evidence": ["Low"], "factors": ["isolation"], "dropped": 2}
    for bad in (None, "[]", '{"risk": "x", "evidence": [], "factors": []}', '{"risk": "Ideation", "evidence": "a", "factors": []}', '{"risk": "Ideation", "evidence": [], "factors": ["zz"]}', '{"risk": "Ideation", "evidence": []}'):
        assert not parse.parse_one(bad, None)["ok"]
    rows = [("a", 0, "{", "x"), ("a", 1, full, "felt low"), ("b", 0, "{", "x"), ("c", 0, full, "nothing")]
    d = parse.repaired(parse.parsed(spark.createDataFrame(rows, "k string, i int, t string, raw string"), "t", "raw"))
    got = {x["k"]: (x["i"], x["risk"], x["parse_failure"]) for x in parse.resolved(d, "k", "i").collect()}
    assert got == {"a": (1, "Ideation", False), "b": (0, "Indicator", True), "c": (0, "Ideation", False)}


def test_factor_probabilities():
    text = '{"factors": {"isolation": true}, "risk": "Attempt"}'
    tokens = list(text)
    logs = [[(t, 0.0)] for t in tokens]
    logs[text.index("true")] = [("t", math.log(0.6)), ("false", math.log(0.2)), ("x", math.log(0.2))]
    assert parse.factor_probabilities(text, tokens, logs)["isolation"] == pytest.approx(0.75)
    assert parse.risk_steps(text, tokens, logs, 1) == [[("A", 0.0)]]


def test_class_probabilities_and_merge(spark):
    d = spark.createDataFrame([([("In", math.log(0.5)), ("I", math.log(0.3)), (' "Attempt"', math.log(0.25)), ("att", 0.0)],), ([],), (None,)], "x array<struct<tok string, lp double>>")
    p = [list(r[0]) for r in d.select(thresholds.class_probabilities(F.col("x"), CLASSES, F.lit("Behavior"))).collect()]
    assert p[0] == pytest.approx([2 / 3, 0, 0, 1 / 3]) and p[1] == p[2] == [0, 0, 1, 0]
    assert list(d.select(thresholds.class_probabilities(F.col("x"), CLASSES)).collect()[1][0]) == [0, 0, 0, 0]
    schema = "k string, probs array<double>, spans array<string>, risk string"
    a = spark.createDataFrame([("1", [0.6, 0.4, 0.0, 0.0], ["s"], "Indicator"), ("2", [0.0, 1.0, 0.0, 0.0], [], "Ideation"), ("3", [0.2, 0.0, 0.8, 0.0], [], "Behavior")], schema)
    b = spark.createDataFrame([("1", [0.1, 0.9, 0.0, 0.0], ["t"], "Ideation"), ("3", [0.2, 0.0, 0.0, 0.8], [], "Attempt"), ("4", [1.0, 0.0, 0.0, 0.0], ["z"], "Indicator")], schema)
    got = {r["k"]: (r["risk"], list(r["spans"])) for r in thresholds.merge_runs(a, b, "k", CLASSES).collect()}
    assert got == {"1": ("Ideation", ["s"]), "2": ("Ideation", []), "3": ("Behavior", []), "4": ("Indicator", [])}


def test_targets_round_trip(spark):
    d = spark.createDataFrame([("Ideation", ['say "no"\n\\'], ["isolation", "zz"]), ("Attempt", None, None)], "r string, e array<string>, f array<string>")
    for r in d.select("r", "e", render.target_list(F.col("r"), F.col("e"), F.col("f")).alias("a"), render.target_map(F.col("r"), F.col("e"), F.col("f")).alias("b")).collect():
        x, y = json.loads(r["a"]), json.loads(r["b"])
        assert x["risk"] == y["risk"] == r["r"] and x["evidence"] == (r["e"] or []) and [f for f in FACTORS if y["factors"][f]] == x["factors"]


def test_drafts_and_ratio(spark):
    rows = [("c1", 0, ["a", "b"], True), ("c1", 1, ["f", "g"], True), ("c2", 0, ["a", "b"], True), ("c2", 1, ["x"], True), ("c3", 0, None, False), ("c3", 1, ["x"], False), ("c4", 0, ["a"], True)]
    assert screen.pick_drafts(rows) == [("c1", 0, 2, 0.0), ("c2", 1, 2, 0.0), ("c3", 0, 0, None), ("c4", 0, 1, 0.5)]
    assert screen.sequence_ratio("abcd", "bcde") == 0.75
    d = spark.createDataFrame([("a", "abcd", ["zzzz", "bcde"], None), ("b", "abcd", ["zzzz"], None), ("c", "abcd", None, None), ("d", None, ["x"], None), ("e", "abcd", ["abcd"], "empty")], "k string, t string, s array<string>, r string")
    assert {x["k"]: x["r"] for x in screen.screened(d, "t", "s", "r", 0.7).collect()} == {"a": "reference_copy", "b": None, "c": None, "d": None, "e": "empty"}


def test_shown_posts_and_runs(spark):
    text = "Posts:\n[1] first one [...]\n\nmore of it\n[2] second’s here\nWrite a post."
    d = spark.createDataFrame([(text, "the second's here now and then some"), (None, "x"), ("nothing shown\nhere", None)], "p string, t string").withColumn("s", T.shown_posts(F.col("p")))
    got = d.select("s", screen.shares_gram(F.col("t"), F.col("s"), 2).alias("g"), T.match_apostrophes(F.col("t"), F.coalesce("s", F.array().cast("array<string>"))).alias("m")).collect()
    assert [r["s"] and list(r["s"]) for r in got] == [["first one [...]\n\nmore of it", "second’s here"], None, []] and [r["g"] for r in got] == [True, False, False]
    assert got[0]["m"] == "the second’s here now and then some"
    cells = spark.createDataFrame([("['a', \"b's\", 'c\\'d']",), ("[]",), ("a, b",), (None,)], "c string").select(T.literal_list(F.col("c"))).collect()
    assert [x[0] and list(x[0]) for x in cells] == [["a", "b's", "c'd"], [], None, None]


def test_components_against_union(spark):
    rng = np.random.default_rng(3)
    e = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (45, 2))]
    got = {r["node"]: r["component"] for r in dedup.connected(spark.createDataFrame([*e, (None, "n1")], "a string, b string")).collect()}
    up = {x: x for p in e for x in p}
    for _ in up:
        for a, b in e:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if any(k in p and p[0] != p[1] for p in e)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "row_id string, post string, risk string, pred string, f array<string>")
    assert dedup.exact_groups(none, "row_id", "post").count() == 0
    assert metrics.weighted_f1(metrics.class_scores(none, "risk", "pred")).first()[0] == 0.0
    assert dedup.connected(spark.createDataFrame([], "a string, b string")).count() == 0
    assert resample.upsample(none.select("row_id"), "row_id", 5, "s").count() == 0
    assert agreement.cohen_kappa(spark.createDataFrame([], "case_id string, annotator string, label string")).count() == 0


def test_nulls_and_scores(spark):
    d = spark.createDataFrame([("Ideation", "Ideation", ["a b"], ["b"]), ("Attempt", None, [], []), (None, "Attempt", None, None), ("Behavior", "Ideation", ["x y", "z"], ["z q", "x"])], "g string, p string, gs array<string>, ps array<string>")
    s = {r["label"]: (r["support"], r["tp"], r["fp"], r["fn"]) for r in metrics.class_scores(d, "g", "p").collect()}
    assert s == {"Indicator": (0, 0, 0, 0), "Ideation": (1, 1, 1, 0), "Behavior": (1, 0, 0, 1), "Attempt": (1, 0, 1, 1)}
    got = [r["phrase_f1"] for r in metrics.phrase_f1(d, "gs", "ps").select("gs", "ps", "phrase_f1").collect()]
    assert sorted(got) == [1.0, 1.0, 1.0, 1.0]
    assert {r["label"] for r in metrics.class_scores(d, "g", "p", F.lit(2.0)).where("support = 2").collect()} == {"Ideation", "Behavior", "Attempt"}


def test_text_columns(spark):
    d = spark.createDataFrame([(" A  “b”…\t",), ("",), (None,)], "t string")
    r = d.select(T.normalized(F.col("t")).alias("n"), T.ws_count(F.col("t")).alias("c"), F.size(T.ws_tokens(F.col("t"))).alias("k"), T.near_dup_key(F.col("t")).alias("key")).collect()
    assert tuple(r[0]) == ('a "b"...', 2, 2, 'a "b') and r[1]["c"] == 0 and r[1]["k"] == 0 and r[2]["n"] is None
    e = spark.createDataFrame([("intro…: a; b ;;c",), ("None",), (None,)], "t string").select(T.parse_evidence(F.col("t"))).collect()
    assert [list(x[0]) for x in e] == [["a", "b", "c"], [], []]


def test_folds_keep_groups_and_balance():
    rng = np.random.default_rng(2)
    profiles = {}
    for c in rng.integers(0, 6, (60, 4)).tolist() + [[1, 0, 0, 0]] * 33:
        profiles[tuple(c)] = profiles.get(tuple(c), 0) + 1
    folds = dedup.stratified_group_folds(list(profiles.items()))
    assert all(sum(n for c, _, n in folds if c == p) == k for p, k in profiles.items())
    per = [[sum(c[j] * n for c, g, n in folds if g == f) for j in range(4)] for f in range(5)]
    whole = [sum(x) for x in per]
    assert max(whole) - min(whole) < 0.2 * sum(whole) / 5 and all(max(x[j] for x in per) - min(x[j] for x in per) < 0.5 * sum(x[j] for x in per) / 5 for j in range(4))
    with pytest.raises(ValueError):
        dedup.stratified_group_folds([((5, 1), 3)], 5, 1)
    assert dedup.stratified_group_folds([]) == []


def test_numbers_and_neighbours(spark):
    rows = [(f"u{i % 3 if i < 40 else 9}", i * 7 % 50, f"r{i:02d}") for i in range(50)] + [(None, 1, "n1"), (None, 0, "n2")]
    d = ordering.positioned(spark.createDataFrame(rows, "u string, o int, k string").repartition(5), "u", ["o", "k"])
    got = {r["k"]: (r["position"], r["n_in_group"]) for r in d.collect()}
    for u in {r[0] for r in rows}:
        own = sorted((o, k) for v, o, k in rows if v == u)
        assert all(got[k] == (i + 1, len(own)) for i, (_, k) in enumerate(own))
    near = {r["k"]: [tuple(x) for x in r["near"]] for r in d.join(ordering.neighbours(d, "u", "_g", "k", [-2, -1, 1]), "_g").collect()}
    for u in {r[0] for r in rows}:
        own = [k for _, k in sorted((o, k) for v, o, k in rows if v == u)]
        for i, k in enumerate(own):
            assert near[k] == [(x, own[i + x]) for x in (-2, -1, 1) if 0 <= i + x < len(own)]
    assert ordering.numbered(spark.createDataFrame([], "k string"), ["k"], "n").count() == 0


def test_pinned_sets_join_clusters(spark):
    d = spark.createDataFrame([("a", "one."), ("b", "ONE"), ("c", "two"), ("d", "three"), ("e", None), ("f", "four")], "k string, t string")
    pins = spark.createDataFrame([("1", "b"), ("1", "d"), ("2", "d"), ("2", "f"), ("2", "zz")], "merge_set string, k string")
    assert {r["k"]: r["cluster"] for r in dedup.clusters(d, "k", "t", pins).collect()} == {"a": "a", "b": "a", "c": "c", "d": "a", "e": "e", "f": "a"}


def test_propagated_spans_are_aligned_anew(spark):
    preds = spark.createDataFrame([("a", ["It is late", "gone"])], "k string, spans array<string>")
    m = spark.createDataFrame([("a", "c", "It is late, gone"), ("b", "c", "so IT  IS late"), ("x", "y", "z")], "k string, cluster string, t string")
    got = {r["k"]: (list(r["spans"]), r["source"]) for r in dedup.propagate_spans(preds, m, "k", "cluster", "t").collect()}
    assert got == {"a": (["It is late", "gone"], "own"), "b": (["IT  IS late"], "representative"), "x": ([], "default")}


def test_replicates_against_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{i}", int(rng.integers(1, 9)), int(rng.integers(0, 5))) for i in range(40)] + [(None, 5, 5)]
    got = {r["b"]: (r["n"], r["hit"]) for r in resample.replicates(spark.createDataFrame(rows, "unit string, n int, hit int").repartition(3), "unit", ["n", "hit"], 50).collect()}
    number = lambda u: int(hashlib.sha256(f"boot|{u}".encode()).hexdigest()[:8], 16)
    mix = lambda x: int(resample.mixed(np.array([x % 2**32], np.uint64))[0])
    for b in range(50):
        m = [sum(mix(number(u) + mix(b * 0x9E3779B1)) >= c for c in resample.CUTS) for u, _, _ in rows[:-1]]
        assert got[b] == (sum(k * r[1] for k, r in zip(m, rows, strict=False)), sum(k * r[2] for k, r in zip(m, rows, strict=False)))
    draws = np.searchsorted(np.array(resample.CUTS, np.uint64), resample.mixed(np.arange(100_000, dtype=np.uint64)), "right")
    assert abs(draws.mean() - 1) < 0.02 and abs(draws.var() - 1) < 0.03


def test_bootstrap_scores_are_the_scores(spark):
    rng = np.random.default_rng(9)
    rows = [(f"u{i % 7}", CLASSES[rng.integers(0, 4)], CLASSES[rng.integers(0, 4)] if i % 9 else None, [f for f in FACTORS if rng.random() < 0.2], [f for f in FACTORS if rng.random() < 0.2]) for i in range(150)]
    d = spark.createDataFrame(rows, "u string, g string, p string, gf array<string>, pf array<string>")
    s = resample.sufficient(d, "u", "g", "p", "gf", "pf")
    one = resample.scores(s.agg(*[F.sum(c).cast("double").alias(c) for c in resample.STATS])).first()
    per = metrics.factor_scores(d, "gf", "pf")
    assert one["factors_macro_f1"] == pytest.approx(per.agg(F.avg("f1")).first()[0]) and one["rare_f1"] == pytest.approx(per.where(F.col("factor").isin(RARE)).agg(F.avg("f1")).first()[0])
    known = d.where("p is not null")
    assert resample.scores(resample.sufficient(known.withColumn("u", F.lit("x")), "u", "g", "p", "gf", "pf")).first()["risk_wf1"] == pytest.approx(metrics.weighted_f1(metrics.class_scores(known, "g", "p")).first()[0])


def test_consensus_rules(spark):
    rows = [("c1", "a", "Ideation", ["x y"], ["f", "g"], ["t"], 1, 3), ("c1", "b", "Ideation", ["x y", "z"], ["f"], [], 2, 2), ("c1", "c", "Attempt", ["q"], ["g"], ["t"], 5, 1), ("c2", "a", "Attempt", ["q"], [], [], 3, 3), ("c2", "b", "Ideation", ["q"], None, None, 4, 2), ("c3", "a", "Indicator", ["q"], ["f"], [], 3, 3), ("c3", "b", "Indicator", [], ["f"], [], None, 1)]
    r = spark.createDataFrame(rows, "case_id string, annotator string, risk string, evidence array<string>, factors array<string>, issue_tags array<string>, naturalness int, confidence int")
    got = {x["case_id"]: x for x in agreement.consensus(r, CLASSES).collect()}
    c1 = got["c1"]
    assert (c1["risk"], c1["evidence_from"], list(c1["evidence"]), list(c1["factors"]), list(c1["issue_tags"]), c1["confidence"], c1["naturalness"], c1["source"]) == ("Ideation", "a", ["x y"], ["f", "g"], ["t"], 2, 2.0, "majority")
    assert got["c2"]["risk"] == "Unclear" and got["c2"]["evidence_from"] == "a" and got["c2"]["confidence"] == 2
    assert got["c3"]["risk"] == "Indicator" and list(got["c3"]["evidence"]) == [] and got["c3"]["evidence_from"] is None and got["c3"]["source"] == "agreement"
    assert agreement.consensus(r.where("false"), CLASSES).count() == 0


def test_cases_share_hosts(spark):
    rows = [(f"r{i:02d}", f"u{i % 6}", CLASSES[i % 4], [RARE[i % 2], RARE[2]] if i % 3 else [RARE[i % 2]], 5 * i) for i in range(24)]
    real = spark.createDataFrame(rows, "row_id string, user string, risk string, factors array<string>, n_words int")
    hosts = spark.createDataFrame([(f"u{i}", 3 + i) for i in range(6)] + [("short", 2), (None, 9)], "user string, n_posts long")
    c = render.cases(real, hosts, RARE[:3], 30, "s", CLASSES[2:]).collect()
    assert len(c) == 30 and {x["target_factor"] for x in c} == set(RARE[:3]) and all(x["target_factor"] in x["factors"] and x["host"] != x["carrier_user"] and 1 <= x["gap"] < x["host_posts"] and 15 <= x["n_words"] <= 350 for x in c)
    uses = [sum(x["host"] == h for x in c) for h in {x["host"] for x in c}]
    assert max(uses) <= 30 // 6 + 2 and "short" not in {x["host"] for x in c}
    one = [x for x in c if x["target_factor"] == RARE[2]]
    assert {x["risk"] in CLASSES[2:] for x in one if x["serial"] % 2 == 0} == {True} and {x["risk"] in CLASSES[2:] for x in one if x["serial"] % 2} == {False}
    assert render.cases(real, hosts.where("false"), RARE[:3], 5, "s").count() == 0


def test_training_rows(spark):
    d = spark.createDataFrame([("a", "u", 0, "one two three", "Ideation", [(0, 3, "one")]), ("b", "u", 1, "four five", "Attempt", None), ("c", "u", 2, "w " * 40, "Behavior", [(60, 61, "w")]), ("d", "v", 0, "x", "Indicator", [(0, 1, "x")])], "k string, u string, o int, t string, risk string, sup array<struct<start:int,end:int,slice:string>>").withColumn("f", F.array(F.lit("isolation")))
    cover = F.when(F.col("k") != "c", F.transform("sup", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    r = {x["k"]: x for x in assembly.training_rows(assembly.inputs(d.withColumn("cover", cover), "u", "o", "k", "t", "cover", 10), "risk", "sup", "f").withColumn("focal", assembly.focal_text(F.col("input"))).collect()}
    assert {k: x["skipped"] for k, x in r.items()} == {"a": None, "b": "unalignable", "c": "truncated_out", "d": None}
    assert json.loads(r["a"]["target"])["evidence"] == ["one"] and json.loads(r["d"]["target"])["evidence"] == []
    assert r["b"]["input"] == "Post 2 of 3\n[-1] one two three\n[focal]\nfour five\n[+1] " + ("w " * 40).strip() and r["b"]["focal"] == "four five" and r["d"]["focal"] == "x"


def test_reports_and_shards(spark, tmp_path):
    d = spark.createDataFrame([(i, f"a|{i}") for i in range(300)], "i int, t string")
    files.markdown(d.orderBy("i"), "All", str(tmp_path / "r.md"))
    lines = (tmp_path / "r.md").read_text().splitlines()
    assert len(lines) == 304 and lines[4] == "| 0 | a\\|0 |"
    parts = [{r["i"] for r in files.shard(d, ["i"], k, 3).collect()} for k in range(3)]
    assert parts == [set(range(k, 300, 3)) for k in range(3)]
    (tmp_path / "new").mkdir()
    (tmp_path / "old").mkdir()
    files.publish(str(tmp_path / "new"), str(tmp_path / "old"))
    assert (tmp_path / "old").exists() and not (tmp_path / "new").exists() and not (tmp_path / "old.old").exists()
    assert files.unchanged_folds(d, d.repartition(3)) and not files.unchanged_folds(d, d.where("i > 0"))
    d.coalesce(1).write.parquet(str(tmp_path / "s.parquet"))
    assert files.read_sheet(spark, str(tmp_path / "s.parquet"), "i int, t string").count() == 300
    with pytest.raises(ValueError):
        files.read_sheet(spark, str(tmp_path / "s.parquet"), "i int")
    raw = spark.createDataFrame([("x-d0", "a", "m", "succeeded", "end_turn", "t"), ("x-d1", "a", "m", "errored", None, None), ("y-d0", "a", "m", "succeeded", "odd", None)], "custom_id string, arm string, model string, type string, stop_reason string, text string")
    assert [(r["status"], r["text"]) for r in files.result_rows(raw).orderBy("draft_id").collect()] == [("ok", "t"), ("batch_errored", ""), ("odd", "")]
    got = checks.expect(d.selectExpr("t name", "i v"), d.where("i < 299").selectExpr("t name", "i v"), "name", "v")
    assert got.where("not ok").count() == 1
    with pytest.raises(AssertionError):
        checks.demand(got)


def test_rank_correlation_p():
    # Values of Student's t distribution from printed tables.
    assert metrics.spearman_p(0.5, 20) == pytest.approx(0.02477, abs=1e-4) and metrics.spearman_p(-0.3, 24) == pytest.approx(0.1544, abs=1e-4)
    assert metrics.spearman_p(1.0, 5) == 0.0 and metrics.spearman_p(0.2, 2) is None


def test_bagged_cutoffs_are_seeded_by_place(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), f, float(round(rng.random(), 2)), bool(rng.random() < 0.3)) for i in range(150) for f in ("x", "y")] + [(0, "z", 0.4, False)]
    d = spark.createDataFrame(rows, "k int, f string, s double, y boolean")
    run = lambda bags, order: {(r["held_out"], r["f"]): r["tau"] for r in thresholds.bagged_cutoffs(d, "k", "f", "s", "y", bags, 1, order).collect()}
    a = run(40, ["x", "y", "z"])
    assert a == run(40, ["x", "y", "z"]) and a != run(40, ["y", "x", "z"]) and a[1, "z"] == 0.5
    assert {r["pred"] for r in thresholds.fitted(d, "k", "f", "s", "y").collect()} == {True, False}
    own = [(s, y) for k, f, s, y in rows if k != 0 and f == "x"]
    s, y = np.array([r[0] for r in own]), np.array([r[1] for r in own])
    boot = [thresholds.cutoff(s[i], y[i]) for i in (rng.integers(0, len(s), len(s)) for _ in range(300)) if y[i].any()]
    assert abs(run(300, ["x", "y", "z"])[0, "x"] - np.mean(boot)) < 0.08


def test_factor_probes_hold_few_rows():
    """A batch of any size is worked on in small parts, whose rows are handed on before the next are made."""
    import pyarrow as pa

    step = [[{"tok": "true", "lp": 0.0}]]
    rows = [{"k": i, "t": '"a":true' if i else None, "n": ['"a":', "true"], "g": [[]] + step} for i in range(1000)]
    parts = list(parse.with_probabilities(iter([pa.RecordBatch.from_pylist(rows)]), "t", "n", "g", ["a", "b"]))
    assert max(p.num_rows for p in parts) <= parse.FEW
    got = [r for p in parts for r in p.to_pylist()]
    assert [r["k"] for r in got] == list(range(1000)) and got[0]["p_true"] is None and all(dict(r["p_true"]) == {"a": 1.0, "b": 0.0} for r in got[1:])


def test_places_are_staged_once_without_texts(spark, monkeypatch):
    """What was ranged is gone once it is numbered, shuffle files go with their query, and inputs are made from ordered keys."""
    from quillspark.sources import staging

    written = []
    real = staging.stage
    for module in (ordering, assembly):
        monkeypatch.setattr(module, "stage", lambda df, label: written.append((label, df.columns)) or real(df, label))
    own = staging._own(spark).removeprefix("file://")
    d = spark.createDataFrame([(f"k{i}", "u", i, "some text", [(0, 4)]) for i in range(9)], "k string, u string, o long, t string, cover array<struct<start:int,end:int>>")
    before = set(os.listdir(own)) if os.path.isdir(own) else set()
    got = assembly.inputs(d, "u", "o", "k", "t", "cover").collect()
    assert sorted(r["position"] for r in got) == list(range(1, 10)) and all("[focal]" in r["input"] for r in got)
    assert {x.split("-")[0] for x in set(os.listdir(own)) - before} == {"numbered", "near"}
    assert all("t" not in columns for _, columns in written)
    assert spark.conf.get(staging.CLEAN) == "false"


def test_files(spark, tmp_path):
    assert files.canonical({"a": -0.0, "b": [np.float64(1 / 3), np.int64(2)]}) == {"a": 0.0, "b": [0.33333333, 2]}
    files.write_jsonl(spark.createDataFrame([("b", 1), ("a", 2)], "k string, fold int"), str(tmp_path / "x"), "k")
    back = files.read_jsonl(spark, str(tmp_path / "x"), "k string, fold int", 2)
    assert [r["k"] for r in back.collect()] == ["a"]
    (tmp_path / "in.txt").write_text("1")
    m = files.Manifest(str(tmp_path / "m.json"))
    m.record("s", {"a": 1}, [str(tmp_path / "in.txt")], [])
    again = files.Manifest(str(tmp_path / "m.json"))
    assert again.unchanged("s", {"a": 1}, [str(tmp_path / "in.txt")])
    (tmp_path / "in.txt").write_text("2")
    assert again.stale_inputs("s") == ["in.txt"]
    again.check_upstream("s")
    with pytest.raises(RuntimeError):
        again.check_upstream("s", "never")
    assert files.merge_parts(spark, [str(tmp_path / "x"), str(tmp_path / "none")], "k string") is None and files.merge_parts(spark, [str(tmp_path / "x")], "k string").count() == 2
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string"), spark.createDataFrame([(2, "y"), (1, "x")], "i int, s string")
    assert checks.digest(a).first() == checks.digest(b).first()


def test_staged_tables_are_discarded(spark):
    path = staging._own(spark).removeprefix("file://")
    d = staging.stage(spark.range(3).toDF("id"))
    assert d.count() == 3 and os.listdir(path)
    staging.discard(spark)
    assert not os.path.exists(path)


def test_streamed_screening(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {"1": "I cannot write this", "2": "fine", "3": "w1 w2 w3 w4 w5 w6 w7 w8 w9", "4": "s1 s2 s3 s4 s5 s6"}
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"draft_id": k, "case_id": "c", "text": t, "status": "ok"}) + "\n" for k, t in texts.items()))
    run = lambda sink, **more: screen_stream(spark, str(tmp_path / "in"), str(tmp_path / sink), str(tmp_path / f"{sink}-cp"), "cannot write", **more).awaitTermination()
    read = lambda sink: {r["draft_id"]: r["reason"] for r in spark.read.parquet(str(tmp_path / sink)).collect()}
    run("out")
    assert read("out") == {"1": "soft_refusal", "2": None, "3": None, "4": None}
    corpus = spark.createDataFrame([("x w1 w2 w3 w4 w5 w6 w7 w8 w9 y",)], "post_raw string")
    run("all", corpus=corpus, prompts=spark.createDataFrame([("c", "Posts:\n[1] s1 s2 s3 s4 s5 s6 and more of it\nWrite.")], "case_id string, user_text string"))
    assert read("all") == {"1": "soft_refusal", "2": None, "3": "real_overlap", "4": "reference_copy"}


def _tables(spark, at, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(at / f"{name}.parquet"))
    return str(at)


def test_screening_runs_of_eight_and_six(spark, tmp_path):
    w = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    texts = {"post8": f"x y {w('p', 8)} z", "post7": f"x y {w('p', 7)} z", "prompt6": f"x y {w('q', 6)} z", "prompt5": f"x y {w('q', 5)} z"}
    d = _tables(
        spark,
        tmp_path,
        outputs=([(k, "c", v, "ok", 0, "a") for k, v in texts.items()], "draft_id string, case_id string, text string, status string, draft int, arm string"),
        prompts=([("c", f"Posts:\n[1] {w('q', 6)} {w('r', 60)}\nWrite one with {w('z', 9)}."), ("K0C1", "x")], "case_id string, user_text string"),
        posts=([("r", f"{w('p', 8)} {w('s', 60)}")], "row_id string, post_raw string"),
    )
    got = {r["draft_id"]: r["reason"] for r in prep.screening_cascade(spark, d).collect()}
    assert got == {"post8": "real_overlap", "post7": "passed", "prompt6": "reference_copy", "prompt5": "passed"}


def test_drafts_are_compared_within_their_factor(spark, tmp_path):
    one, two = "one two three four five six", "seven eight nine ten eleven twelve"
    cases = [f"K0C{i:08d}" for i in range(40)]
    d = _tables(
        spark,
        tmp_path,
        outputs=([(f"{c}-d{k}", c, t, "ok", k, "a") for c in cases for k, t in enumerate((one, two))], "draft_id string, case_id string, text string, status string, draft int, arm string"),
        prompts=([(c, "Posts:\n[1] something else\nWrite.") for c in cases], "case_id string, user_text string"),
        posts=([("r", "a real post of its own")], "row_id string, post_raw string"),
    )
    got = {}
    for r in prep.draft_selection(spark, d).collect():
        got.setdefault(r["target_factor"], []).append((r["case_id"], r["draft"], r["n_passing"]))
    assert sum(map(len, got.values())) == 40
    for rows in got.values():
        # The first case of a factor keeps its first draft, the second the other one, and then both are equally known.
        assert [k for _, k, _ in sorted(rows)] == [min(i, 1) if i < 2 else 0 for i in range(len(rows))]


def test_kept_index_against_all_pairs():
    rng = np.random.default_rng(5)
    kept, sets = screen.Kept(), []
    for _ in range(60):
        g = frozenset(rng.choice(list("abcdefg"), rng.integers(0, 6)).tolist())
        assert kept.likeness(g) == max((len(g & k) / len(g | k) if g | k else 0.0 for k in sets), default=0.0)
        kept.add(g)
        sets.append(g)


def test_audit_pick_sees_all_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    factors = [["pet at home"] if i % 211 == 7 else ["housing worry", "low mood"] if i % 300 == 1 else ["low mood"] for i in range(3000)]
    risks = [CLASSES[min(3, k)] for k in rng.geometric(0.5, 3000) - 1]
    gold = [(f"r{i}", risks[i], [], factors[i], 1.0, 0) for i in range(3000)]
    d = _tables(spark, tmp_path, gold=(gold, "row_id string, risk_norm string, gold_eval_spans array<string>, factors_set array<string>, train_weight double, fold int"))
    got = {r["row_id"] for r in sampling.audit_pick(spark, d).collect()}
    rank = lambda i: hashlib.sha256(f"audit|r{i}".encode()).hexdigest()
    rows = [{"row_id": f"r{i}", "risk": risks[i], "factors": factors[i]} for i in sorted(range(3000), key=rank)]
    counts = spark.createDataFrame([(c, risks.count(c)) for c in CLASSES], "risk string, n long")
    quota = {r["risk"]: r["quota"] for r in resample.largest_remainder(counts, "risk", "n", 48).collect()}
    assert got == {r["row_id"] for r in resample.quota_pick(rows, "risk", RARE, quota, 4)} and len(got) == 48
    assert all(sum(f in factors[int(k[1:])] for k in got) >= 4 for f in ("pet at home", "housing worry"))


def test_folds_split_no_component(spark, tmp_path):
    rows = [(f"r{i:03d}", f"text number {i // 2 if i % 4 == 1 else i}", f"u{i % 40}", "train") for i in range(120)]
    rows += [("s0", "Copied text.", "v0", "train"), ("s1", "copied  text", "v1", "train"), ("s2", "other", "v1", "train"), ("s3", "alone", None, "train"), ("t", "elsewhere", "v0", "test")]
    gold = [(r[0], CLASSES[i % 4], [], [], 1.0, 0) for i, r in enumerate(rows[:-2])]
    d = _tables(
        spark,
        tmp_path,
        posts=(rows, "row_id string, post_raw string, anon_user_id string, split string"),
        gold=(gold, "row_id string, risk_norm string, gold_eval_spans array<string>, factors_set array<string>, train_weight double, fold int"),
    )
    got = {r["row_id"]: (r["component"], r["fold"]) for r in prep.stratified_folds(spark, d).collect()}
    assert set(got) == {r[0] for r in rows[:-1]}
    assert len({got[k] for k in ("s0", "s1", "s2")}) == 1
    for field in (lambda r: r[2] or r[0], lambda r: r[1]):
        groups = {}
        for r in rows[:123]:
            groups.setdefault(field(r), set()).add(got[r[0]])
        assert all(len(g) == 1 for g in groups.values())
    assert len({c for c, _ in got.values()}) == len(set(got.values())) and {f for _, f in got.values()} == set(range(5))


def test_scoring_queries_cover_the_whole_job(spark, tmp_path):
    gold = [(f"r{i}", CLASSES[i % 4], [], [FACTORS[i % 24], FACTORS[-1]], 1.0, i % 5) for i in range(240)]
    d = _tables(
        spark,
        tmp_path,
        gold=(gold, "row_id string, risk_norm string, gold_eval_spans array<string>, factors_set array<string>, train_weight double, fold int"),
        posts=([(f"r{i}", f"u{i % 30}") for i in range(240)], "row_id string, anon_user_id string"),
    )
    for q in (scoring.nested_thresholds, scoring.threshold_apply, scoring.rank_auc):
        assert {r["factor"] for r in q(spark, d).select("factor").collect()} == set(FACTORS)
    assert {r["n"] for r in sampling.user_bootstrap_ci(spark, d).collect()} == {BOOTSTRAPS} and sampling.pinned_bootstrap(spark, d).first()["n"] == BOOTSTRAPS
    stats = sampling._arm_stats(spark, d, "s1").select("unit", "n", F.col("c00").alias("hit"))
    units = sorted(r["unit"] for r in stats.collect())
    two = [resample.pinned_bootstrap(stats, "unit", ["n", "hit"], 40), resample.bootstrap(stats, resample.draws(spark, units, 40), "unit", ["n", "hit"])]
    assert len(units) == 30 and len({tuple(sorted(map(tuple, x.select("b", "n", "hit").collect()))) for x in two}) == 1
    bag = {(r["held_out"], r["factor"]): r["tau"] for r in scoring.bagged_thresholds(spark, d).where("held_out = 0").collect()}
    whole = thresholds.bagged_cutoffs(scoring._long_scores(spark, d), "fold", "factor", "p", "y", 200, order=FACTORS).where("held_out = 0").collect()
    assert len(bag) == 24 and bag == {(r["held_out"], r["factor"]): r["tau"] for r in whole}


def test_counted_cutoff_is_the_cutoff():
    rng = np.random.default_rng(6)
    for _ in range(80):
        s, y = rng.integers(0, 8, 20) / 7, rng.random(20) < 0.3
        u, at = np.unique(s, return_inverse=True)
        i = rng.integers(0, 20, 20)
        if y[i].any():
            assert thresholds.counted_cutoff(u, np.bincount(at[i], minlength=len(u)), np.bincount(at[i][y[i]], minlength=len(u))) == thresholds.cutoff(s[i], y[i])
