from __future__ import annotations

import pathlib
import random
import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import charforms, consensus, crosssplit, leakage, mixing, neardup, pairs, representative, spans, splits, subjects, unionfind
from quillspark.llm.language import language
from quillspark.llm.words import Codes, coded, mixed, overlap, shingles, words
from quillspark.sources import staging

RNG = random.Random(4)
VOCABULARY = ["".join(RNG.choices(string.ascii_lowercase, k=RNG.randint(2, 8))) for _ in range(400)]


def text(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def edited(t: str, seed: int, edits: int = 2) -> str:
    r, w = random.Random(seed), t.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = "zzz"
    return " ".join(w).upper() + "!"


# Problem 7


def test_character_forms():
    same = {"ｗｅｎｔ": "went", "сuѕtоdу": "custody", "a​b": "ab", "café": "café", "a b c": "a b c", "pаy": "pay", "сору this text now": "copy this text now", "пpивет": "привет", "ⅼine": "line", "ꓮꓐ now": "AB now", "ʀеd": "red", "ƽeven": "seven"}
    for a, b in same.items():
        assert charforms.one_form(a) == b and charforms.has_other_forms(a) and charforms.look_same(a, b)
    for t in ("👨‍👩‍👧", "🏳️‍🌈", "тихая река", "“naïve” café\n\tx", "καλημέρα", "", None, "it’s"):
        assert not charforms.has_other_forms(t) and charforms.one_form(t) == t
    assert not charforms.look_same("it’s", "it's") and not charforms.look_same(None, "a") and not charforms.look_same("a  b", "a b")


@given(st.text(max_size=30))
def test_one_form_is_stable_and_plain_filter_is_safe(t):
    once = charforms.one_form(t)
    assert charforms.one_form(once) == once
    import re

    if re.search(charforms.PLAIN, t) and not t.endswith("\n"):
        assert not charforms.has_other_forms(t)


def test_other_form_rows(spark):
    p = spark.createDataFrame([("a", "plаin"), ("a", "plаin"), ("b", "plain"), ("c", None), (None, "x​")], "row_id string, post_raw string")
    s = spark.createDataFrame([("b", 0, "plain", "plаin"), ("b", 1, "plain", "Plain"), ("b", None, "x​", "x"), ("b", -1, "x​", "x"), ("b", 2, None, "x")], "row_id string, span_idx int, text_gold string, raw_slice string")
    assert {tuple(r) for r in charforms.other_form_texts(p, s).collect()} == {("a", -1), ("b", 0)}
    f = {(r["row_id"], r["span_idx"]): r["in_one_form"] for r in charforms.found_spans(p.where("row_id = 'a'"), spark.createDataFrame([("a", 0, "plain"), ("x", 1, "q")], "row_id string, span_idx int, text_gold string")).collect()}
    assert f == {("a", 0): True, ("x", 1): False}


# Near-duplicates, problems 2 to 4


def _corpus() -> list[tuple[str, str]]:
    rows = []
    for i in range(60):
        t = text(60, i)
        rows.append((f"r{i:03d}", t))
        if i % 4 == 0:
            rows.append((f"e{i:03d}", edited(t, i)))
        if i % 9 == 0:
            rows += [(f"c{i:03d}{j}", t.upper()) for j in range(3)]
        if i % 7 == 0:
            rows.append((f"q{i:03d}", " ".join(t.split()[:20]) + " " + text(50, 1000 + i)))
    return [*rows, ("n1", None), ("n2", ""), ("n3", "​")]


def test_links_equal_brute_force(spark):
    data = _corpus()
    df = spark.createDataFrame(data, "row_id string, text string").repartition(3)
    rows = neardup.signed(df).cache()
    found = neardup.links(rows, df, "row_id")
    node = {r["row_id"]: r["node"] for r in rows.collect()}
    assert not {"n1", "n2", "n3"} & node.keys()
    full = [(a, b) for a, b in data if words(b)]
    want = {tuple(sorted((node[a], node[c]))) for i, (a, b) in enumerate(full) for c, d in full[i + 1 :] if node[a] != node[c] and overlap(b, d) >= neardup.SHARE}
    assert {(r["a"], r["b"]) for r in found.collect()} == want and want


def _near(data: list[tuple[str, str]]) -> set[tuple[str, str]]:
    return {(a, c) for i, (a, b) in enumerate(data) for c, d in data[i + 1 :] if overlap(b, d) >= neardup.SHARE}


def test_crowded_keys_lose_no_link(spark):
    """60 texts under one opening, half of them with a near copy: every pair is found though all meet in crowded keys."""
    opening = text(40, 9)
    data = [(f"r{i:02d}", f"{opening} {text(60, 100 + i)}") for i in range(60)]
    data += [(f"s{i:02d}", edited(data[i][1], i, 3)) for i in range(0, 60, 2)]
    df = spark.createDataFrame(data, "row_id string, text string").repartition(3)
    rows = neardup.signed(df).cache()
    crowd = neardup.candidates(rows)[1]
    assert crowd.count() > neardup.FULL
    node = {r["row_id"]: r["node"] for r in rows.collect()}
    want = {tuple(sorted((node[a], node[b]))) for a, b in _near(data)}
    assert len(want) == 30 and {(r["a"], r["b"]) for r in neardup.links(rows, df, "row_id").collect()} == want


def test_many_variants_of_one_text_stay_together(spark):
    """Two groups of 45 variants, one of which drifts away from its start: components as by all pairs."""
    a, drift = text(80, 5), [text(80, 6)]
    for i in range(44):
        drift.append(edited(drift[-1], 300 + i, 2).lower().replace("!", "").replace("zzz", f"q{i}"))
    data = [(f"a{i:02d}", edited(a, i, 1)) for i in range(45)] + [(f"d{i:02d}", t) for i, t in enumerate(drift)]
    df = spark.createDataFrame(data, "row_id string, text string")
    rows = neardup.signed(df).cache()
    node = {r["row_id"]: r["node"] for r in rows.collect()}
    roots = unionfind.components(neardup.links(rows, df, "row_id"))
    got = {r["node"]: r["root"] for r in roots.collect()}
    want = unionfind.forest(iter((node[x], node[y]) for x, y in _near(data)))
    assert got == want and len(set(want.values())) == 2


def test_key_mates_that_are_no_pair_are_not_written(spark, monkeypatch):
    """100 texts under one opening meet in crowded keys, but most of their pairs are never written, and no word runs; all pairs
    that are near-same are found."""
    opening = text(40, 9)
    data = [(f"r{i:02d}", f"{opening} {text(60, 400 + i)}") for i in range(90)]
    data += [(f"s{i:02d}", edited(data[i][1], i, 3)) for i in range(10)]
    df = spark.createDataFrame(data, "row_id string, text string").repartition(3)
    rows = neardup.signed(df).cache()
    node = {r["row_id"]: r["node"] for r in rows.collect()}
    written = []

    def staged(df, label="stage"):
        out = staging.stage(df, label)
        written.append((out.count(), label))
        return out

    monkeypatch.setattr(neardup, "stage", staged)
    want = {tuple(sorted((node[a], node[b]))) for a, b in _near(data)}
    assert len(want) == 10 and {(r["a"], r["b"]) for r in neardup.links(rows, df, "row_id").collect()} == want
    assert max(written)[0] <= 15 * len(data), written


def test_texts_are_fetched_only_where_runs_allow_a_pair(spark, monkeypatch):
    """60 texts that share two fifths look alike to the sketch: their texts are not fetched, and those of all links are."""
    opening = text(45, 9)
    data = [(f"r{i:02d}", f"{opening} {text(60, 700 + i)}") for i in range(60)]
    data += [(f"s{i:02d}", edited(data[i][1], i, 3)) for i in range(5)]
    df = spark.createDataFrame(data, "row_id string, text string").repartition(3)
    rows = neardup.signed(df).cache()
    node = {r["row_id"]: r["node"] for r in rows.collect()}
    counts = {}

    def staged(df, label="stage"):
        out = staging.stage(df, label)
        counts[label] = max(counts.get(label, 0), out.count())
        return out

    monkeypatch.setattr(neardup, "stage", staged)
    want = {tuple(sorted((node[a], node[b]))) for a, b in _near(data)}
    assert len(want) == 5 and {(r["a"], r["b"]) for r in neardup.links(rows, df, "row_id").collect()} == want
    assert counts["pairs"] > 100 and counts["held"] <= 20, counts


def test_signatures_are_deleted_once_candidates_are_known(spark):
    data = [(f"r{i}", f"author {i}", text(50, i // 2)) for i in range(6)] + [("s", "author s", edited(text(50, 0), 1, 1))]
    df = spark.createDataFrame(data, "row_id string, author string, text string")
    held = lambda: {p.name for p in pathlib.Path(staging._own(spark).removeprefix("file://")).glob("*-*")}
    before = held()
    assert len({r["component"] for r in splits.related(df).collect()}) == 3
    assert (new := held() - before) and not [x for x in new if x.startswith("signed")]


def test_signatures_and_checks_equal_plain_ones():
    """Minima of texts of any lengths, and whole texts of pairs compared many at a time, word runs that come again included."""
    texts = [text(n, n) for n in (1, 3, 5, 6, 40, 41, 700)] + ["no " * 30, "no " * 55, "no " * 70, "no no yes " * 20, f"{'no ' * 30}{text(30, 1)}", "", None]
    texts += [edited(text(60, i), i, k) for i in range(6) for k in range(0, 9, 2)]
    flat, sizes = coded([t for t in texts if words(t)], Codes())
    runs, count = shingles(flat, sizes, neardup.WORDS)
    least = np.array([[(r * s >> np.uint64(20)).min() for s in neardup._SEEDS] for r in np.split(runs, np.cumsum(count)[:-1])])
    sketch = (mixed(least) & np.uint64(15)).astype(np.uint8)
    keys, got = neardup.signatures(runs, count)
    assert (got >> 4 == sketch[:, ::2]).all() and (got & 15 == sketch[:, 1::2]).all() and len(np.unique(keys)) > 100
    x, y = np.divmod(np.arange(len(texts) ** 2), len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array([texts[i] for i in x]), pa.array([texts[i] for i in y])], ["a", "b", "ta", "tb"])
    found = {(a, b) for out in neardup._verified(iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)}
    assert found == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if overlap(a, b) >= neardup.SHARE}
    short = (runs >> np.uint64(48)).astype(np.uint16)
    full = [t for t in texts if words(t)]
    x, y = np.divmod(np.arange(len(full) ** 2), len(full))
    let = neardup._near(short, count, x, y)
    assert all(let[k] for k in range(len(x)) if overlap(full[x[k]], full[y[k]]) >= neardup.SHARE) and not let.all()


def test_keys_dealt_over_tasks_hold_components_together(spark, monkeypatch):
    """Texts under one opening, and 90 variants of one text that drift apart, in keys that no one task compares: components of
    authors and texts as by all pairs, with fewer links than pairs."""
    monkeypatch.setattr(neardup, "LARGE", 40)
    opening = text(40, 9)
    data = [(f"r{i:02d}", f"{opening} {text(45, 500 + i)}") for i in range(30)]
    data += [(f"s{i:02d}", edited(data[i][1], i, 3)) for i in range(8)]
    t = text(90, 5)
    data += [(f"v{i:02d}", " ".join(f"w{i}" if i < 80 and j == i else f"q{i}" if i >= 80 and j % 20 == i % 10 else w for j, w in enumerate(t.split()))) for i in range(90)]
    df = spark.createDataFrame([(a, f"author {a}", b) for a, b in data], "row_id string, author string, text string").repartition(3)
    near = _near(data)
    rows = neardup.signed(df.select("row_id", "text")).cache()
    node = {r["row_id"]: r["node"] for r in rows.collect()}
    found = {(r["a"], r["b"]) for r in neardup.links(rows, df.select("row_id", "text"), "row_id").collect()}
    assert found <= {tuple(sorted((node[a], node[b]))) for a, b in near} and len(found) < len(near)
    number = {r: i for i, (r, _) in enumerate(data)}
    want = unionfind.forest(iter((number[a], number[b]) for a, b in near))
    got = {r["row_id"]: r["component"] for r in splits.related(df).collect()}
    whole = lambda of: {frozenset(r for r in number if of(r) == x) for x in map(of, number)}
    assert whole(got.get) == whole(lambda r: want.get(number[r], number[r])) and len(set(want.values())) == 9


@pytest.mark.parametrize("bound", [0, 10, 10**6])
def test_union_find(spark, bound):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    got = {r["node"]: r["root"] for r in unionfind.components(spark.createDataFrame([*e, (None, 3), (7, 7)], "a long, b long"), bound, 8).collect()}
    assert got == unionfind.forest(iter([p for p in e if p[0] != p[1]]))
    assert unionfind.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_splits(spark):
    data = [(r, f"U00{i % 23}" if i % 2 else f" u{i % 23}", t, i % 5 if i % 3 else None) for i, (r, t) in enumerate(_corpus())] + [("lone", "n/a", text(30, 77), 1), ("lone2", None, text(30, 78), 2)]
    df = spark.createDataFrame(data, "row_id string, author string, text string, fold int")
    m = splits.related(df)
    comp = {r["row_id"]: r["component"] for r in m.collect()}
    assert len(comp) == len(data)
    for i, (a, u, t, _) in enumerate(data):
        for b, v, s, _ in data[i + 1 :]:
            norm = lambda x: x.strip().lower().replace("u00", "u") if x and x != "n/a" else None
            if norm(u) and norm(u) == norm(v) or words(t) and overlap(t, s) >= neardup.SHARE:
                assert comp[a] == comp[b]
    assert comp["lone"] != comp["lone2"]
    out = splits.assign(m, [0.5, 0.3, 0.2]).collect()
    assert len(out) == len(data) and all(len({r["split"] for r in out if r["component"] == c}) == 1 for c in set(comp.values()))
    folds: dict[int, set[int]] = {}
    for a, _, _, f in data:
        if f is not None:
            folds.setdefault(comp[a], set()).add(f)
    assert {r["row_id"] for r in splits.torn(m).collect()} == {a for a in comp if len(folds.get(comp[a], ())) > 1}


@given(st.dictionaries(st.integers(1, 9), st.integers(1, 12), min_size=1, max_size=6), st.lists(st.sampled_from([0.1, 0.2, 0.5, 1.0]), min_size=1, max_size=4))
@settings(max_examples=60)
def test_quotas_equal_one_by_one(sizes, shares):
    got: dict[tuple[int, int], int] = {}
    for s, f, a, b in splits.quotas(list(sizes.items()), shares):
        got[s, f] = got.get((s, f), 0) + b - a
    total = sum(s * n for s, n in sizes.items())
    deficit = [total * x / sum(shares) for x in shares]
    want: dict[tuple[int, int], int] = {}
    for s in sorted(sizes, reverse=True):
        for _ in range(sizes[s]):
            f = max(range(len(shares)), key=lambda i: (round(deficit[i], 6), -i))
            deficit[f] -= s
            want[s, f] = want.get((s, f), 0) + 1
    fill = lambda x: sorted(round(sum(s * n for (s, f), n in x.items() if f == i) - total * shares[i] / sum(shares), 6) for i in range(len(shares)))
    assert all(sum(n for (s, _), n in got.items() if s == k) == n for k, n in sizes.items())
    assert max(map(abs, fill(got))) <= max(map(abs, fill(want))) + max(sizes) + 1e-6


def test_representatives(spark):
    t = text(60, 1)
    posts = [("a", "train", t, "T", "fl", "en", "2024-01-02", "web-scrape"), ("b", "train", edited(t, 2), "T", None, "n/a", "2024-01-01", "WEB_SCRAPE"), ("c", "train", t, "T2", "fl", "en", "2099-12-31", "curated"), ("c", "train", t, None, None, None, None, "curated"), ("x", "train", text(60, 2), "T", "f", "en", "2024-01-01", None), ("l", "leaderboard", t, "T", "f", "en", "2024-01-01", "curated")]
    p = spark.createDataFrame(posts, "row_id string, split string, post_raw string, title string, flair string, lang_hint string, updated_at string, origin string").selectExpr("* except (updated_at)", "cast(updated_at as timestamp_ntz) updated_at", "timestamp_ntz'2025-01-01' ingested_at")
    g = spark.createDataFrame([("a", "ideation", ["s"], ["f"]), ("b", "Attempt", ["?"], None), ("c", None, None, None)], "row_id string, risk_norm string, gold_eval_spans array<string>, factors_set array<string>")
    o = spark.createDataFrame([("curated", 5), ("web_scrape", 1)], "origin string, trust int")
    m = representative.groups(p)
    assert {r["row_id"] for r in m.collect()} == {"a", "b", "c"}
    s = {r["row_id"]: r for r in representative.survivors(representative.records(p, g, o, m)).collect()}
    assert [k for k, r in s.items() if r["is_representative"]] == ["a"] and s["a"]["is_label_conflict"] and s["c"]["updated_at"] is None
    assert s["a"]["best_flair"] == "fl" and s["b"]["filled"] == 2 and s["c"]["trust"] == 5
    assert representative.survivors(representative.records(p, g, o, representative.groups(p.where("false")))).count() == 0


def test_golden_record_equals_plain_truth_discovery(spark):
    """Values with the most support, by the alternation spelled out over lists."""
    r = random.Random(6)
    rows = []
    for g in range(25):
        truth = {c: r.choice("xyz") for c in ("title", "flair")}
        for k in range(r.randint(2, 6)):
            src = r.choice(["good", "fair", "bad", None])
            lie = {"good": 0.05, "fair": 0.3, "bad": 0.8, None: 0.5}[src]
            rows.append((g, f"{g}-{k}", src, *[None if r.random() < 0.1 else r.choice("xyz") if r.random() < lie else truth[c] for c in truth]))
    record = spark.createDataFrame(rows, "group_id long, row_id string, source string, title string, flair string")
    claims = [(g, c, v, src or "") for g, _, src, *vs in rows for c, v in zip(("title", "flair"), vs, strict=True) if v is not None]
    trust, before = {s: 0.8 for *_, s in claims}, {s: 0.8 for *_, s in claims}
    for _ in range(representative.ROUNDS + 1):
        weight, total = {}, {}
        for g, c, v, src in claims:
            weight[g, c, v] = weight.get((g, c, v), 0) + trust[src]
            total[g, c] = total.get((g, c), 0) + trust[src]
        support = {k: w / total[k[:2]] for k, w in weight.items()}
        now = {s: (sum(support[x[:3]] for x in claims if x[3] == s) + representative.PRIOR * 0.8) / (sum(x[3] == s for x in claims) + representative.PRIOR) for s in trust}
        if max(abs(now[s] - before[s]) for s in now) < representative.STILL:
            break
        trust = before = now
    supported, _ = representative.discover(record, ["title", "flair"])
    got = {(x["group_id"], x["field"], x["value"]): x["support"] for x in supported.collect()}
    assert set(got) == set(support) and all(abs(got[k] - support[k]) < 0.01 for k in got)
    s = representative.survivors(record.selectExpr("*", "timestamp_ntz'2024-01-01' updated_at", "1 trust", "title risk_norm"), ["title", "flair"])
    for x in s.collect():
        for c in ("title", "flair"):
            own = [(round(v, 6), k[2]) for k, v in got.items() if k[:2] == (x["group_id"], c)]
            assert x[f"best_{c}"] == (max(own)[1] if own else None)


def test_cross_split_pairs(spark):
    data = [(r, "leaderboard" if i % 3 == 0 else "train", t, "Web Scrape") for i, (r, t) in enumerate(_corpus())]
    p = spark.createDataFrame(data, "row_id string, split string, post_raw string, origin string")
    got = {tuple(r) for r in crosssplit.pairs(p).collect()}
    want = {tuple(sorted((a, b))) for a, s, t, _ in data for b, q, u, _ in data if s == "train" and q == "leaderboard" and overlap(t, u) >= neardup.SHARE}
    assert got == want and want
    n = {r["split"]: r["n_overlapping"] for r in crosssplit.counts(p).collect()}
    assert n["train"] == len({x for pair in want for x in pair if dict((d[0], d[1]) for d in data)[x] == "train"})
    assert crosssplit.pairs(p.where("false")).count() == 0


def test_cross_split_pairs_at_the_threshold(spark):
    """Pairs that share little more than the least share, and repetitions of one phrase: none is left out, for none holds few
    runs in common with others.  A few classes at a time are held."""
    swapped = lambda t, i: " ".join(f"swap{i}x{j}" if j % 11 == 5 else w for j, w in enumerate(t.split()))
    data = []
    for i in range(40):
        t = text(66, 700 + i)
        data += [(f"t{i:02d}", "train", t, None), (f"l{i:02d}", "leaderboard", swapped(t, i), None)]
    for i, s in enumerate(("train", "leaderboard")):
        data.append((f"h{i}", s, " ".join(["ha"] * 60) + " " + text(50, 900 + i), None))
    data += [("s0", "train", "just three words", None), ("s1", "leaderboard", "Just three words!", None), ("s2", "train", "three words", None)]
    p = spark.createDataFrame(data, "row_id string, split string, post_raw string, origin string").repartition(3)
    want = {tuple(sorted((a, b))) for a, s, t, _ in data for b, q, u, _ in data if s == "train" and q == "leaderboard" and overlap(t, u) >= neardup.SHARE}
    assert len(want) == 42 and {tuple(r) for r in crosssplit.pairs(p).collect()} == want
    held = neardup.HELD
    neardup.HELD = 15
    try:
        assert {tuple(r) for r in crosssplit.pairs(p).collect()} == want
    finally:
        neardup.HELD = held


def test_runs_of_copies_and_training_classes_stand_once(spark, monkeypatch):
    """Of five copies of each text one has its word runs written, and those of training classes are written only once."""
    data = [(f"t{i:02d}{c}", "train", text(50, 40 + i), None) for i in range(20) for c in range(5)] + [(f"l{i:02d}", "leaderboard", edited(text(50, 40 + i), i, 1), None) for i in range(10)]
    data += [("l99", "leaderboard", text(50, 59), None)]
    p = spark.createDataFrame(data, "row_id string, split string, post_raw string, origin string").coalesce(1)
    written = []

    def staged(df, label="stage"):
        out = staging.stage(df, label)
        written.append(out.where("runs is not null").count() if "runs" in out.columns else 0)
        return out

    monkeypatch.setattr(crosssplit, "stage", staged)
    want = {tuple(sorted((a, b))) for a, s, t, _ in data for b, q, u, _ in data if s == "train" and q == "leaderboard" and overlap(t, u) >= neardup.SHARE}
    assert len(want) == 55 and {tuple(r) for r in crosssplit.pairs(p).collect()} == want
    assert sum(written) == 20 + 2 * 11


def test_coverage():
    assert crosssplit.covered({0, 2, 10}, 5, 20) == pytest.approx(12 / 20) and crosssplit.covered(set(), 5, 0) == 0


# Problem 6


def test_shared_runs_equal_brute_force(spark):
    r = random.Random(9)
    letters = lambda n: "".join(r.choices("abcd ", k=n))
    piece, long = letters(300), letters(1500)
    data = [("a", letters(50) + piece + letters(100)), ("b", piece[:259] + letters(200)), ("c", letters(7) + piece[20:290] + "é"), ("d", long), ("e", long), ("f", long[700:960]), ("g", "ab" * 400), ("h", "x" + "ab" * 200), ("i", None), ("j", "short"), ("d", long), ("k", "a" * 3000), ("l", "b" + "a" * 500 + "c" + letters(40)), ("m", letters(30) + "a" * 300 + "c" + letters(300))]
    df = spark.createDataFrame(data, "rec string, text string")
    got = {tuple(x) for x in spans.pairs(df).collect()}
    have = {a: t for a, t in data if t}
    want = {tuple(sorted((a, b))) for a in have for b in have if a < b and any(have[a][i : i + 260] in have[b] for i in range(len(have[a]) - 259))}
    assert got == want
    windows = {a: [t[i : i + 260] for i in range(max(0, len(t) - 259))] for a, t in have.items()}
    owners: dict[str, list[tuple[str, int]]] = {}
    for a in sorted(have):
        for i, w in enumerate(windows[a]):
            owners.setdefault(w, []).append((a, i))
    cover = lambda starts: {k for i in starts for k in range(i, i + 260)}
    full = {a: cover(i for i, w in enumerate(ws) if len({b for b, _ in owners[w]}) > 1) for a, ws in windows.items()}
    s = {x["rec"]: x for x in spans.shares(df).collect()}
    assert {a: x["shared_chars"] for a, x in s.items()} == {a: len(c) for a, c in full.items() if c}
    gone = {a: cover(i for i, w in enumerate(ws) if len({b for b, _ in owners[w]}) > 1 and owners[w][0] != (a, i)) for a, ws in windows.items()}
    cut: dict[str, set[int]] = {}
    for x in spans.removed(df).collect():
        assert not cut.setdefault(x["rec"], set()) & set(range(x["start"], x["end"]))
        cut[x["rec"]] |= set(range(x["start"], x["end"]))
    assert cut == {a: c for a, c in gone.items() if c} and all(x["is_earliest"] == (a not in cut) for a, x in s.items())
    assert spans.shares(df.where("false")).count() == spans.removed(df.where("false")).count() == 0


# Problem 8


def test_leaks(spark):
    item = text(60, 500).split()
    near = list(item[10:40])
    near[12] = "changed"
    docs = [(1, text(80, 501) + " " + " ".join(item[5:25]).upper() + ". " + text(10, 502)), (2, text(50, 503) + " " + " ".join(item[5:24]) + " " + text(50, 504)), (3, "x " + " ".join(near)), (4, None), (5, ""), (6, " ".join(item[:15]) + " " + text(30, 505) + " " + " ".join(item[15:30])), (1, "again")]
    got = {tuple(r) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")).collect()}
    assert got == {(1, 7), (3, 7)}


def test_suffix_search_finds_every_run():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, 300).astype(np.uint64), rng.integers(0, 4, 60).astype(np.uint64)
    q, at = leakage.Suffixes(a).search(b)
    want = {(i, j) for i in range(len(b) - 4) for j in range(len(a) - 4) if (b[i : i + 5] == a[j : j + 5]).all() and b[i : i + 5].all()}
    assert set(zip(q.tolist(), at.tolist(), strict=True)) == want


def test_matches_and_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 70)
    r = random.Random(12)
    items = {i: text(r.randint(20, 60), 900 + i).split() for i in range(8)}
    docs = []
    for d in range(60):
        w = text(40, 2000 + d).split()
        for i in r.sample(range(8), 2):
            k = r.randint(0, len(items[i]) - 15)
            part = items[i][k : k + r.randint(10, 40)]
            for _ in range(r.randint(0, 4)):
                part[r.randrange(len(part))] = "zzz"
            w[20:20] = part
        docs.append((d, " ".join(w)))
    got = {tuple(x) for x in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i, w in items.items() if leakage.stretch(t.split(), w)[0] >= leakage.LEAST}
    assert got == want and 10 < len(want) < 120


# Problem 5


def test_defects(spark):
    shown = "When my aunt came I hid the letters in the shed. Nobody asked me why I did that on Monday."
    prompts = [(f"c{i}", "One post.", f"Posts:\n[1] {shown}\nWrite the next one.") for i in range(6)]
    good = [f"My brother fixed the old gate number {w} before dinner. I was proud of him on Friday." for w in VOCABULARY[:60]]
    # A long answer that speaks of what its author cannot do declines nothing.
    decoys = [f"{g} I can't write to my {p} about it, not yet. I won't be able to help my {p} move this time. We met again at noon." for g, p in zip(good, ["aunt", "uncle", "boss", "nurse"] * 5, strict=False)]
    refused = [(f"s{i}", f"c{i % 6}", f"Sorry, I cannot {v} this {o}.", "refusal") for i, (v, o) in enumerate((v, o) for v in ("write", "produce", "create") for o in ("post", "text", "message"))]
    bad = [("e1", "c0", "\u200b", "empty"), ("e2", "c0", None, "empty"), ("r1", "c1", "I'm sorry, but I can't write this post.", "refusal"), ("r2", "c1", "Je préfère ne pas rédiger un tel texte.", "refusal"), ("r3", "c1", f"{good[3]} Sorry, I cannot create this text.", "refusal"), ("p1", "c2", shown.replace("Monday", "Tuesday"), "prompt_copy"), ("t1", "c3", good[0] + " My brother fixed the", "truncated"), ("o1", "c4", "Ich habe das mit meiner Mutter nicht so gut gemacht. Der Tag war lang und die Nacht auch.", "other_language")]
    rows = [(f"g{i}", f"c{i % 6}", t, "ok", "end_turn") for i, t in enumerate(good + decoys)] + [(d, c, t, "ok", None) for d, c, t, _ in bad] + [(d, c, t, "refusal", "refusal") for d, c, t, _ in refused] + [("g0", "c0", good[0], "ok", "end_turn"), ("np", "zz", good[1], None, None)]
    outputs = spark.createDataFrame(rows, "draft_id string, case_id string, text string, status string, stop_reason string")
    got = {tuple(r) for r in pairs.defects(outputs, spark.createDataFrame(prompts, "case_id string, system_text string, user_text string")).collect()}
    assert got == {(d, k) for d, _, _, k in bad + refused}


def test_languages():
    assert [language(t) for t in ("I was in the house and it was cold", "je ne sais pas pourquoi", "ich bin nicht da", "estoy en la casa con mi madre", "тихая река", "", None, "zz qq")] == ["en", "fr", "de", "es", "ru", None, None, None]


# Problem 1


def test_consensus(spark):
    rng = np.random.default_rng(8)
    skill = {f"a{i}": 0.95 for i in range(3)} | {f"b{i}": 0.3 for i in range(4)}
    truth = {f"c{i:03d}": int(rng.integers(0, 4)) for i in range(150)}
    rows = []
    for c, k in truth.items():
        for a, s in skill.items():
            x = k if rng.random() < s else int(rng.integers(0, 4))
            rows.append((c, a, "B1", consensus.CLASSES[x].upper() + " ", "complete", "2024-01-01"))
    rows += [("c000", "a0", "B1", "Unclear", "in_progress", "2025-01-01"), ("none", "a0", "B1", None, "complete", None), (None, "a0", "B1", "Attempt", "complete", None)]
    df = spark.createDataFrame(rows, "case_id string, annotator string, batch_id string, risk string, status string, at string").selectExpr("* except (at)", "cast(at as timestamp_ntz) submitted_at")
    got = {r["case_id"]: r["risk"] for r in consensus.consensus(df).collect()}
    assert set(got) == set(truth) and np.mean([got[c] == consensus.CLASSES[k] for c, k in truth.items()]) > 0.97
    r = {x["annotator"]: x for x in consensus.reliability(df).collect()}
    assert min(r[f"a{i}"]["low"] for i in range(3)) > max(r[f"b{i}"]["high"] for i in range(4))
    b = consensus.agreement(df).first()
    assert b["n_cases"] == 150 and -1 < b["risk_fleiss_kappa"] < 1 and abs(b["risk_alpha"] - b["risk_fleiss_kappa"]) < 0.05
    assert consensus.consensus(df.where("false")).count() == 0
    d = spark.range(1).select(consensus.digamma(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(0.7))).first()[0]
    assert d == pytest.approx(-1.2200235536979347, abs=1e-8)


# Problem 9


def test_rates():
    assert mixing.rates({"a": 100, "b": 10, "c": 0}, {"a": (0.5, 2), "b": (0.5, 3), "c": (0.2, 9)}) == pytest.approx({"a": 0.3, "b": 3.0})
    got = mixing.rates({"a": 100, "b": 10}, {"a": (0.5, 2), "b": (0.5, 3)}, 100)
    assert got == pytest.approx({"b": 3.0, "a": 0.7}) and mixing.rates({}, {}) == {}


def test_mix(spark):
    docs = spark.createDataFrame([(i, f"Src {'AB'[i % 2]}", f"some words here {i}") for i in range(400)] + [(999, None, "x"), (998, "src_a", None)], "doc_id long, source string, text string")
    goal = spark.createDataFrame([("src-a", 0.75, 4), ("SRC_B", 0.25, 4), ("gone", 0.5, 1)], "source string, target_share double, max_repeats int")
    emitted, report = mixing.mix(docs, goal)
    r = {x["source"]: x for x in report.collect()}
    assert abs(r["src_a"]["actual_share"] - 0.75) < 0.03 and r["src_a"]["rate"] == 4.0 and r["gone"]["mixed_tokens"] == 0 and r[None]["mixed_tokens"] == 0
    assert emitted.agg({"copy": "max"}).first()[0] <= 4 and emitted.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert r["src_a"]["mixed_tokens"] == emitted.where("source = 'src_a'").agg({"tokens": "sum"}).first()[0]
    assert sorted(map(tuple, emitted.collect())) == sorted(map(tuple, mixing.mix(docs, goal)[0].collect()))
    assert len(mixing.tokenizer(*mixing.load()).encode_ordinary("some words here")) == 3


# Problem 10


def test_subjects(spark):
    r = random.Random(3)
    topics = {"sport": VOCABULARY[:30], "law": VOCABULARY[30:60]}
    people = ["aunt", "uncle", "boss", "friend", "nurse", "barber"]
    docs, want = [], {}
    for i in range(300):
        own = [["sport"], ["law"], ["sport", "law"]][i % 3]
        # A document stays with a few words of its subject, which is what makes them bursty.
        few = {s: r.sample(topics[s], 3) for s in own}
        said = [f"My {r.choice(people)} spoke of the {r.choice(few[s])} and the {r.choice(few[s])} before dinner." for s in own for _ in range(4)] + [f"My {r.choice(people)} was late again."]
        docs.append((i, " ".join(said)))
        want[i] = set(own)
    docs += [(900, None), (901, "")]
    labels = [(i, next(iter(want[i]))) for i in range(0, 90) if len(want[i]) == 1] + [(5555, "law"), (1, "nonsense")]
    got: dict[int, set[str]] = {}
    areas = spark.createDataFrame([("sport", "matches and teams"), ("law", "courts and fines")], "subject string, description string")
    for x in subjects.subjects(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), areas).collect():
        got.setdefault(x["doc_id"], set()).add(x["subject"])
    assert np.mean([got.get(i) == w for i, w in want.items()]) > 0.95 and not {900, 901} & got.keys()
    assert subjects.subjects(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, subject string"), areas).count() == 0


def test_burstiness_tells_subjects_from_phrasing():
    sizes, counts = np.array([5.0, 10.0]), np.array([500.0, 500.0])
    docs, sentences = np.array([100, 100, 2, 900, 50]), np.array([300, 104, 9, 3000, 60])
    w = subjects.burstiness(docs, sentences, sizes, counts)
    assert w[0] > 0 and w[1] == 0 and w[2] == 0 and w[3] == 0 and w[4] > 0
    assert (subjects.burstiness(np.array([], int), np.array([], int), sizes, counts) == 0).all()


def test_stretch_with_early_and_close_differences():
    w = [f"w{i}" for i in range(30)]
    other = lambda item, *at: ["start", *("x" if i in at else v for i, v in enumerate(item)), "end"]
    for k in range(2, 18):
        assert leakage.stretch(other(w[:20], k), w[:20]) == (20, 1)
    assert leakage.stretch(other(w[:21], 9, 11), w[:21]) == (21, 3)
    assert leakage.stretch(other(w[:23], 3), w[:23]) == (23, 1)
    assert leakage.stretch(other(w[:18]), w[:18])[0] == 18 and leakage.stretch(other(w[:20], 4, 8, 12, 16), w[:20])[0] < 20
