"""Problem 5: broken prompt and response pairs, by a conditional random field over clauses.

A response is cut into clauses; a linear-chain conditional random field tags each as answer, refusal, echo (of the prompt or
a post shown in it), foreign or unfinished.  The words that the tags cover decide the defect of the pair, nothing else does.

The field is trained here, by stochastic gradient, on a bounded sample of ``SAMPLE`` drafts whose clauses get weak labels:
from the status that came with the draft, from seed wordings in drafts that are short or reported as refused, from the
overlap with the prompt, the languages and the stop reason.  What the field sees of a clause are its words and pairs of
words, its place, how much of it the prompt holds, its language beside the prompt's, and how the corpus ends sentences; the
seed wordings and the status are no features.  All corpus statistics behind the features (how often word pairs end
sentences, how short sentences with the same opening are) come from all drafts.

Defined results: null text is empty; a missing prompt gives no echo and no foreign text; a draft delivered twice is one (the
least text holds); a draft without defect gives no row; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.language import language_of
from quillspark.llm.words import Codes, words
from quillspark.sources.staging import stage

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
SAMPLE, EPOCHS, BUCKETS, ECHO, MOSTLY = 3000, 4, 1 << 17, 0.55, 0.5
#: A draft of at most so many clauses is short: seed wordings count as a refusal there.
SHORT = 4
_MARKED = re.compile(r"[.!?…。！？؟।][\s\"'”’»)\]*_`~\W]*$")
_CLAUSE = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]*_]*\s+|\n+")
_SHOWN = re.compile(r"(?m)^\s*\[\d+\]\s*")
_CLIPPED = re.compile(r"\s*\[\.\.\.\]\s*$")
# Seed wordings with which a writer declines, by language, compared without case and accents.  Only for weak labels.
SEEDS = re.compile(
    r"\b(?:i (?:can ?not|cant|wont|will not|am unable to|am not able to|must decline|refuse to|decline to)(?: be able to)?(?: \w+){0,2} (?:write|produce|create|draft|compose|comply|help|assist|provide|generate|fulfil|continue|do (?:this|that))"
    r"|(?:unable|not able) to comply|(?:have|need|must) to (?:decline|turn down|refuse|pass)|(?:must|have to) pass on this|request declined|to decline this|i need to turn down|i refuse to"
    r"|(?:id|i would) rather not (?:draft|write|produce|create|compose)|not something i am (?:comfortable|able|allowed)|dont think i should (?:write|draft|produce)|do not think i should (?:write|draft|produce)"
    r"|chosen not to (?:answer|write|respond)|i do not (?:create|take part in|write|produce) (?:messages|this|that|such|texts)|against (?:the |my )?(?:guidelines|policy|policies)|(?:outside|beyond) what i am (?:allowed|able|permitted)"
    r"|per policy|for safety reasons|content withheld|(?:post|text|content) can(?:not)? be (?:provided|returned)|be wrong for me to|would not be responsible|i am an ai\b|as an ai\b|as a (?:writing assistant|language model)|line i will not cross"
    r"|might do harm|could hurt someone|must leave this timeline"
    r"|je ne (?:peux|veux|suis) pas(?: \w+){0,3} (?:ecrire|rediger|produire|repondre|creer|autorise)|je prefere ne pas (?:rediger|ecrire|produire)|depasse ce que je suis autorise|je refuse d"
    r"|kann ich (?:leider )?nicht (?:schreiben|verfassen|erstellen)|ich kann (?:\w+ ){0,4}nicht (?:schreiben|verfassen|erstellen)|mochte ich (?:lieber )?nicht (?:verfassen|schreiben)|darf ich (?:leider )?nicht (?:erzeugen|schreiben|erstellen)|ich lehne"
    r"|no (?:puedo|debo|voy a) (?:escribir|redactar|crear|generar|ayudar)|prefiero no (?:redactar|escribir)|fuera de lo que puedo|me niego a"
    r"|nao (?:posso|devo|vou) (?:escrever|redigir|criar|gerar|ajudar)|prefiro nao (?:escrever|redigir)|fora do que posso"
    r"|non posso (?:scrivere|creare)|preferisco non (?:scrivere|redigere))"
)


def clauses(text: str | None) -> tuple[list[str], list[list[str]]]:
    """(sentences and lines of the text that have words, their words)."""
    parts, tokens = [], []
    for c in _CLAUSE.split(text or ""):
        if w := words(c):
            parts.append(c.strip())
            tokens.append(w)
    return parts, tokens


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        run = run * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    return run


class Prompt:
    """What a prompt shows: the whole, its posts and their runs of words."""

    def __init__(self, user: str | None, system: str | None, codes: Codes) -> None:
        shown = [words(_CLIPPED.sub("", p)) for p in _SHOWN.split(user or "")]
        whole = words(user)
        self.language = language_of(whole, user)
        parts = [np.array([codes[x] for x in w], np.uint64) for w in [*shown, whole, words(system)] if len(w) >= 4]
        self.four = [(len(p), np.unique(_grams(p, 4))) for p in parts]
        self.three = [np.unique(_grams(p, 3)) for p in parts]

    def echo(self, own: np.ndarray) -> tuple[float, np.ndarray | None]:
        """(the larger of the shares of the response found in one part and of one long part found in it, that part's runs
        of three)."""
        mine, best, at = np.unique(_grams(own, 4)), 0.0, None
        for k, (n, grams) in enumerate(self.four):
            if len(mine) and len(grams):
                same = np.isin(mine, grams, assume_unique=True).sum()
                share = max(same / len(mine), same / len(grams) if n > 20 else 0.0)
                if share > best:
                    best, at = float(share), k
        return best, None if at is None else self.three[at]


class Draft:
    """A draft cut into clauses, with what its prompt and the corpus say of each."""

    def __init__(self, row: dict, codes: Codes, prompts: dict[tuple, Prompt]) -> None:
        self.row = row
        self.parts, self.tokens = clauses(row["text"])
        if not self.parts:
            return
        key = (row["user_text"], row["system_text"])
        if key not in prompts:
            if len(prompts) >= 64:
                prompts.clear()
            prompts[key] = Prompt(*key, codes)
        self.prompt = prompts[key]
        sizes = np.array([len(w) for w in self.tokens])
        flat = np.array([codes[x] for w in self.tokens for x in w], np.uint64)
        self.sizes, self.tongues = sizes, [language_of(w, c) for w, c in zip(self.tokens, self.parts, strict=True)]
        self.echoed, three = self.prompt.echo(flat)
        # Share of each clause's runs of three that the part most like the draft holds.
        runs, owner = _grams(flat, 3), np.repeat(np.arange(len(sizes)), sizes)
        inside = owner[: len(runs)] == owner[2 : 2 + len(runs)] if len(runs) else np.empty(0, bool)
        held = np.isin(runs, three) & inside if three is not None else np.zeros(len(runs), bool)
        own = np.bincount(owner[: len(runs)][inside], minlength=len(sizes))
        self.copied = np.bincount(owner[: len(runs)][held], minlength=len(sizes)) / np.maximum(own, 1)
        self.end = {k: row[k] for k in ("n1", "e1", "n2", "e2", "n3", "least", "words")} if row["words"] is not None else None

    def features(self) -> list[list[int]]:
        """Hashed features of each clause."""
        n, whole, out = len(self.parts), f"whole{int(self.echoed * 5)}", []
        few = f"few{min(n, 5)}"
        for i, (w, tongue, copied) in enumerate(zip(self.tokens, self.tongues, self.copied, strict=True)):
            names = ["bias", few, f"words{min(len(w), 12) // 2}", whole, f"echo{int(copied * 4)}", f"{whole}/{int(copied * 4)}"]
            if i == 0:
                names.append("first")
            if i == n - 1:
                names.append("last")
                if self.end is not None:
                    names += unfinished_features(self.end)
            # Few names against the many words of a clause, so these weigh more than once.
            names += ["unknown" if tongue is None or self.prompt.language is None else "same" if tongue == self.prompt.language else "other"] * 6
            ids = [_bucket(x) for x in names]
            ids += [_bucket(f"w:{x}") for x in w]
            ids += [_bucket(f"p:{a} {b}") for a, b in zip(w, w[1:], strict=False)]
            out.append(ids)
        return out


_KNOWN: dict[str, int] = {}


def _bucket(name: str) -> int:
    at = _KNOWN.get(name)
    if at is None:
        if len(_KNOWN) > 500_000:
            _KNOWN.clear()
        at = _KNOWN[name] = zlib.crc32(name.encode()) % BUCKETS
    return at


def ending(text: str | None) -> tuple[str, str, str, int] | None:
    """(last word, last two words, opening of the last clause, its words) if the text has no final mark; else None."""
    if not text or _MARKED.search(text):
        return None
    last = clauses(text)[1][-1:]
    if not last:
        return None
    w = last[0]
    return w[-1], " ".join(w[-2:]), " ".join(w[:3]), len(w)


def _statistics(batches: Iterator[pa.RecordBatch], hold: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Per key: how often it stands, how often it ends a marked sentence, and the fewest words of a sentence it opens.

    Added up in the task before anything is shuffled; what is held is handed on when it grows beyond ``hold`` keys.
    """
    tally: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(k, *v) for k, v in tally.items()]
        tally.clear()
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["key", "n", "ends", "least"])

    for b in batches:
        for t in b.column("text").to_pylist():
            for c, w in zip(*clauses(t), strict=True):
                marked, last = bool(_MARKED.search(c)), len(w) - 1
                for i, x in enumerate(w):
                    for key in (x, f"{w[i - 1]} {x}") if i else (x,):
                        e = tally.setdefault(key, [0, 0, 1 << 30])
                        e[0] += 1
                        e[1] += marked and i == last
                if marked and len(w) >= 3:
                    e = tally.setdefault("^" + " ".join(w[:3]), [0, 0, 1 << 30])
                    e[0] += 1
                    e[2] = min(e[2], len(w))
            if len(tally) > hold:
                yield out()
    yield out()


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(d, *e) for d, t in zip(b.column("draft_id").to_pylist(), b.column("text").to_pylist(), strict=True) if (e := ending(t))]
        cols = list(zip(*found, strict=True)) or [(), (), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["draft_id", "k1", "k2", "k3", "words"])


def unfinished_features(end: dict) -> list[str]:
    """How the statistics see a last clause without a final mark."""
    rate = end_rate(end)
    out = ["nomark", *[f"rate{int(min(rate, 0.999) * 8)}"] * 4]
    if not end["n1"] or end["n1"] <= 1:
        out += ["newword"] * 2
    if (end["n3"] or 0) >= 5 and end["words"] < (end["least"] or 0):
        out += ["tooshort"] * 3
    return out


def end_rate(end: dict) -> float:
    """Chance that the last words end a sentence: pair of words, backed off to the last word."""
    one = ((end["e1"] or 0) + 0.1) / ((end["n1"] or 0) + 1.0)
    return ((end["e2"] or 0) + 2 * one) / ((end["n2"] or 0) + 2)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    """A linear-chain conditional random field over hashed features."""

    def __init__(self) -> None:
        t = len(TAGS)
        self.w = np.zeros((BUCKETS, t), np.float32)
        self.move = np.zeros((t, t))
        self.seen_w, self.seen_move = np.full((BUCKETS, t), 1e-2, np.float32), np.full((t, t), 1e-2)

    def emit(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.concatenate(rows)
        return np.add.reduceat(self.w[flat], np.cumsum([0, *map(len, rows[:-1])]), axis=0).astype(np.float64)

    def learn(self, rows: list[list[int]], gold: list[int], rate: float = 0.3) -> None:
        e = self.emit(rows)
        n = len(rows)
        fore, back = np.zeros_like(e), np.zeros_like(e)
        fore[0] = e[0]
        for i in range(1, n):
            fore[i] = e[i] + _log_sum(fore[i - 1][:, None] + self.move, 0)
        for i in range(n - 2, -1, -1):
            back[i] = _log_sum(self.move + (e[i + 1] + back[i + 1])[None, :], 1)
        z = _log_sum(fore[-1], 0)
        grad = -np.exp(fore + back - z)
        grad[np.arange(n), gold] += 1
        move = np.zeros_like(self.move)
        for i in range(1, n):
            move -= np.exp(fore[i - 1][:, None] + self.move + (e[i] + back[i])[None, :] - z)
            move[gold[i - 1], gold[i]] += 1
        for r, g in zip(rows, grad, strict=True):
            at = np.unique(r)
            self.seen_w[at] += g * g
            self.w[at] += rate * g / np.sqrt(self.seen_w[at])
        self.seen_move += move * move
        self.move += rate * move / np.sqrt(self.seen_move)

    def tag(self, rows: list[list[int]]) -> list[int]:
        e = self.emit(rows)
        best, trace = e[0], []
        for x in e[1:]:
            s = best[:, None] + self.move
            trace.append(s.argmax(axis=0))
            best = s.max(axis=0) + x
        out = [int(best.argmax())]
        for t in reversed(trace):
            out.append(int(t[out[-1]]))
        return out[::-1]


def weak_tags(d: Draft) -> list[int]:
    """Weak labels of the clauses of one draft.

    A clause declines where the draft is one or two clauses long and was reported as refused, or where it holds a seed
    wording and the draft is short or was reported as refused; the same wording within a long, reported answer does not.
    """
    reported = "refusal" in (d.row["status"], d.row["stop_reason"])
    n = len(d.parts)
    other = sum(k for k, x in zip(d.sizes, d.tongues, strict=True) if x and d.prompt.language and x != d.prompt.language)
    foreign, end = other > MOSTLY * d.sizes.sum(), d.end
    out = []
    for i, (w, tongue) in enumerate(zip(d.tokens, d.tongues, strict=True)):
        seed = bool(SEEDS.search(" ".join(w)))
        if seed and (reported or n <= SHORT) or reported and n == 1:
            out.append(1)
        elif d.echoed >= ECHO:
            out.append(2)
        elif i == n - 1 and end is not None and (end_rate(end) < 0.15 or d.row["stop_reason"] == "max_tokens" and end_rate(end) < 0.4 or (end["n3"] or 0) >= 5 and end["words"] < (end["least"] or 0)):
            out.append(4)
        elif foreign and tongue != d.prompt.language or tongue and d.prompt.language and tongue != d.prompt.language:
            out.append(3)
        else:
            out.append(0)
    return out


def train(rows: list[dict]) -> Field:
    """A field fitted to the weak labels of a sample of drafts."""
    codes, prompts, data = Codes(), {}, []
    for r in rows:
        d = Draft(r, codes, prompts)
        if d.parts:
            data.append((d.features(), weak_tags(d)))
    field, order = Field(), np.random.default_rng(5)
    for k in range(EPOCHS):
        for i in order.permutation(len(data)):
            field.learn(*data[i], rate=0.3 / (1 + k))
    return field


def defect(tags: list[int], sizes: np.ndarray) -> str | None:
    """The first defect that fits, from the words that each tag covers; ``tags`` and ``sizes``: of each clause."""
    if not len(tags):
        return "empty"
    cover = np.bincount(tags, sizes, len(TAGS)) / sizes.sum()
    if cover[1] > 0:
        return "refusal"
    if cover[2] > MOSTLY:
        return "prompt_copy"
    if tags[-1] == 4:
        return "truncated"
    return "other_language" if cover[3] > MOSTLY else None


def joined(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """(draft_id, text, status, stop_reason, user_text, system_text, ending statistics) of every draft, staged."""
    o = outputs.where("draft_id is not null").groupBy("draft_id").agg(F.min(F.struct("case_id", "text", "status", "stop_reason")).alias("o"), F.min("text").alias("text")).select("draft_id", "o.case_id", "o.status", "o.stop_reason", "text")
    o = stage(o, "drafts")
    ends = stage(o.select("draft_id", "text").mapInArrow(_endings, "draft_id string, k1 string, k2 string, k3 string, words long"), "endings")
    used = ends.select(F.explode(F.array("k1", "k2", F.concat(F.lit("^"), F.col("k3")))).alias("key")).distinct()
    stats = o.select("text").where("text is not null").mapInArrow(_statistics, "key string, n long, ends long, least long").join(used, "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.min("least").alias("least"))
    stats = stage(stats, "statistics")
    for k, name in (("k1", "1"), ("k2", "2")):
        ends = ends.join(stats.select(F.col("key").alias(k), F.col("n").alias(f"n{name}"), F.col("ends").alias(f"e{name}")), k, "left")
    ends = ends.withColumn("key", F.concat(F.lit("^"), "k3")).join(stats.select("key", F.col("n").alias("n3"), "least"), "key", "left")
    p = prompts.where("case_id is not null").groupBy("case_id").agg(F.min("user_text").alias("user_text"), F.min("system_text").alias("system_text"))
    return stage(o.join(ends.drop("k1", "k2", "k3", "key"), "draft_id", "left").join(p, "case_id", "left").select("draft_id", "text", "status", "stop_reason", "user_text", "system_text", "words", "n1", "e1", "n2", "e2", "n3", "least"), "pairs")


def sampled(pairs: DataFrame, size: int = SAMPLE) -> list[dict]:
    """At most ``size`` drafts in hash order: a quarter each of ones reported as refused, ones that speak of what cannot be
    done, unfinished and other ones, by what is easily seen."""
    reported = F.coalesce((F.col("status") == "refusal") | (F.col("stop_reason") == "refusal"), F.lit(False))
    cannot = F.lower("text").rlike("refus|declin|rather not|cannot|can't|can’t|won't|won’t|not able|unable|sorry|polic|guideline|puedo|prefiero|peux|préfère|nicht schreiben|lieber|darf|autoris|posso")
    kind = F.when(reported, 0).when(cannot, 1).when(F.col("words").isNotNull(), 2).otherwise(3)
    held = pairs.where("text is not null").withColumn("kind", kind)
    rows: list[dict] = []
    for k in range(4):
        rows += [r.asDict() for r in held.where(F.col("kind") == k).orderBy(F.xxhash64("draft_id"), "draft_id").limit(size // 4).collect()]
    return rows


def defects(outputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """(draft_id, defect): defective drafts with the first defect that fits."""
    pairs = joined(outputs, prompts)
    field = train(sampled(pairs))
    # The learned weights: BUCKETS x tags, whatever the size of the data.
    held = pairs.sparkSession.sparkContext.broadcast((field.w, field.move))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes, shown = Field.__new__(Field), Codes(), {}
        model.w, model.move = held.value
        for b in batches:
            out = []
            for r in b.to_pylist():
                d = Draft(r, codes, shown)
                found = defect(model.tag(d.features()), d.sizes) if d.parts else "empty"
                if found:
                    out.append((r["draft_id"], found))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["draft_id", "defect"])

    return pairs.mapInArrow(decide, "draft_id string, defect string").distinct()
