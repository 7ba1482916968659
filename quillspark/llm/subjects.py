"""Problem 10: subject areas of documents, by truncated singular value decomposition and refined seed centroids.

1. Terms are words and pairs of adjacent words of a sentence.  A term weighs by how *bursty* it is among the documents of its
   language: the words of a subject come back in several sentences of one document, while words of moods, people, times and
   phrasing are spread over all.  The weight is the log ratio of the documents that would hold it if its sentences were dealt
   at random over the documents to those that do, times the inverse document frequency.  Terms that are not bursty beyond
   chance weigh nothing and leave the vocabulary, whatever their frequency: there is no other cut of it.
2. Documents are weighted sums of their terms, of length 1 and scaled so that every language counts alike; ``RANK`` right
   singular vectors come from subspace iteration.  Every pass adds (document vector) x (term weights) per partition and sums
   the partial matrices by blocks of terms, so the driver only ever holds a matrix of terms x ``RANK``.
3. Seed centroids are the means of the labelled documents of each subject, in each language, with the subject's description
   in the main language.  They are refined: every sentence of all documents goes to the centroid of its language with the
   largest cosine, and the centroids become the means of their sentences.  A language without labels for a subject takes the
   mean over all languages.
4. A sentence is about no area if it has no weight, or if no cosine is large or leads.  A document has every subject that at
   least ``SHARE`` of its sentences about any area are about.

Defined results: null or empty texts have no subject; repeated rows count once in the result; labels of unknown documents or
subjects count nothing; without any label the descriptions are the seeds; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.ids import slug
from quillspark.llm.language import FUNCTION_WORDS, LANGUAGES
from quillspark.llm.words import Codes, coded, mixed, slices, words
from quillspark.sources.staging import stage

RANK, PASSES, ROUNDS, SHARE = 100, 4, 5, 0.25
#: A term is bursty if it is in at least LEAST documents and at most OFTEN of a language's, and the log ratio of expected to
#: actual documents, times the root of these, is over BEYOND.
LEAST, OFTEN, BEYOND = 3, 0.4, 1.0
#: A sentence is about an area if its vector has this length, its cosine to the centroid this size and this lead.
WEIGHT, NEAR, LEAD = 0.02, 0.1, 0.02
#: Documents that a language counts as at least, so that a handful of them does not weigh like a language.
FEW = 50
PART = 2000
_SENTENCE = re.compile(r"[.!?\n]+")
#: The number of a language; documents of none that is known are the last one.
OTHER = len(LANGUAGES)


def _function_words() -> tuple[np.ndarray, np.ndarray]:
    """(sorted codes of the function words, their weight in each language)."""
    codes, weight = Codes(), {}
    for i, lang in enumerate(LANGUAGES):
        for w in set(FUNCTION_WORDS[lang].split()):
            weight.setdefault(codes[w], np.zeros(OTHER))[i] = 1.0
    keys = np.array(sorted(weight), np.uint64)
    table = np.array([weight[k] for k in keys.tolist()])
    return keys, table / table.sum(axis=1, keepdims=True)


_KEYS, _TABLE = _function_words()


def _tongues(flat: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The language of each of n documents by the function words among its words."""
    at = np.clip(np.searchsorted(_KEYS, flat), 0, len(_KEYS) - 1)
    hit = _KEYS[at] == flat
    score = _sums(doc[hit], _TABLE[at[hit]], n)
    two = np.sort(score, axis=1)[:, -2:]
    return np.where((two[:, 1] >= 1.0) & (two[:, 1] >= 1.2 * two[:, 0]), score.argmax(axis=1), OTHER)


def _raw_terms(texts: list[str | None], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, document, sentence) of every word and pair of words in order, the language of each document, and the
    document of each sentence."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        for s in _SENTENCE.split(t or ""):
            if s.strip():
                parts.append(s)
                owner.append(i)
    flat, sizes = coded(parts, codes)
    own = np.array(owner, np.int64)
    sentence = np.repeat(np.arange(len(parts)), sizes)
    pair = np.flatnonzero(sentence[1:] == sentence[:-1]) if len(flat) else np.empty(0, int)
    both = mixed(flat[pair] * np.uint64(0x9E3779B97F4A7C15) + flat[pair + 1]) if len(pair) else np.empty(0, np.uint64)
    terms = np.concatenate([flat, both])
    where = np.concatenate([sentence, sentence[pair]])
    order = np.argsort(where, kind="stable")
    doc = own[where[order]] if len(own) else np.empty(0, np.int64)
    tongue = _tongues(flat, own[sentence] if len(own) else np.empty(0, np.int64), len(texts))
    return terms[order].view(np.int64), doc, where[order], tongue, own


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of the key columns and how often each stands."""
    if not len(keys[0]):
        return np.empty((0, len(keys)), np.int64), np.empty(0, np.int64)
    order = np.lexsort(keys[::-1])
    rows = np.stack(keys, axis=1)[order]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[new], np.diff(np.append(new, len(rows)))


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tongue, kind, term, docs, sentences): per language the documents and sentences of each term (kind 0), and how many
    documents have each number of sentences (kind 1, term: the number)."""
    codes = Codes()
    for b in slices(batches, "text"):
        terms, doc, sentence, tongue, own = _raw_terms(b.column("text").to_pylist(), codes)
        per, _ = _counted([terms, sentence])
        in_doc, times = _counted([per[:, 0], own[per[:, 1]] if len(per) else per[:, 1]])
        lang = tongue[in_doc[:, 1]] if len(in_doc) else in_doc[:, 1]
        keys, docs = _counted([lang, in_doc[:, 0]])
        order = np.lexsort([in_doc[:, 0], lang])
        start = np.cumsum(docs) - docs
        sents = np.add.reduceat(times[order], start) if len(start) else docs
        size, count = _counted([tongue, np.bincount(own, minlength=len(tongue))])
        cols = (np.concatenate([keys[:, 0], size[:, 0]]), np.repeat([0, 1], [len(keys), len(size)]), np.concatenate([keys[:, 1], size[:, 1]]), np.concatenate([docs, count]), np.concatenate([sents, np.zeros(len(size), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["tongue", "kind", "term", "docs", "sentences"])


def burstiness(docs: np.ndarray, sentences: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weight of terms of one language; 0 where they are not bursty.

    ``docs``, ``sentences``: in how many a term stands; ``counts`` documents of the language have ``sizes`` sentences.
    """
    n, total = counts.sum(), max(1, (sizes * counts).sum())
    share = np.minimum(sentences / total, 1.0)
    expected = np.zeros(len(docs))
    for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
        expected += c * (1 - (1 - share) ** s)
    ratio = np.log(np.maximum(expected, 1e-9) / np.maximum(docs, 1))
    kept = (docs >= LEAST) & (docs <= OFTEN * n) & (ratio * np.sqrt(docs) > BEYOND)
    return np.where(kept, ratio * np.log(n / np.maximum(docs, 1)), 0.0)


def _weighted(shape: dict[int, tuple[np.ndarray, np.ndarray]]):  # noqa: ANN202
    """(term, tongue, sentences, weight), weight 0 where a term is not bursty.  ``shape``: sentence counts of the documents of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tongue, term, docs, sents = (b.column(c).to_numpy() for c in ("tongue", "term", "docs", "sentences"))
            w = np.zeros(len(term))
            for t in np.unique(tongue).tolist():
                own = tongue == t
                w[own] = burstiness(docs[own], sents[own], *shape[t])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (term, tongue, sents, w)], ["term", "tongue", "sentences", "weight"])

    return run


def _numbered(dictionary: np.ndarray):  # noqa: ANN202
    """Documents as lists of dictionary numbers, sentences ended by -1.  ``dictionary``: sorted term hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for b in slices(batches, "text"):
            terms, doc, sentence, tongue, _ = _raw_terms(b.column("text").to_pylist(), codes)
            at = np.clip(np.searchsorted(dictionary, terms), 0, max(0, len(dictionary) - 1))
            known = dictionary[at] == terms if len(dictionary) else np.zeros(len(terms), bool)
            at, doc, sentence = at[known], doc[known], sentence[known]
            cut = np.flatnonzero(np.diff(sentence)) + 1
            number = np.insert(at, np.append(cut, len(at)) if len(at) else cut, -1)
            where = np.insert(doc, np.append(cut, len(at)) if len(at) else cut, np.append(doc[cut - 1], doc[-1:]) if len(at) else [])
            sizes = np.bincount(where, minlength=len(tongue)) if len(where) else np.zeros(len(tongue), int)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(number.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(tongue.astype(np.int32))], ["doc_id", "terms", "tongue"])

    return run


def _chunks(batches: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple]:
    """(doc ids, term numbers, sentence of each, document of each sentence, languages, extra columns) of a few documents at a
    time."""
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            b = whole.slice(i, 1000)
            lists = b.column("terms")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            end = flat < 0
            sentence = np.cumsum(end) - end
            yield b.column("doc_id").to_pylist(), flat[~end], sentence[~end], doc[end], b.column("tongue").to_numpy(), *(b.column(c).to_pylist() for c in extra)


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each index."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(index):
        order = np.argsort(index, kind="stable")
        index = index[order]
        start = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        out[index[start]] = np.add.reduceat(rows[order], start, axis=0)
    return out


def _matrix(df: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], np.ndarray], rows: int, width: int) -> np.ndarray:
    """The sum over all partitions of the (rows x width) matrix that ``fold`` makes of each, added up by blocks of rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fold(batches)
        for k in range(0, rows, PART):
            if m[k : k + PART].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // PART]), pa.array([m[k : k + PART].astype(np.float32).tobytes()])], ["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p, np.float32).astype(np.float64) for p in pdf["part"]], axis=0)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [total.astype(np.float32).tobytes()]})

    # Two levels, so that no task adds the partial matrices of more than a share of the partitions.
    parts = df.mapInArrow(partial, "block long, part binary").withColumn("salt", F.spark_partition_id() % 16)
    some = parts.groupBy("block", "salt").applyInPandas(add, "block long, part binary")
    out = np.zeros((rows, width))
    for r in some.groupBy("block").applyInPandas(add, "block long, part binary").toLocalIterator():
        m = np.frombuffer(bytes(r["part"]), np.float32).reshape(-1, width)
        out[r["block"] * PART : r["block"] * PART + len(m)] = m
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)


def singular_vectors(docs: DataFrame, weight: np.ndarray, scale: np.ndarray, rank: int = RANK, passes: int = PASSES) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the weighted documents, by subspace iteration over all of them.

    Documents have length 1 times the ``scale`` of their language.
    """
    rank = min(rank, len(weight))
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((len(weight), rank)))[0]
    for _ in range(passes):
        held = docs.sparkSession.sparkContext.broadcast((q * weight[:, None]).astype(np.float32))

        def fold(batches: Iterator[pa.RecordBatch], held=held) -> np.ndarray:  # noqa: ANN001
            y = np.zeros((len(weight), rank), np.float32)
            for ids, terms, sentence, owner, tongue in _chunks(batches):
                if len(terms):
                    doc = owner[sentence]
                    key, times = _counted([doc, terms])
                    length = np.bincount(key[:, 0], (times * weight[key[:, 1]]) ** 2, len(ids))
                    of = scale[tongue] / np.sqrt(np.maximum(length, 1e-12))
                    z = _sums(doc, held.value[terms], len(ids)) * (of**2)[:, None].astype(np.float32)
                    order = np.argsort(terms, kind="stable")
                    used, at = np.unique(terms[order], return_index=True)
                    y[used] += np.add.reduceat(z[doc[order]], at, axis=0)
            return y * weight[:, None].astype(np.float32)

        q = np.linalg.qr(_matrix(docs, fold, len(weight), rank))[0]
    return q


def _assigner(centroids: np.ndarray):  # noqa: ANN202
    """Sentence vectors and the languages of their documents to the number of the area; the number of areas if it is none.

    ``centroids``: languages x areas x dimensions, those that are not known zero.
    """
    joint = _unit(_unit(centroids).sum(axis=0))
    known = np.abs(centroids).sum(axis=2, keepdims=True) > 0
    held = np.where(known, _unit(centroids), joint[None]).astype(np.float32)

    def assign(z: np.ndarray, tongue: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(z, axis=1)
        u = z / np.maximum(size, 1e-9)[:, None]
        best = np.full(len(z), centroids.shape[1])
        for t in np.unique(tongue).tolist():
            own = np.flatnonzero(tongue == t)
            cos = u[own] @ held[t].T
            two = np.sort(cos, axis=1)[:, -2:] if cos.shape[1] > 1 else np.concatenate([np.zeros_like(cos), cos], axis=1)
            sure = (size[own] > WEIGHT) & (two[:, 1] > NEAR) & (two[:, 1] - two[:, 0] > LEAD)
            best[own[sure]] = cos[sure].argmax(axis=1)
        return best

    return assign


def _seeds(labelled: DataFrame, terms: np.ndarray, names: list[str]) -> np.ndarray:
    """languages x subjects x dimensions: sums of the vectors of the labelled documents."""
    number = {s: i for i, s in enumerate(names)}

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(((OTHER + 1) * len(names), terms.shape[1]), np.float32)
        for ids, term, sentence, owner, tongue, subjects in _chunks(batches, "subjects"):
            z = _unit(_sums(owner[sentence] if len(term) else term, terms[term], len(ids)))
            for i, own in enumerate(subjects):
                for s in own:
                    out[tongue[i] * len(names) + number[s]] += z[i]
        return out

    return _matrix(labelled, fold, (OTHER + 1) * len(names), terms.shape[1]).reshape(OTHER + 1, len(names), -1)


def _moved(docs: DataFrame, terms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids as the sums of the unit vectors of the sentences nearest to them."""
    assign, k = _assigner(centroids), centroids.shape[1]

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(((OTHER + 1) * k, terms.shape[1]), np.float32)
        for _, term, sentence, owner, tongue in _chunks(batches):
            if len(term):
                z = _sums(sentence, terms[term], len(owner))
                best, lang = assign(z, tongue[owner]), tongue[owner]
                sure = best < k
                out += _sums(lang[sure] * k + best[sure], _unit(z[sure]), len(out))
        return out

    return _matrix(docs, fold, (OTHER + 1) * k, terms.shape[1]).reshape(centroids.shape)


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the bursty terms, their weights, number of documents of each language).

    Only bursty terms come to the driver: the vocabulary of the subjects, not of the corpus.
    """
    stats = stage(docs.mapInArrow(_profiles, "tongue long, kind long, term long, docs long, sentences long").groupBy("tongue", "kind", "term").agg(F.sum("docs").alias("docs"), F.sum("sentences").alias("sentences")).where(f"kind = 1 or docs >= {LEAST}"), "profile")
    # Numbers of sentences in steps of 5 %, so that a language has a bounded number of them.
    step = F.when(F.col("term") > 20, F.round(F.pow(F.lit(1.05), F.round(F.log(F.col("term").cast("double")) / math.log(1.05)))).cast("long")).otherwise(F.col("term"))
    shape: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows = stats.where("kind = 1").groupBy("tongue", step.alias("size")).agg(F.sum("docs").alias("n")).collect()
    for t in {r["tongue"] for r in rows}:
        own = [(r["size"], r["n"]) for r in rows if r["tongue"] == t]
        shape[t] = (np.array([s for s, _ in own], float), np.array([n for _, n in own], float))
    weighted = stats.where("kind = 0").mapInArrow(_weighted(shape), "term long, tongue long, sentences long, weight double")
    # A term has the weight of the language that it stands in most, also if that is nothing.
    top = weighted.groupBy("term").agg(F.max(F.struct("sentences", "tongue", "weight"))["weight"].alias("weight")).where("weight > 0").toPandas().sort_values("term")
    per = np.zeros(OTHER + 1)
    for t, (_, n) in shape.items():
        per[t] = n.sum()
    return top["term"].to_numpy(np.int64), top["weight"].to_numpy(float), per


def model(docs: DataFrame, dictionary: np.ndarray, weight: np.ndarray, per: np.ndarray, names: list[str], described: dict[str, str], labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(terms x dimensions: weighted term vectors; languages x subjects x dimensions: the refined centroids)."""
    main = int(per[:OTHER].argmax()) if per[:OTHER].any() else OTHER
    count = np.maximum(np.where(np.arange(OTHER + 1) == OTHER, per.max(), per), FEW)
    terms = (singular_vectors(docs, weight, 1 / np.sqrt(count)) * weight[:, None]).astype(np.float32)
    labelled = docs.join(labels.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")), "doc_id")
    centroids = _seeds(labelled, terms, names)
    codes = Codes()
    for i, s in enumerate(names):
        # A word of the description counts in the form without its last letter too: most are plurals.
        own = np.array([codes[x] for w in words(described[s]) for x in (w, w[:-1])], np.uint64).view(np.int64)
        at = np.clip(np.searchsorted(dictionary, own), 0, len(dictionary) - 1)
        centroids[main, i] += _unit(terms[at[dictionary[at] == own]]).sum(axis=0)
    # What all subjects of a language have in common tells none of them.
    first = _unit(centroids)
    known = np.abs(first).sum(axis=2, keepdims=True) > 0
    middle = first.sum(axis=1, keepdims=True) / np.maximum(known.sum(axis=1, keepdims=True), 1)
    centroids = np.where(known, first - middle, 0.0)
    for _ in range(ROUNDS):
        centroids = _moved(docs, terms, centroids)
    return terms, centroids


def subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject): every area that at least ``SHARE`` of the document's sentences about any area are about."""
    spark: SparkSession = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    described = {r["subject"]: r["description"] or "" for r in areas.select("subject", "description").where("subject is not null").distinct().orderBy("subject").collect()}
    names = list(described)
    dictionary, weight, per = vocabulary(docs) if names else (np.empty(0), np.empty(0), np.empty(0))
    if not len(dictionary):
        return spark.createDataFrame([], "doc_id long, subject string")
    numbered = stage(docs.mapInArrow(_numbered(dictionary), "doc_id long, terms array<int>, tongue int").where(F.size("terms") > 0), "terms")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), slug(F.col("subject")).alias("s")).join(F.broadcast(areas.select("subject", slug(F.col("subject")).alias("s")).distinct()), "s").select("doc_id", "subject")
    terms, centroids = model(numbered, dictionary, weight, per, names, described, known)
    held = spark.sparkContext.broadcast((terms, centroids))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, centroids = held.value
        assign = _assigner(centroids)
        for ids, term, sentence, owner, tongue in _chunks(batches):
            if not len(term):
                continue
            best = assign(_sums(sentence, terms[term], len(owner)), tongue[owner])
            tally = np.zeros((len(ids), len(names) + 1))
            np.add.at(tally, (owner, best), 1)
            about = tally[:, :-1].sum(axis=1, keepdims=True)
            doc, s = np.nonzero((tally[:, :-1] > 0) & (tally[:, :-1] >= SHARE * about))
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array([names[i] for i in s], pa.string())], ["doc_id", "subject"])

    return numbered.mapInArrow(decide, "doc_id long, subject string").distinct()


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, n_docs, share of all documents)."""
    total = documents.select("doc_id").distinct().count()
    return found.groupBy("subject").agg(F.count("*").alias("n_docs")).withColumn("share", F.round(F.try_divide(F.col("n_docs"), F.lit(total)), 6))
