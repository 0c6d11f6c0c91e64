"""Toxicity by multiple-instance learning: documents are bags of sentences.

Only documents carry labels. A sentence's probability is a logistic function
of its words; a document's is the noisy-or of its sentences, so one offending
sentence is enough and a long clean document does not add up to a toxic one.
Weights are fitted on document labels through that noisy-or, which leaves the
sentence scores to say where the offence lies.

The model is fitted on the driver from a bounded sample of labelled rows: the
rows of least hash, at most ``sample_rows`` of them and while their whole texts
come to at most ``sample_bytes``. Features are words and their first bytes, the
``features`` of them that tell the sample's labels apart best, of those that
``least_documents`` of the sample hold; both are the model's size, parameters
of ``train``. Everything else is a map over all documents.

Defined cases: a null or empty text, or one without words, has no sentence
and takes the score of the bias alone as of one empty sentence; a null doc_id
counts as held out from nothing (its remainder is that of the empty text);
repeated rows score alike; labels that are null, or disagree on a document,
count as toxic if any says so; no labelled rows of either kind give score 0;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import SLICE_BYTES, bound_batches, checkpointed, column, map_texts, release, text_rows
from .vectext import LOWER, Texts, eights, owner, span_hashes

#: Seed of the hashes that name features.
FEATURE_SEED = 0xD1B54A32D192ED03
#: Labelled rows and bytes that the model is fitted on, and features it may hold: they bound the driver's memory.
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 64 << 20
FEATURES = 20_000
#: Documents of the sample that must hold a feature (fewer in samples of under 150).
LEAST_DOCUMENTS = 4
TABLE_BITS = 18
#: Bytes of a word's beginnings that are features beside the word.
BEGINNINGS = (4, 5, 6, 7)

SCORES = "doc_id long, held_out boolean, score double, predicted int, n_sentences int, worst_start int, worst_end int, worst_score double"

#: Bytes of words: ASCII letters and all bytes of longer characters.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
#: Bytes that end a sentence.
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n\r"]] = True


@dataclass
class Bags:
    """Features of a block of texts with their sentences: ``sentence`` of each (global), ``first`` sentence of each text."""

    word: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bags(texts: Texts) -> Bags:
    """Hashes of lower-cased words and of their beginnings, each sentence holding at least one word."""
    data, n = LOWER[texts.data], len(texts.data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = IN_WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[texts.bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    start = np.flatnonzero(inside & (~before | cut))
    end = np.flatnonzero(before & (~inside | cut))
    breaks = np.zeros(n + 1, np.int64)
    np.cumsum(ENDS[data], out=breaks[1:])
    doc = owner(texts.bounds, start)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (breaks[start[1:]] != breaks[start[:-1]]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(start)) - 1
    first = np.searchsorted(doc[begin], np.arange(len(texts) + 1))
    at = eights(data)
    hashes, of = [span_hashes(data, start, end, FEATURE_SEED, at)], [sentence]
    for size in BEGINNINGS:
        longer = np.flatnonzero(end - start > size)
        hashes.append(span_hashes(data, start[longer], start[longer] + size, FEATURE_SEED, at))
        of.append(sentence[longer])
    return Bags(np.concatenate(hashes), np.concatenate(of), first, start[begin], end[last] if len(last) else last)


@dataclass
class Model:
    """Sorted word hashes with their weights, the bias, and a small table that rules out most other words."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    constant: bool = False

    def __post_init__(self):
        self.maybe = np.zeros(1 << TABLE_BITS, bool)
        self.maybe[(self.words & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes))
        rows = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
        if len(rows):
            at = np.minimum(np.searchsorted(self.words, hashes[rows]), len(self.words) - 1)
            out[rows] = np.where(self.words[at] == hashes[rows], self.weights[at], 0.0)
        return out


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def distinct_pairs(sentence: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word once in each sentence."""
    order = np.lexsort((word, sentence))
    s, w = sentence[order], word[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    return s[keep], w[keep]


def fit(vocabulary: np.ndarray, documents: list[tuple[int, np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 2e-5) -> Model:
    """Weights by Adam on the log-likelihood of the noisy-or.

    ``vocabulary`` is sorted; a document is its number of sentences and distinct (sentence, place in the vocabulary) pairs.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(1, np.uint64), np.zeros(1), 0.0, True)
    base = np.cumsum([0] + [max(1, n) for n, _, _ in documents])
    s = np.concatenate([p + b for (_, p, _), b in zip(documents, base, strict=False)])
    f = np.concatenate([w for _, _, w in documents])
    of = np.repeat(np.arange(len(documents)), np.diff(base))
    n, size = int(base[-1]), len(vocabulary)
    y = labels.astype(bool)
    theta = np.zeros(size + 1)
    theta[-1] = np.log(max(y.mean(), 1e-4) / max(n / len(labels), 1.0))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(s, theta[f], n) + theta[-1]
        hazard = np.maximum(np.bincount(of, softplus(z), len(y)), 1e-12)
        slope = np.where(y, -1.0 / np.expm1(np.minimum(hazard, 700.0)), 1.0)
        dz = slope[of] / (1.0 + np.exp(-z))
        grad = np.append(np.bincount(f, dz[s], size), dz.sum()) / len(y)
        grad[:-1] += decay * (np.sign(theta[:-1]) + theta[:-1])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(vocabulary, theta[:-1], float(theta[-1])) if size else Model(np.zeros(1, np.uint64), np.zeros(1), float(theta[-1]))


def document_pairs(texts: Texts, vocabulary: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Number of sentences and distinct (sentence, place in the vocabulary) pairs of each text."""
    found = bags(texts)
    at = np.minimum(np.searchsorted(vocabulary, found.word), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == found.word if len(vocabulary) else np.zeros(len(found.word), bool)
    s, f = distinct_pairs(found.sentence[known], at[known])
    cut = np.searchsorted(s, found.first)
    return [(int(found.first[i + 1] - found.first[i]), s[a:b] - found.first[i], f[a:b]) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))]


def scored(model: Model, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of sentences, and span and score of the worst sentence of each text."""
    n = len(texts)
    if model.constant:
        return np.zeros(n), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
    found = bags(texts)
    count = len(found.start)
    weight = model.of_words(found.word)
    hit = np.flatnonzero(weight)
    s, w = distinct_pairs(found.sentence[hit], found.word[hit])
    z = np.bincount(s, model.of_words(w), count) + model.bias if count else np.zeros(0)
    sizes = np.diff(found.first)
    hazard = np.where(sizes > 0, 0.0, softplus(np.array(model.bias)))
    worst = np.full(n, -1)
    if count:
        doc = np.repeat(np.arange(n), sizes)
        hazard += np.bincount(doc, softplus(z), n)
        order = np.lexsort((np.arange(count), -z, doc))
        some = sizes > 0
        worst[some] = order[found.first[:-1][some]]
    start = np.where(worst >= 0, found.start[worst] - texts.bounds[:-1] if count else 0, 0)
    end = np.where(worst >= 0, found.end[worst] - texts.bounds[:-1] if count else 0, 0)
    top = np.where(worst >= 0, 1 / (1 + np.exp(-z[worst])) if count else 0.0, 0.0)
    return -np.expm1(-hazard), sizes.astype(np.int32), start.astype(np.int32), end.astype(np.int32), top


def remainder(doc_id, folds: int = 5):
    """crc32 of the identifier's decimal text, modulo ``folds``."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, features: int = FEATURES, least_documents: int = LEAST_DOCUMENTS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fit on at most ``sample_rows`` labelled documents outside fold 0, of ``sample_bytes`` together."""
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    marks = marks.filter(remainder("doc_id", folds) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # a bound on rows, so it may be broadcast
    texts = text_rows(docs, id_col, text_col).filter("doc_id is not null").join(F.broadcast(sample), "doc_id")

    texts = checkpointed(texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")))  # rows of one identifier count once
    # at most ``sample_rows`` sizes, taken up in the order of the hashes
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = texts.select("doc_id", upto.alias("_upto")).filter(F.col("_upto") <= sample_bytes).select("doc_id")
    texts = texts.join(F.broadcast(within), "doc_id")

    def counted(batch, texts):
        found = bags(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(found.first))[found.sentence]
        doc, word = distinct_pairs(doc, found.word)
        hit = column(batch, "toxic").to_numpy()[doc] > 0
        distinct, back = np.unique(word, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(np.bincount(back[hit], minlength=len(distinct))), pa.array(np.bincount(back[~hit], minlength=len(distinct)))], ["word", "ones", "zeros"])

    rows = texts.select("doc_id", "toxic", "text")
    seen = map_texts(rows, counted, "word long, ones long, zeros long").groupBy("word").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    sizes = {r["toxic"] > 0: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    one, zero = sizes.get(True, 0), sizes.get(False, 0)
    if not one or not zero:
        return fit(np.zeros(0, np.uint64), [], np.zeros(0))
    # how far a feature's rates lie apart, against what chance would give
    n = F.col("ones") + F.col("zeros")
    apart = F.abs(F.col("ones") / one - F.col("zeros") / zero) / F.sqrt(n * (1.0 / one + 1.0 / zero) / (one + zero))
    best = seen.filter(n >= min(least_documents, 1 + (one + zero) // 50)).orderBy(apart.desc(), "word").limit(features)
    vocabulary = np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64).view(np.uint64))

    def featured(batch, texts):
        pairs = document_pairs(texts, vocabulary)
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "toxic"), pa.array([p[0] for p in pairs], pa.int64()), pa.array([np.stack(p[1:]).astype("<i4").tobytes() for p in pairs], pa.binary())],
            ["doc_id", "toxic", "sentences", "pairs"],
        )

    got = sorted((r["doc_id"], r["toxic"], r["sentences"], bytes(r["pairs"])) for r in map_texts(rows, featured, "doc_id long, toxic int, sentences long, pairs binary").toLocalIterator())
    documents = [(n, *np.frombuffer(b, "<i4").reshape(2, -1).astype(np.int64)) for _, _, n, b in got]
    return fit(vocabulary, documents, np.array([t for _, t, _, _ in got]) > 0)


def score_documents(docs: DataFrame, model: Model, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document; the worst sentence is given by its byte span."""

    def work(batch, texts):
        score, sentences, start, end, top = scored(model, texts)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(sentences), pa.array(start), pa.array(end), pa.array(top)], [c.split()[0] for c in SCORES.split(", ")])

    rows = text_rows(docs, id_col, text_col).select("doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "text")
    return map_texts(rows, work, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score_documents(docs, train(docs, labels, folds, sample_rows), folds)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose own text scores below ``threshold``."""
    model = train(docs, labels, folds, sample_rows)
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = Texts.of_arrow(batch.column(at).cast(pa.large_string()))
                clean = np.concatenate([scored(model, part)[0] < threshold for _, part in texts.slices(SLICE_BYTES)])
                yield batch.filter(pa.array(clean))
        release()

    return docs.mapInArrow(run, docs.schema)
