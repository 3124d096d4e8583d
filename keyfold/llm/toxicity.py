"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else, labelled or not, is unlabelled.  With
class prior p the risk of a scorer is p E+[l(+)] + max(0, Eu[l(-)] - p E+[l(-)]): the second part
estimates the risk on negatives from unlabelled text, and is kept from turning negative, which is
where such learners overfit.  The prior is estimated from the same two samples.  The scorer is
linear in the distinct words of a text and their stems; its weights lower the risk with a smooth
loss, its decision point the same risk with errors counted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import Output, checkpoint, keep_ids, rows, texts
from .labelled import held_out, training_rows

#: Most confirmed toxic texts, and most unlabelled ones, that training reads.
POSITIVES, UNLABELLED = 8_000, 16_000
#: A word is a feature if so many toxic training texts hold it, and more than unlabelled ones do by so
#: many standard deviations; so many words at most, those that deviate most; and so many words of
#: texts at most reach the driver.
LEAST_TEXTS, DEVIATIONS, MOST_WORDS, MOST_ENTRIES = 5, 5.0, 1 << 13, 4_000_000
#: Parts, each of which is judged by a scorer of the others, to estimate the prior and the decision point.
FOLDS = 4
#: Bytes of a word that are its stems.
STEMS = (5,)
THRESHOLD = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def word_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of letters, A-Z lower-cased, and of their stems."""
    data = R.LOWER[np.frombuffer(text, np.uint8)]
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = _LETTER[data]
    edges = np.diff(solid)
    out = [np.zeros(0, np.uint64)]
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for i in range(0, len(starts), 1 << 18):
        a, z = starts[i], ends[min(i + (1 << 18), len(ends)) - 1]
        s, e = starts[i : i + (1 << 18)] - a, ends[i : i + (1 << 18)] - a
        out.append(np.unique(R.word_values(data[a:z], s, e)))
        for n in STEMS:
            out.append(np.unique(~R.word_values(data[a:z], s[e - s >= n], s[e - s >= n] + n)))
    return np.unique(np.concatenate(out))


class Words:
    """A linear scorer: sorted word hashes, their weights, a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def score(self, words: np.ndarray) -> float:
        if not len(self.hashes):
            return float(1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        margin = self.bias + self.weights[at[self.hashes[at] == words]].sum()
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def _descend(column: np.ndarray, owner: np.ndarray, n_words: int, positive: np.ndarray, prior: float, steps: int, rate: float, l1: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with logistic loss, by Adam with shrinkage."""
    n, w, bias = len(positive), np.zeros(n_words), float(np.log(prior / (1 - prior)))
    of_p, of_u = positive / positive.sum(), ~positive / (~positive).sum()
    mean, square = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, steps + 1):
        f = np.bincount(owner, w[column], n) + bias
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        # d l(+)/df = p - 1, d l(-)/df = p
        negative = (of_u * np.logaddexp(0, f)).sum() - prior * (of_p * np.logaddexp(0, f)).sum()
        on_negative = of_u * p - prior * of_p * p
        slope = prior * of_p * (p - 1) + on_negative if negative >= 0 else -on_negative
        g = np.append(np.bincount(column, slope[owner], n_words), slope.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        scale = rate / (np.sqrt(square / (1 - 0.999**t)) + 1e-6)
        step = scale * mean / (1 - 0.9**t)
        bias -= float(step[-1])
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - l1 * scale[:-1])
    return w, bias


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from the margins of both.

    Above any cut the unlabelled hold at least that share times what the positives hold there, so
    it is at most the least ratio of the two; cuts that fewer than a fifth of the positives reach
    say little and are left out.
    """
    cuts = np.quantile(positive, np.linspace(0, 0.8, 41))
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    return float(np.clip((u / p).min(), 0.001, 0.9))


def decision_point(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The cut of least non-negative risk with errors counted; of risks that the sample can't tell apart (half a
    standard error), the middle of the widest gap."""
    m = np.unique(np.concatenate([positive, unlabelled]))
    cuts = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    missed = np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    taken = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    risk = prior * missed + np.maximum(0, taken - prior * (1 - missed))
    gap = np.concatenate([[0], np.diff(m), [0]])
    least = risk.min()
    best = np.flatnonzero(risk <= least + 0.5 * np.sqrt(max(least, 1 / len(unlabelled)) / len(unlabelled)) + 1e-9)
    return float(cuts[best[np.argmax(gap[best])]])


def fit(column: np.ndarray, owner: np.ndarray, vocabulary: np.ndarray, positive: np.ndarray, steps: int = 200, rate: float = 0.05, l1: float = 1.5e-4) -> Words:
    """A linear scorer from positive and unlabelled texts: which word of ``vocabulary`` (``column``) which text (``owner``) holds.

    The prior and the decision point are estimated from margins that a scorer of other texts
    gives: first with a guessed prior, then with the estimate.  Without positives, unlabelled
    texts or features the score is near 0 for all.
    """
    if min(positive.sum(), (~positive).sum()) < 2 * FOLDS or not len(vocabulary):
        return Words(np.zeros(0, np.uint64), np.zeros(0), -5.0)
    fold = np.zeros(len(positive), np.int64)
    for k in (True, False):
        fold[positive == k] = np.arange((positive == k).sum()) % FOLDS
    prior = 0.1
    for _ in range(2):
        margin = np.zeros(len(positive))
        for k in range(FOLDS):
            kept, mine = fold != k, fold == k
            use = kept[owner]
            weights, _ = _descend(column[use], (np.cumsum(kept) - 1)[owner[use]], len(vocabulary), positive[kept], prior, steps, rate, l1)
            margin[mine] = np.bincount(owner, weights[column], len(positive))[mine]
        prior = class_prior(margin[positive], margin[~positive])
    cut = decision_point(margin[positive], margin[~positive], prior)
    weights, _ = _descend(column, owner, len(vocabulary), positive, prior, steps, rate, l1)
    return Words(vocabulary[weights != 0], weights[weights != 0], -cut)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Words:
    """Fit on bounded samples, chosen by a hash of the identifier, of rows that are not held out.

    Words are counted on the executors; the driver gets the vocabulary and, for each text, the
    places in it of the words that the text holds, MOST_ENTRIES in all.  Beyond that, texts are left out,
    in order of the hash.
    """
    toxic = labels.where("toxic = 1")
    pos = training_rows(docs, toxic, "toxic", positives).select(F.lit(1).alias("label"), "doc_id", "text")
    ids = texts(docs).select("doc_id").where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    sample = pos.unionByName(texts(docs).join(F.broadcast(ids), "doc_id").select(F.lit(0).alias("label"), "doc_id", "text"))
    schema = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("words", pa.list_(pa.int64()))])

    def words(batches):
        out = Output(schema, most_rows=256)
        for label, doc, text in rows(batches, "label", "doc_id", "text"):
            out.add(label, doc, pa.array(word_set(text).view(np.int64)))
            if out.full():
                yield out.take()
        yield from out.rest()

    sets = checkpoint(sample.mapInArrow(words, "label int, doc_id long, words array<long>"))
    size = {r.label: r["n"] for r in sets.groupBy("label").agg(F.count("*").alias("n")).collect()}
    held = sets.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    expected = (F.col("n") - F.col("toxic") + 1) / (size.get(0, 0) + 1) * size.get(1, 0)
    held = held.where(F.col("toxic") >= LEAST_TEXTS).withColumn("far", (F.col("toxic") - expected) / F.sqrt(expected)).where(F.col("far") >= DEVIATIONS)
    few = held.orderBy(F.desc("far"), "word").limit(MOST_WORDS).select("word")
    vocabulary = np.sort(few.toArrow().column("word").to_numpy().astype(np.int64).view(np.uint64))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def places(batches):
        out = Output(pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("places", pa.binary())]))
        for batch in batches:
            lists = batch.column("words")
            for i, (label, doc) in enumerate(zip(batch.column("label").to_pylist(), batch.column("doc_id").to_pylist())):
                x = lists[i].values.to_numpy().view(np.uint64)
                at = np.searchsorted(known.value, x)
                at = at[known.value[np.minimum(at, len(known.value) - 1)] == x] if len(known.value) else at[:0]
                out.add(label, doc, len(at), at.astype("<u4").tobytes())
                if out.full():
                    yield out.take()
        yield from out.rest()

    sparse = checkpoint(sets.mapInArrow(places, "label int, doc_id long, n long, places binary"))
    if (sparse.agg(F.sum("n")).first()[0] or 0) > MOST_ENTRIES:
        sizes = sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.n) for r in sparse.select("doc_id", "n").collect())
        first, total = [], 0
        for _, doc, n in sizes:
            total += n
            if total > MOST_ENTRIES:
                break
            first.append((doc,))
        sparse = keep_ids(sparse, docs.sparkSession.createDataFrame(first, "doc_id long"), "semi")
    got = sorted((r["label"], r["doc_id"], bytes(r["places"])) for r in sparse.select("label", "doc_id", "places").collect())
    column = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(p, "<u4") for _, _, p in got)]).astype(np.int64)
    owner = np.repeat(np.arange(len(got)), [len(p) // 4 for _, _, p in got])
    return fit(column, owner, vocabulary, np.array([k for k, _, _ in got], bool))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts have no words and get the score of the bias; rows without identifier are
    left out; repeated rows are scored each.  Without a confirmed toxic text every score is near 0.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches):
        out = Output(schema)
        for doc, text in rows(batches, "doc_id", "text"):
            out.add(doc, model.score(word_set(text)))
            if out.full():
                yield out.take()
        yield from out.rest()

    scored = texts(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_nonnegative_pu(spark, sf_dir: str) -> DataFrame:
    """Contract query."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
