"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import Output, all_columns, checkpoint, free_name, keep_ids, rows, texts
from .labelled import held_out, training_rows

#: Most labelled rows that training reads.
SAMPLE = 20_000
#: A document is kept from this score on.
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 end or pause, 6 symbol, 7 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9, 10, 11, 12, 13]], _CLASS[128:] = 1, 2, 3, 4, 7
_CLASS[list(b".,;:?'\"()-")], _CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 5, 6

FEATURES = ("log_bytes", "log_words", "word_bytes", "word_spread", "lower", "upper", "digits", "space", "pauses", "symbols", "wide", "exclaimed", "barred", "distinct_words", "commonest_word", "repeated_lines", "log_lines", "line_bytes", "ends_in_symbol", "capitals", "short_words", "long_words", "entropy", "repeated_pairs")


def statistics(text: bytes) -> list[float]:
    """The features of one text; all zero for an empty one."""
    data, words = np.frombuffer(text, np.uint8), text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, m = len(data), len(words)
    share = np.bincount(_CLASS[data], minlength=8) / n
    sizes = np.fromiter(map(len, words), np.int64, m)
    counts = np.bincount(data, minlength=256)
    p = counts[counts > 0] / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(words)
    last, first = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8), np.frombuffer(b"".join([w[:1] for w in words]), np.uint8)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(n), np.log1p(m), sizes.mean(), sizes.std(), share[1], share[2], share[3], share[4], share[5], share[6], share[7],
        counts[33] / m, counts[124] / m, len(seen) / m, max(seen.values()) / m, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)), n / len(lines),
        (_CLASS[last] == 6).mean(), (_CLASS[first] == 2).mean(), (sizes <= 2).mean(), (sizes > 12).mean(), -(p * np.log2(p)).sum(), 1 - pairs / max(1, m - 1),
    ]


def _scored(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, var, score): ``var`` is a hash of the text, which tells apart rows that share an identifier."""
    schema = pa.schema([("doc_id", pa.int64()), ("var", pa.int32()), ("score", pa.float64())])

    def score(batches):
        ids, vars_, found = [], [], []
        for doc, var, text in rows(batches, "doc_id", "var", "text"):
            ids.append(doc)
            vars_.append(var)
            found.append(statistics(text))
            if len(ids) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vars_, pa.int32()), pa.array(model.score(np.array(found)))], schema=schema)
                ids, vars_, found = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vars_, pa.int32()), pa.array(model.score(np.array(found)))], schema=schema)

    return docs.select("doc_id", F.hash("text").alias("var"), "text").mapInArrow(score, "doc_id long, var int, score double")


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> Trees:
    """Fit on at most ``most`` labelled rows, none of them held out; a constant without labels."""
    schema = pa.schema([("x", pa.list_(pa.float64())), ("label", pa.int32())])

    def measure(batches):
        out = Output(schema)
        for text, label in rows(batches, "text", "label"):
            out.add(statistics(text), label)
            if out.full():
                yield out.take()
        yield from out.rest()

    got = training_rows(docs, labels, column, most).select("text", "label").mapInArrow(measure, "x array<double>, label int").collect()
    got.sort(key=lambda r: (r["x"], r["label"]))  # the same trees however the rows arrive
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in got]) > 0)


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts have all-zero statistics and are scored like any other; rows without
    identifier are left out; repeated rows are scored each.  Without usable labels the score is
    one half.
    """
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, most=most)
    scored = _scored(texts(docs, id_col, text_col), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those the classifier rejects; columns as they were.

    Rows that share an identifier are judged each by its own text; repeated rows stay or go
    together; empty texts are scored like any other; rows without identifier go.
    """
    var = free_name(docs, "_var")
    scored = _scored(texts(docs), train(docs, labels))
    gone = checkpoint(scored.where(F.col("score") < threshold).select("doc_id", F.col("var").alias(var)).distinct())
    named = docs.where("doc_id is not null").withColumn(var, F.hash(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return keep_ids(named, gone, "anti").select(*all_columns(docs))


def op10_boosted_trees(spark, sf_dir: str) -> DataFrame:
    """Contract query."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
