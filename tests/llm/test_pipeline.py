"""Each stage against brute force, and on odd rows, clashing columns and empty tables."""

import pathlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keyfold.llm import common, decontamination, near_dup, quality, tokens

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def exact(docs):
    best = {}
    for doc, text in docs:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best[key] = min(best.get(key, (0, doc)), (-len(text or ""), doc))
    return sorted(doc for _, doc in best.values())


def near(docs):
    return sorted(x[0] for x in near_dup.brute_force(docs, 80) if x[3])


def decontaminate(docs, bench):
    return sorted(x[0] for x in decontamination.brute_force(docs, bench) if not x[1])


@pytest.mark.parametrize("name", ["exact", "near", "decontaminate"])
def test_stage_equals_brute_force(spark, name):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {"exact": exact, "near": near, "decontaminate": lambda d: decontaminate(d, bench)}[name](docs)
    out = STAGES[name](spark, df, SMALL)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == want


def test_near_keeps_small_tables_in_few_files(spark, monkeypatch):
    """Only the signatures are in as many files as the input has parts."""
    parts = []

    def checkpoint(df):
        out = common.checkpoint(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(near_dup, "checkpoint", checkpoint)
    df = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(64)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(r.doc_id for r in STAGES["near"](spark, df, SMALL).collect()) == near(docs)
    assert sorted(parts)[-1] == 64 and sorted(parts)[-2] <= 16


TEN = "one two three four five six seven eight nine ten"
ROWS = [
    (1, TEN, "a", 1, True),
    (2, TEN, "b", 2, True),
    (3, None, None, None, None),
    (4, "", "", 0, False),
    (5, " \t\n", "x", 3, False),
    (6, "word " * 30_000, "en", 4, True),
    (7, TEN.replace(" ", "  "), "en", 5, True),
    (8, "repeated row", "en", 6, False),
    (8, "repeated row", "en", 6, False),
    (8, "repeated row", "en", 7, False),
    (9, TEN, "c", 8, True),
    (9, "quite another text of the same identifier", "c", 9, True),
    (None, "nobody", None, None, None),
]
#: Names that the operators use themselves, and one with a dot.
CLASHING = "doc_id long, text string, label string, data long, kept boolean"
RENAMED = ["_digest", "_var", "_rank", "row", "component_id", "score", "predicted", "text_sha256", "k", "hash", "a.b"]


@pytest.fixture
def odd(spark):
    df = spark.createDataFrame(ROWS, CLASHING)
    for c in RENAMED:
        df = df.withColumn(c, F.lit(1))
    return df


def survivors(out):
    return sorted((r.doc_id, len(r.text or "")) for r in out.collect())


#: Who is left of the rows above: (doc_id, length of the text).
LEFT = {
    "exact": [(5, 3), (6, 150_000), (7, 57), (8, 12), (9, 41)],
    "near": [(1, 48), (3, 0), (4, 0), (5, 3), (6, 150_000), (8, 12)],
    "decontaminate": [(1, 48), (2, 48), (3, 0), (4, 0), (5, 3), (6, 150_000), (7, 57), (8, 12), (8, 12), (8, 12), (9, 41), (9, 48)],
}


@pytest.mark.parametrize("name", sorted(LEFT))
def test_stage_on_odd_rows(spark, odd, empty, name):
    out = STAGES[name](spark, odd, SMALL)
    assert out.columns == odd.columns and out.schema["a.b"].dataType == odd.schema["a.b"].dataType
    assert survivors(out) == LEFT[name]
    assert STAGES[name](spark, empty, SMALL).count() == 0


def test_quality_stage(spark, odd, empty):
    out = STAGES["quality"](spark, odd, SMALL)
    assert out.columns == odd.columns and all(r.doc_id is not None for r in out.collect())
    assert STAGES["quality"](spark, empty, SMALL).count() == 0
    df, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(df, labels)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    score = dict(zip(texts, model.score(np.array([quality.statistics(t.encode()) for t in texts.values()]))))
    got = {r.doc_id for r in STAGES["quality"](spark, df, SMALL).collect()}
    assert got == {i for i, x in score.items() if x >= quality.THRESHOLD}


def test_pack_stage(spark, odd, empty):
    out = STAGES["pack"](spark, odd, SMALL).collect()
    assert sorted((r.doc_id, r.piece) for r in out if r.piece == 0) == [(i, 0) for i in (1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 9, 9)]
    assert [r.length for r in out if r.doc_id in (3, 4)] == [1, 1] and len([r for r in out if r.doc_id == 6]) > 10
    assert STAGES["pack"](spark, empty, SMALL).count() == 0


def test_pipeline_is_its_stages_and_leaves_no_files(spark):
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("pipeline-*"))
    out = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = ["quality", "exact", "near", "decontaminate"]
    for name in names:
        docs = STAGES[name](spark, docs, SMALL)
    left = {r.doc_id: r.text for r in docs.collect()}
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, len(x) + 1) for i, x in zip(left, encoder.encode(list(left.values()))))
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert sorted(got.items()) == want
    assert set(folder.glob("pipeline-*")) == before


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(Session())
