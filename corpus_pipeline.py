"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage works on all that the one
before it kept.  All but the last return the columns of documents, whatever others there are and
whatever they are called.  In every stage a row without identifier goes, a null text is an empty
one, and an empty table gives no rows; each says what becomes of empty texts and repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm.common import checkpoint, checkpoint_dir, remove_folder
from keyfold.llm.decontamination import drop_contaminated
from keyfold.llm.exact_dedup import drop_copies
from keyfold.llm.near_dup import Settings, drop_near_duplicates
from keyfold.llm.packing import pack_documents
from keyfold.llm.quality import drop_poor


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; empty texts are scored like any other, repeated rows stay or go together."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, then the smallest identifier; empty texts are one group, repeated rows copies."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five words, similarity 0.8; texts without words stay, of rows of one identifier the longest."""
    return drop_near_duplicates(docs, Settings(percent=80))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty texts stay, rows of one identifier stay or go together."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place; an empty text is its end id alone, repeated rows are documents each."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]

#: The classifier, the verified links and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet, read again by the next, and then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            out = checkpoint(out)
            remove_folder(spark, folder)
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
