"""Training rows for the classifiers: bounded samples of labelled documents, never of held-out ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from training: crc32 of the identifier as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows that are not held out.

    Which ones is decided by a hash of the identifier; a null label is no label, and of several
    labels of one document the largest counts.  The bound makes the identifiers safe to broadcast.
    """
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    label = label.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    few = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts(docs).join(F.broadcast(few), "doc_id")
