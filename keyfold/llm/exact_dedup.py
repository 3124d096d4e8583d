"""Exact dedup with a heavy-hitter split, in DataFrame and SQL functions alone.

A Misra-Gries sketch (``approx_top_k``, which merges partial sketches) names the digests that may
hold more than one row in ``SHARE``; there are at most ``SHARE`` of them whatever the table's size.
Their groups are counted and their winners chosen exactly, with map-side combining, and the
winners are broadcast so that the rows of a heavy digest never move.  The other digests, none of
which holds more than one row in ``SHARE``, are shuffled in the ordinary way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import all_columns, checkpoint, first_rows, free_name, keep_ids, texts

#: A digest is heavy if it holds more than 1 / SHARE of the rows; so many heavy ones there are at most.
SHARE = 1024
#: Counters of the sketch: its error is below 1 / (0.75 * COUNTERS) of the rows, a third of a heavy one's least count.
COUNTERS = 4 * SHARE

SPACES = " \t\n\x0b\x0c\r"


def normalised(text):
    """The text without space and 0x09-0x0D."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Texts are equal when identical without space and 0x09-0x0D; null counts as empty, and empty
    texts are equal.  Of equal texts the row with the most code points in its original text
    stays, then the smallest doc_id.  Rows that share an identifier count each and stay or go
    together; rows without identifier are left out.
    """
    rows = checkpoint(texts(docs, id_col, text_col).select("doc_id", F.char_length("text").alias("n"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256")))
    least = rows.count() / SHARE
    top = rows.select(F.expr(f"approx_top_k(text_sha256, {SHARE}, {COUNTERS})").alias("top"))
    heavy = checkpoint(top.select(F.explode("top").alias("t")).where(F.col("t.count") >= max(2, least)).select(F.col("t.item").alias("text_sha256")))
    # Exact counts and winners of what the sketch proposed: at most SHARE rows.
    best = F.max(F.struct("n", (-F.col("doc_id")).alias("back")))
    winners = checkpoint(rows.join(F.broadcast(heavy), "text_sha256").groupBy("text_sha256").agg(F.count("*").alias("group_size"), (-best["back"]).alias("keep_id")))
    settled = rows.join(F.broadcast(winners), "text_sha256")
    alike = Window.partitionBy("text_sha256").orderBy(F.desc("n"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").withColumns({"group_size": F.count("*").over(alike), "keep_id": F.first("doc_id").over(alike)})
    columns = ["doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"]
    return settled.select(*columns).unionByName(others.select(*columns))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns as they were.

    A repeated row goes like any other copy; rows that share an identifier but not a text are
    told apart; empty texts are one group; rows without identifier go.
    """
    digest = free_name(docs, "_digest")
    found = checkpoint(groups(docs).where("group_size > 1").select("doc_id", F.col("text_sha256").alias(digest), "kept"))
    named = docs.where("doc_id is not null").withColumn(digest, F.sha2(normalised(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256))
    out = keep_ids(named, found.where("not kept").select("doc_id", digest), "anti")
    again = checkpoint(found.where("kept").groupBy("doc_id", digest).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", digest))
    return first_rows(out, again).select(*all_columns(docs))


def op2_heavy_hitters(spark, sf_dir: str) -> DataFrame:
    """Contract query."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT doc_id, text_sha256,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
