"""Small helpers that every corpus operator uses."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A broadcast never holds more bytes than this; larger tables are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Beyond a broadcast, a key with more rows than this is joined apart from the others.
HEAVY_ROWS = 4096


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (string, null as empty) alone; rows without an identifier go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary folder; on a cluster, whose machines
    would not share it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        have = spark.sparkContext.getCheckpointDir()
    return named or have


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute now, keep in the shared checkpoint folder, forget the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fewer_parts(df: DataFrame, parts: int) -> DataFrame:
    """A quarter of the ``parts`` that ``df`` has, at least two for each core, without a shuffle: for light work on
    tables much smaller than what they come from.  Each part of a checkpoint is a file, and on ``file://`` each file
    costs its executor two processes that set permissions."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, parts // 4))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate files, wherever it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(n_bytes: int | None, per: int = 16 << 20) -> int:
    """Parts for so many bytes of text."""
    return max(1, -(-int(n_bytes or 0) // per))


def buckets_for(spark: SparkSession, n_bytes: int | None, per: int = 16 << 20) -> int:
    """Buckets for so many bytes: enough to bound each, and where there is work, two for each core."""
    return max(partitions_for(n_bytes, per), min(2 * spark.sparkContext.defaultParallelism, partitions_for(n_bytes, 1 << 20)))


def text_bytes(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


def _width(name: str, kind: str):
    """Bytes of a column's values: read for strings, binaries and arrays, eight for others."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(name), F.lit(0)).cast("long") + 8
    if kind.startswith("array"):
        return F.greatest(F.size(name), F.lit(0)).cast("long") * (16 if "string" not in kind else 64) + 8
    return F.lit(8).cast("long")


def is_small(table_: DataFrame, limit: int | None = None) -> bool:
    """Whether a table's rows and values take few enough bytes to broadcast.  Measured whole: a limit
    would bring every task's rows to a single one.  Callers hand over tables that are cheap to read again."""
    each = sum((_width(n, k) for n, k in table_.dtypes), F.lit(16).cast("long"))
    return (table_.select(F.sum(each)).first()[0] or 0) <= (BROADCAST_BYTES if limit is None else limit)


def keep_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the columns of ``ids``: a broadcast when they are few (measured), else a shuffle."""
    return docs.join(F.broadcast(ids) if is_small(ids) else ids, ids.columns, f"left_{how}")


def all_columns(docs: DataFrame) -> list:
    """The columns of a table as they are called, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def first_rows(docs: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` with one row for each key (the columns) of ``again``: the longest text, then the least values in all columns.

    Rows are ranked in part before they are shuffled, so a key may have any number of them.
    """
    if again.isEmpty():
        return docs
    rank, on = free_name(docs, "_rank"), again.columns
    values = [F.char_length("text").desc_nulls_last(), *(c.cast("string") for c in all_columns(docs))]
    many = keep_ids(docs, again, "semi").withColumn(rank, F.row_number().over(Window.partitionBy(*on).orderBy(*values))).where(F.col(rank) == 1)
    return keep_ids(docs, again, "anti").unionByName(many.drop(rank))


def attach(docs: DataFrame, lists: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(docs joined with their row of ``lists``, the docs that have none).

    When the ids in ``lists`` are few they are broadcast first, so that only texts with a row
    in ``lists`` are shuffled; beyond the limit the same joins run by shuffling.
    """
    ids = lists.select(*on)
    if is_small(ids):
        small = F.broadcast(ids)
        return docs.join(small, on, "left_semi").join(lists, on), docs.join(small, on, "left_anti")
    return docs.join(lists, on), docs.join(ids, on, "left_anti")


def lookup(df: DataFrame, unique: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``df`` with a table that has one row for each ``key``, where a key may hold most rows of ``df``.

    A small table is broadcast (measured).  Otherwise keys with over HEAVY_ROWS rows in ``df`` are
    looked up in a broadcast of their rows alone, of which there is at most one for each
    HEAVY_ROWS rows, and the other keys by a shuffle.  Both tables should be cheap to read again.
    """
    if is_small(unique):
        return df.join(F.broadcast(unique), key, how)
    many = checkpoint(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HEAVY_ROWS).select(key))
    heavy = checkpoint(unique.join(F.broadcast(many) if is_small(many) else many, key, "left_semi"))
    if not is_small(heavy, 8 * BROADCAST_BYTES):
        return df.join(unique, key, how)
    small = F.broadcast(many)
    return df.join(small, key, "left_semi").join(F.broadcast(heavy), key, how).unionByName(df.join(small, key, "left_anti").join(unique, key, how))


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, few at a time; strings arrive as UTF-8 bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            cols = []
            for n in names:
                c = part.column(n)
                if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
                    c = c.cast(pa.large_string()).cast(pa.large_binary())
                cols.append(c.to_pylist())
            yield from zip(*cols)


def table(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Output:
    """Collects rows and hands over Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most_rows: int = 4096, most_bytes: int = 8 << 20):
        self.schema, self.most_rows, self.most_bytes = schema, most_rows, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.size = 0

    def add(self, *values) -> None:
        for c, v in zip(self.columns, values):
            c.append(v)
            if isinstance(v, (bytes, str)):
                self.size += len(v)

    def full(self) -> bool:
        return len(self.columns[0]) >= self.most_rows or self.size >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        out = table(self.schema, self.columns)
        self._clear()
        return out

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()


def intervals(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of ``[s, s + length)`` for ascending starts, as maximal runs."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length


def unpack_runs(blob: bytes) -> np.ndarray:
    """Every place of runs (start, count), little-endian 32-bit pairs."""
    pairs = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
    counts = pairs[:, 1]
    if not len(pairs):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.repeat(pairs[:, 0] - (ends - counts), counts) + np.arange(ends[-1])
