"""Histogram, least squares, matrix products, row means and covariance, k-means."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as K
from .. import operators as A

CLUSTERS = 4


def histogram(channels: DataFrame) -> DataFrame:
    """(key, count) of columns b, g, r of bytes: keys 1000 + b, 2000 + g, 3000 + r."""
    keys = F.array(*((F.col(c) + 1000 * (i + 1)).cast("int") for i, c in enumerate("bgr")))
    return channels.select(F.explode(keys).alias("key")).groupBy("key").agg(A.count().alias("count"))


def rgb_histogram(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return histogram(t.select((F.col("l_partkey") % 256).alias("b"), (F.col("l_suppkey") % 256).alias("g"), (F.floor("l_extendedprice") % 256).alias("r")))


def _points(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("bigint").alias("x"), F.round(F.col("l_discount") * 100).cast("bigint").alias("y"))


def linreg_sums(spark, d):
    return A.least_squares(_points(spark, d), "x", "y").select("n", "sx", "sy", "sxx", "syy", "sxy")


def linreg_fit(spark, d):
    return A.least_squares(_points(spark, d), "x", "y").select(*(F.round(c, 6).alias(c) for c in ("a", "b", "xbar", "ybar", "r2")))


def _matrix(spark, d) -> DataFrame:
    """(row, v): every row and component of the embeddings as integers."""
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.select(F.col("vec_id").cast("bigint").alias("row"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("bigint")).alias("v"))


def cells(rows: DataFrame) -> DataFrame:
    """(i, j, v) of (row, v)."""
    return rows.select(F.col("row").alias("i"), F.posexplode("v").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), "v")


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two tables of cells (i, j, v): a join and an aggregation."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("col"), F.col("v").alias("w"))
    return a.join(right, a["j"] == right["k"]).groupBy("i", F.col("col").alias("j")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def blocked_product(a: DataFrame, b: DataFrame, block: int = 8) -> DataFrame:
    """The same in blocks: rows of a block travel together, partial sums are added at the end."""
    cut = lambda c: F.expr(f"{c} div {block}")
    left = a.groupBy(cut("j").alias("kb"), "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("x"))
    right = b.groupBy(cut("i").alias("kb"), "j").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("y"))
    terms = F.transform(F.map_entries("x"), lambda e: e.value * F.coalesce(F.try_element_at("y", e.key), F.lit(0)))
    part = F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, t: s + t)
    return left.join(right, "kb").select("i", "j", part.alias("v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def transposed(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def matmul(spark, d):
    """E'E over every row and component of the embeddings."""
    m = cells(_matrix(spark, d))
    return product(transposed(m), m)


def matmul_blocked(spark, d):
    """The same, a block of rows at a time."""
    m = cells(_matrix(spark, d))
    return blocked_product(transposed(m), m, 16)


def means(rows: DataFrame) -> DataFrame:
    """(row, mean): truncated toward zero."""
    return rows.select("row", F.expr("aggregate(v, 0L, (s, x) -> s + x) div size(v)").alias("mean"))


def row_mean(spark, d):
    """The mean of every row, over all its components."""
    return means(_matrix(spark, d))


#: Rows of a block in ``covariance``.
BLOCK = 512
CELLS = "i long, j long, d long"


def covariance(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, cov) of rows i <= j; the divisor is the number of rows less one, truncated toward zero.

    Every pair of rows is a cell of the result.  Rows are dealt to blocks, each row sent once for
    every block of its partners, and a task multiplies two blocks, whatever their number.
    """
    n = rows.count()
    blocks = max(1, -(-n // block))
    centred = rows.join(means(rows), "row").select("row", F.transform("v", lambda x: x - F.col("mean")).alias("c"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    dealt = centred.select("row", "c", "b", others).select("row", "c", "b", F.least("b", "o").alias("one"), F.greatest("b", "o").alias("two"))

    def multiply(t: pa.Table) -> pa.Table:
        at, of = t.column("row").to_numpy(), t.column("b").to_numpy()
        x = np.array(t.column("c").to_pylist(), np.int64)
        one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
        a, b = np.flatnonzero(of == one), np.flatnonzero(of == two)
        dots = x[a] @ x[b].T
        i, j = np.broadcast_to(at[a][:, None], dots.shape), np.broadcast_to(at[b][None, :], dots.shape)
        keep = (i <= j) if one == two else np.ones(dots.shape, bool)
        low, high = np.minimum(i, j)[keep], np.maximum(i, j)[keep]
        return pa.table([low, high, dots[keep]], names=["i", "j", "d"])

    return dealt.groupBy("one", "two").applyInArrow(multiply, CELLS).select("i", "j", F.expr(f"d div {max(1, n - 1)}").alias("cov"))


def column_covariance(rows: DataFrame) -> DataFrame:
    """``covariance`` of the transposed matrix: its rows, the places of v, may be of any length.

    Each task sums products of whole batches of rows; one row for each pair of places and task is shuffled.
    """

    def products(batches):
        total = None
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), np.int64)
            if len(x):
                x = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)  # so that sums and the count stand in the first row
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "d"])

    sums = rows.select("v").mapInArrow(products, CELLS).groupBy("i", "j").agg(F.sum("d").alias("d"))
    n = F.broadcast(sums.where("i = 0 and j = 0").select(F.col("d").alias("n")))
    of = sums.where("i = 0 and j > 0").crossJoin(n).select("j", F.col("d").alias("s"), F.expr("d div n").alias("mean"), "n")
    m = F.broadcast(of.agg(F.greatest(F.lit(1), F.count("*") - 1).alias("m")))
    a, b = of.select(F.col("j").alias("i"), F.col("s").alias("sa"), F.col("mean").alias("ma"), "n"), of.select("j", F.col("s").alias("sb"), F.col("mean").alias("mb"))
    out = sums.where("i > 0").join(a, "i").join(b, "j").crossJoin(m)
    return out.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.expr("(d - mb * sa - ma * sb + n * ma * mb) div m").alias("cov"))


def covariance_upper(spark, d):
    """Covariance of every pair of rows of the embeddings."""
    return covariance(_matrix(spark, d))


def covariance_components(spark, d):
    """Covariance of the components over every row."""
    return column_covariance(_matrix(spark, d))


def assign(points: DataFrame, centres: list[list[int]]) -> DataFrame:
    """``points`` (id, v) with k, the nearest centre, the first of equals; the centres are literals, few by definition."""
    each = [F.struct(K.squared_distance(F.col("v"), F.array(*(F.lit(x).cast("bigint") for x in c))).alias("dist"), F.lit(k).cast("bigint").alias("k")) for k, c in enumerate(centres)]
    return points.withColumn("k", F.array_min(F.array(*each))["k"])


def step(points: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """New centres: truncated means of their points; a centre without points stays.

    Each task adds up its points and hands on one row for each centre.
    """
    old = np.array(centres, np.int64)

    def add(batches):
        total, n = np.zeros(old.shape, np.int64), np.zeros(len(old), np.int64)
        for batch in batches:
            x = _vectors_of(batch)
            k = nearest_centre(x, old)
            np.add.at(total, k, x)
            n += np.bincount(k, minlength=len(old))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(old)), pa.int64()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["k", "n", "s"])

    new = [list(c) for c in centres]
    parts = points.select("v").mapInArrow(add, "k long, n long, s array<long>")
    places = F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(old.shape[1])))
    sums = parts.groupBy("k").agg(F.sum("n").alias("n"), places.alias("s"))
    for r in sums.collect():  # K rows of numbers
        if r["n"]:
            new[r["k"]] = [(abs(x) // r["n"]) * (1 if x >= 0 else -1) for x in r["s"]]
    return new


def _vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals; exact, in integers."""
    best, at = None, np.zeros(len(x), np.int64)
    for k, c in enumerate(centres):
        d = ((x - c) ** 2).sum(1)
        if best is None:
            best = d
        else:
            closer = d < best
            best, at = np.where(closer, d, best), np.where(closer, k, at)
    return at


def kmeans(points: DataFrame, k: int, most_rounds: int | None = None) -> list[list[int]]:
    """Centres, from the first ``k`` points (id, v), until no point changes its centre.

    No point does once the centres stay, since centres alone decide.  ``most_rounds`` ends it
    earlier, with a warning.  Truncated means could in principle return to earlier centres; that
    would go on for ever and is an error.  Points are read once and kept as far as memory holds.
    """
    kept = points.select("id", "v").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres = [r["v"] for r in kept.orderBy("id").limit(k).collect()]
        seen: set[str] = set()
        while centres and (most_rounds is None or len(seen) < most_rounds):
            new = step(kept, centres)
            if new == centres:
                return centres
            seen.add(str(centres))
            if str(new) in seen:
                raise ValueError(f"k-means returns to earlier centres after {len(seen)} rounds")
            centres = new
    finally:
        kept.unpersist()
    if centres:
        warnings.warn(f"k-means ended after {most_rounds} rounds without having converged", stacklevel=2)
    return centres


def _vectors(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.select(F.col("vec_id").cast("bigint").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("bigint")).alias("v"))


def _first(points: DataFrame) -> list[list[int]]:
    return [r["v"] for r in points.orderBy("id").limit(CLUSTERS).collect()]


def kmeans_assign(spark, d):
    points = _vectors(spark, d)
    return assign(points, _first(points)).select("id", "k")


def kmeans_step(spark, d):
    points = _vectors(spark, d)
    return A.vector_mean(assign(points, _first(points)), "k", "v").select("k", F.col("pos").cast("bigint").alias("pos"), "mean", "n")


def kmeans_fit(spark, d):
    """Sizes of the clusters once no point changes its centre."""
    points = _vectors(spark, d)
    return assign(points, kmeans(points, CLUSTERS)).groupBy("k").agg(A.count().alias("n"))


def kmeans_grid(spark, d):
    """The generated grid of the clustering program."""
    from ..sources import grid_points

    points = grid_points(spark, 5000, 10, 40)
    return points.select(F.posexplode("v").alias("pos", "x")).groupBy(F.col("pos").cast("bigint").alias("pos")).agg(F.sum("x").alias("total"))


_M = "SELECT CAST(vec_id AS BIGINT) AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT)) AS v FROM embeddings"
_C = f"SELECT row AS i, CAST(unnest(range(len(v))) AS BIGINT) AS j, unnest(v) AS v FROM ({_M})"
_GRAM = f"WITH c AS MATERIALIZED ({_C}) SELECT a.j AS i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY a.j, b.j"
_MEAN = f"SELECT row, CAST(trunc(list_sum(v) / len(v)) AS BIGINT) AS mean FROM ({_M})"
_CENTRED = f"WITH z AS MATERIALIZED (SELECT c.i, c.j, c.v - m.mean AS c FROM ({_C}) c JOIN ({_MEAN}) m ON m.row = c.i)"
_COLUMNS = f"WITH c AS MATERIALIZED ({_C}), m AS (SELECT j, CAST(trunc(sum(v) / count(*)) AS BIGINT) AS mean FROM c GROUP BY j), z AS MATERIALIZED (SELECT c.i, c.j, c.v - m.mean AS x FROM c JOIN m ON m.j = c.j)"
_V = "SELECT CAST(vec_id AS BIGINT) AS id, CAST(unnest(range(len(embedding))) AS BIGINT) AS pos, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS x FROM embeddings"


def _assigned(centres: str) -> str:
    return f"SELECT id, arg_min(k, (dist, k)) AS k FROM (SELECT v.id, c.k, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM v JOIN {centres} c ON v.pos = c.pos GROUP BY v.id, c.k) GROUP BY id"


_START = f"WITH v AS ({_V}), c0 AS (SELECT f.k, v.pos, v.x FROM v JOIN (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT id FROM v) ORDER BY id LIMIT {CLUSTERS}) f ON f.id = v.id)"
_P = "SELECT CAST(l_quantity AS BIGINT) AS x, CAST(round(l_discount * 100) AS BIGINT) AS y FROM lineitem"

ORACLE_SQL = {
    "rgb_histogram": "SELECT CAST(key AS INTEGER) AS key, count(*) AS count FROM (SELECT unnest([1000 + l_partkey % 256, 2000 + l_suppkey % 256, 3000 + CAST(floor(l_extendedprice) AS BIGINT) % 256]) AS key FROM lineitem) GROUP BY 1",
    "linreg_sums": f"SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(y * y) AS BIGINT) AS syy, CAST(sum(x * y) AS BIGINT) AS sxy FROM ({_P})",
    "linreg_fit": f"SELECT round(regr_intercept(y, x), 6) AS a, round(regr_slope(y, x), 6) AS b, round(avg(x), 6) AS xbar, round(avg(y), 6) AS ybar, round(regr_r2(y, x), 6) AS r2 FROM ({_P})",
    "matmul": _GRAM,
    "matmul_blocked": _GRAM,
    "row_mean": _MEAN,
    "covariance_upper": f"{_CENTRED} SELECT a.i, b.i AS j, CAST(trunc(sum(a.c * b.c) / (SELECT count(DISTINCT i) - 1 FROM z)) AS BIGINT) AS cov FROM z a JOIN z b ON a.j = b.j AND a.i <= b.i GROUP BY a.i, b.i",
    "covariance_components": f"{_COLUMNS} SELECT a.j AS i, b.j, CAST(trunc(sum(a.x * b.x) / (SELECT count(*) - 1 FROM m)) AS BIGINT) AS cov FROM z a JOIN z b ON a.i = b.i AND a.j <= b.j GROUP BY a.j, b.j",
    "kmeans_assign": f"{_START} {_assigned('c0')}",
    "kmeans_step": f"{_START} SELECT a.k, v.pos, CAST(sum(v.x) AS BIGINT) // count(*) AS mean, count(*) AS n FROM v JOIN ({_assigned('c0')}) a ON a.id = v.id GROUP BY a.k, v.pos",
    "kmeans_grid": "SELECT CAST(j AS BIGINT) AS pos, CAST(sum((i * j) % 40 + 1) AS BIGINT) AS total FROM range(5000) a(i), range(10) b(j) GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
#: Without SQL, since the number of rounds isn't known beforehand; compared with brute force in the tests.
WITHOUT_SQL = {"kmeans_fit": kmeans_fit}
