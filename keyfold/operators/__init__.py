"""Merges of values under one key, by name, and the plans that iterate over them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window


def count() -> Column:
    return F.count(F.lit(1))


def total(value: str) -> Column:
    return F.sum(value)


def longest(value: str | Column) -> Column:
    return F.max(value)


def collected(value: Column) -> Column:
    """All values in order.  A key's values are one row: for keys without bound see ``in_parts``."""
    return F.array_sort(F.collect_list(value))


def smallest(df: DataFrame, keys: list[str], values: list[str], most: int, name: str = "members") -> DataFrame:
    """(keys, ``name``): the ``most`` smallest values of each key, in order (which survive doesn't depend on arrival).

    Ranked and cut before values are collected, and in part before they are shuffled, so a key
    may have any number of them.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*values))
    few = df.select(*keys, *values).withColumn("_rank", rank).where(F.col("_rank") <= most)
    return few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*values))).alias(name))


def in_parts(df: DataFrame, keys: list[str], part: Column, value: Column, name: str) -> DataFrame:
    """(keys, part, ``name``): each key's values in order, as one row for each part, so that no key is a row without bound.

    ``part`` rises with the value's order: the parts of a key, one after another, are its whole list.
    """
    return df.select(*keys, part.alias("part"), value.alias("_value")).groupBy(*keys, "part").agg(collected(F.col("_value")).alias(name))


def nearest(item: str, distance: str) -> Column:
    """The item of least distance, the smallest of equals."""
    return F.min(F.struct(distance, item))[item]


def rank_and_neighbours(rank: str, neighbours: str) -> tuple[Column, Column]:
    return F.sum(rank), F.first(neighbours, ignorenulls=True)


def vector_mean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, mean, n): element-wise mean of vectors by key, truncated toward zero."""
    long = df.select(key, F.posexplode(vector).alias("pos", "v"))
    sums = long.groupBy(key, "pos").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return sums.select(key, "pos", F.expr("s div n").alias("mean"), "n")


def least_squares(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, the five sums, intercept a, slope b, means and r2; nulls where undefined."""
    x_, y_ = F.col(x).cast("bigint"), F.col(y).cast("bigint")
    sums = df.agg(F.count("*").alias("n"), F.sum(x_).alias("sx"), F.sum(y_).alias("sy"), F.sum(x_ * x_).alias("sxx"), F.sum(y_ * y_).alias("syy"), F.sum(x_ * y_).alias("sxy"))
    d = {c: F.col(c).cast("double") for c in sums.columns}
    b = F.try_divide(d["n"] * d["sxy"] - d["sx"] * d["sy"], d["n"] * d["sxx"] - d["sx"] * d["sx"])
    top = d["n"] * d["sxy"] - d["sx"] * d["sy"]
    r2 = F.try_divide(top * top, (d["n"] * d["sxx"] - d["sx"] * d["sx"]) * (d["n"] * d["syy"] - d["sy"] * d["sy"]))
    return sums.withColumn("b", b).withColumn("a", F.try_divide(d["sy"] - F.col("b") * d["sx"], d["n"])).withColumns({"xbar": F.try_divide(d["sx"], d["n"]), "ybar": F.try_divide(d["sy"], d["n"]), "r2": r2})


#: Keys that a task merges before it hands their states on.
HELD_KEYS = 100_000


def merged(df: DataFrame, keys: list[str], create: Callable[[dict], Any], merge: Callable[[Any, Any], Any], result: Callable[[Any], dict], schema: str, held: int = HELD_KEYS) -> DataFrame:
    """Merge rows under equal keys by functions of one's own: (keys, columns of ``schema``).

    ``create`` makes a state of a row (as a dict), ``merge`` makes one of two (in any order and
    grouping), ``result`` makes the output columns of the last.  States are merged in the map
    task, pickled, shuffled by key and merged again, so a key costs a row a task however
    many rows it has.  Prefer built-in aggregates where they can express the merge.
    """
    made: StructType = _parse_datatype_string(schema)
    kept = df.select(*keys).schema
    partial_schema = StructType([*kept.fields]).add("_state", "binary")
    final_schema = StructType([*kept.fields, *made.fields])

    def partial(batches):
        states: dict[tuple, Any] = {}

        def flush():
            rows = [dict(zip(keys, k)) | {"_state": pickle.dumps(v)} for k, v in states.items()]
            states.clear()
            return pa.RecordBatch.from_pylist(rows, arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema([batch.schema.field(k) for k in keys] + [pa.field("_state", pa.binary())])
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                state = create(row)
                states[key] = merge(states[key], state) if key in states else state
                if len(states) >= held:
                    yield flush()
        if states:
            yield flush()

    def final(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, out = False, None
        for batch in batches:
            for data in batch.column("_state").to_pylist():
                state = pickle.loads(data)
                out, have = (merge(out, state) if have else state), True
        row = {k: v.as_py() for k, v in zip(keys, key)} | result(out)
        yield pa.RecordBatch.from_pylist([row], pa.schema([(f.name, _arrow(f.dataType)) for f in final_schema.fields]))

    return df.mapInArrow(partial, partial_schema).groupBy(*keys).applyInArrow(final, final_schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
