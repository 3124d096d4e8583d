"""A job is a source, a map to keyed rows, merges and an order; its plan is one lazy DataFrame."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import collected


@dataclass
class Job:
    """``split`` re-deals the source, ``map`` makes keyed rows of it, ``partition`` deals those, and by ``kind``

    * ``reduce``: ``aggs`` merge the values under equal ``keys``,
    * ``group``: the values of the column ``values`` under equal keys become one list, in order,
    * ``map``: the rows of ``map`` are the result.

    ``order`` and ``limit`` (top rows) are optional.  The physical plan is Catalyst's choice.
    """

    source: DataFrame
    map: Callable[[DataFrame], DataFrame]
    keys: list[str] = field(default_factory=list)
    aggs: dict[str, Column] = field(default_factory=dict)
    order: list[Column] = field(default_factory=list)
    limit: int | None = None
    kind: str = "reduce"
    values: str = "value"
    split: Callable[[DataFrame], DataFrame] | None = None
    partition: Callable[[DataFrame], DataFrame] | None = None

    def plan(self) -> DataFrame:
        out = self.map(self.split(self.source) if self.split else self.source)
        out = self.partition(out) if self.partition else out
        if self.kind == "reduce":
            out = out.groupBy(*self.keys).agg(*(c.alias(n) for n, c in self.aggs.items()))
        elif self.kind == "group":
            out = out.groupBy(*self.keys).agg(collected(F.col(self.values)).alias(self.values))
        elif self.kind != "map":
            raise ValueError(f"a job reduces, groups or maps, and doesn't {self.kind}")
        out = out.orderBy(*self.order) if self.order else out
        return out.limit(self.limit) if self.limit else out


def by_hash(n: int, key: str, hash_: Callable[[Column], Column] = F.xxhash64) -> Callable[[DataFrame], DataFrame]:
    """A partitioner: rows dealt to ``n`` parts by a hash of their key."""
    return lambda df: df.repartition(n, F.pmod(hash_(F.col(key)), F.lit(n)))


def top(df: DataFrame, value: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` rows of greatest value, smaller keys first among equals."""
    return df.orderBy(F.desc(value), key).limit(n)


def records(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value): result lines, the key right-aligned in fifteen columns."""
    return df.select(F.concat(F.lpad(F.col(key).cast("string"), F.greatest(F.lit(15), F.length(F.col(key).cast("string"))), F.lit(" ")), F.lit(" - "), F.col(value).cast("string")).alias("value"))


def dump(df: DataFrame, path: str, kind: str = "parquet", order: list | None = None) -> None:
    """Write results; ``text`` takes one string column.  With ``order``, files and the rows in them follow it."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").format(kind).save(path)


def timed(df: DataFrame) -> dict[str, float]:
    """Run a plan without keeping it: rows, milliseconds of planning, running and both, and its jobs, stages and tasks."""
    spark, group = df.sparkSession, f"timed-{uuid.uuid4().hex}"
    sc, start = spark.sparkContext, time.perf_counter()
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    sc.setJobGroup(group, "timed")
    try:
        rows = df.count()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    done, status = time.perf_counter(), sc.statusTracker()
    jobs = [j for j in (status.getJobInfo(i) for i in status.getJobIdsForGroup(group)) if j]
    stages = [x for x in (status.getStageInfo(i) for i in {i for j in jobs for i in j.stageIds}) if x]
    return {
        "rows": rows,
        "seconds": done - start,
        "plan_ms": 1000 * (planned - start),
        "run_ms": 1000 * (done - planned),
        "real_ms": 1000 * (done - start),
        "jobs": len(jobs),
        "stages": len(stages),
        "tasks": sum(x.numTasks for x in stages),
    }


#: Jobs by name, for callers that choose one at run time.
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Enter a function under a name in ``REGISTRY``."""

    def enter(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if REGISTRY.setdefault(name, f) is not f:
            raise ValueError(f"{name} is registered already")
        return f

    return enter
