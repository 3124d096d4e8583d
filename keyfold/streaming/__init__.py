"""The word count over a stream of files: the same expressions, online aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words


def word_count(stream: DataFrame, text: str = "text") -> DataFrame:
    """(key, count) of a streaming or a batch DataFrame; use output mode ``complete`` or ``update``."""
    return stream.select(F.explode(words(F.col(text))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("count"))
