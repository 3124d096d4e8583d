"""Sources: text records, FASTA, adjacency lists, id and code pairs, binary points, bitmaps, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The congruential sequence of the generated words, modulo 2**32.
MULTIPLIER, INCREMENT = 1103515245, 12345


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) for each line that isn't empty."""
    return spark.read.text(path).where("value <> ''")


def memory(spark: SparkSession, text: str | bytes, parts: int = 1) -> DataFrame:
    """(value) for each line, that isn't empty, of a text held in memory; lines stay whole in ``parts`` parts."""
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    rows = [(x,) for x in text.split("\n") if x]
    return spark.createDataFrame(rows, "value string").repartition(parts) if parts > 1 else spark.createDataFrame(rows, "value string")


def word_lines(spark: SparkSession, path: str, most: int = 1023) -> DataFrame:
    """(word) for each line that isn't empty; a line ends at LF, CR LF or NUL, and keeps ``most`` characters."""
    parts = F.split("value", "[\r\\x00]")
    return spark.read.option("lineSep", "\n").text(path).select(F.explode(parts).alias("w")).where("w <> ''").select(F.substring("w", 1, most).alias("word"))


def prefault(df: DataFrame) -> DataFrame:
    """``df`` read whole and kept, in memory as far as it holds, so that jobs after it don't wait for the source."""
    from pyspark import StorageLevel

    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read) for each record; a first line that isn't four bases is a header and goes."""
    record = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    header = ~F.substring("value", 1, 4).rlike("^[ACGT]{4}$")
    return record.select(F.when(header, F.regexp_replace("value", r"^[^\n]*\n?", "")).otherwise(F.col("value")).alias("read"))


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst array) of lines ``src dst1 dst2 ...``."""
    parts = F.split(F.trim("value"), " +")
    return lines(spark, path).select(F.element_at(parts, 1).alias("src"), F.slice(parts, F.lit(2), F.size(parts)).alias("dst"))


def codes(spark: SparkSession, path: str) -> DataFrame:
    """(img, hash) of white-space-separated pairs; hashes padded with 0 on the left to 20, or cut."""
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), lambda i: F.struct(F.get(parts, 2 * i).alias("img"), F.lpad(F.get(parts, 2 * i + 1), 20, "0").alias("hash"))))
    return lines(spark, path).where(F.size(parts) >= 2).select(pair.alias("p")).select("p.img", "p.hash")


def _bytes(path_df: DataFrame, width: int, start) -> DataFrame:
    """Records of ``width`` bytes as hex, exploded; an incomplete one at the end goes."""
    n = F.floor((F.octet_length("content") - start) / width).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    return path_df.select("content", start.alias("start"), at.alias("i")).select(F.hex(F.substring("content", F.col("start") + 1 + F.col("i") * width, F.lit(width))).alias("h"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y) of files of two signed bytes a point."""
    df = _bytes(spark.read.format("binaryFile").load(path), 2, F.lit(0))
    signed = lambda at: F.expr(f"(conv(substring(h, {at}, 2), 16, 10) + 128) % 256 - 128").cast("int")
    return df.select(signed(1).alias("x"), signed(3).alias("y"))


def bitmap(spark: SparkSession, path: str) -> DataFrame:
    """(b, g, r) of 24-bit bitmaps; files of another kind give an error."""
    byte = lambda at: f"cast(conv(hex(substring(content, {at + 1}, 1)), 16, 10) as int)"
    files = spark.read.format("binaryFile").load(path)
    good = F.expr(f"substring(content, 1, 2) = X'424D' and {byte(28)} = 24 and {byte(29)} = 0")
    files = files.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no 24-bit bitmap: "), F.col("path"))).cast("boolean")))
    df = _bytes(files, 3, F.expr(f"{byte(10)} + 256 * {byte(11)}"))
    return df.select(*(F.conv(F.substring("h", 1 + 2 * i, 2), 16, 10).cast("int").alias(c) for i, c in enumerate("bgr")))


def grid_points(spark: SparkSession, n: int, dim: int, grid: int) -> DataFrame:
    """(id, v): the generated points of the clustering program, (i * j) % grid + 1."""
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (F.col("id") * j) % grid + 1).alias("v"))


def random_words(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(pos, word): words of three capitals, drawn one after another from a congruential sequence.

    Each row jumps to its own place in the sequence by squared steps, so any part is made anywhere.
    """
    jumps, a, c = [], MULTIPLIER, INCREMENT
    for bit in range(32):  # the sequence repeats after 2**32
        jumps.append(F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in (("bit", 1 << bit), ("low", a & 0xFFFF), ("high", a >> 16), ("add", c)))))
        a, c = a * a % 2**32, (a * c + c) % 2**32

    def jump(x, j, steps):
        # in halves, as a product of two 32-bit numbers is more than a long holds
        moved = x * j["low"] + (x * j["high"]).bitwiseAND(F.lit(0xFFFF)) * 65536 + j["add"]
        return F.when(steps.bitwiseAND(j["bit"]) != 0, moved.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(x)

    def letter(k):
        steps = F.col("id") * 3 + k
        x = F.aggregate(F.array(*jumps), F.lit(seed).cast("bigint"), lambda x, j: jump(x, j, steps))
        return F.char(x.bitwiseAND(F.lit(0x7FFFFFFF)) % 26 + 65)

    return spark.range(n).select(F.col("id").alias("pos"), F.concat(letter(1), letter(2), letter(3)).alias("word"))


def random_matrix(spark: SparkSession, rows: int, cols: int, grid: int, seed: int = 42) -> DataFrame:
    """(row, v): integers in [0, grid)."""
    return spark.range(rows).select(F.col("id").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: F.pmod(F.xxhash64("id", j, F.lit(seed)), F.lit(grid))).alias("v"))
