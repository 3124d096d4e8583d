"""The programs by name, each from its file or generator to its rows.

A program is a function of (spark, args) in ``plans.REGISTRY``; ``main`` is the command line:

    python -m keyfold wc FILE -l 10 -o OUT

    -p N  processors of a local session         -l N  rows shown (5; maxlen 50; 0: none)
    -m N  parts the input is dealt to           -q    show nothing
    -t N  parts of the keyed rows               -o F  write all rows to folder F
    -x    keys as records of 31 characters      -d    time the program, without its rows
    -k W  words to match, comma-separated       -s N  size (wrmem: MB; matrix_mult: -l is the side)
    -R -C -M  rows, columns, greatest value (pca)

kmeans takes <dimension> <clusters> <points> <greatest value>.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as K
from . import operators as A
from . import sources as S
from .apps import numeric, similar, text
from .plans import REGISTRY, Job, dump, records, register, timed, top

#: (key, value) columns by which a program's rows are shown, greatest value first; others are shown by key.
SHOWN = {"wc": ("key", "count"), "wcp": ("key", "count"), "dg": ("key", "count"), "maxlen": ("len", "count"), "kmer": ("key", "count"), "pr": ("node", "rank")}


def _lines(spark: SparkSession, args) -> DataFrame:
    df = S.lines(spark, args.input[0])
    return df.repartition(args.m) if args.m else df


@register("wc")
def wc(spark: SparkSession, args) -> DataFrame:
    """Word counts of text files."""
    if args.x:
        return text.counts(_lines(spark, args), F.transform(K.words(F.col("value")), lambda w: K.literal_key(w)))
    return text.count_words(_lines(spark, args))


@register("wcp")
def wcp(spark: SparkSession, args) -> DataFrame:
    """The same; how states are serialised is the engine's matter."""
    return wc(spark, args)


@register("dg")
def dg(spark: SparkSession, args) -> DataFrame:
    """Counts of adjacent words of a line."""
    return text.count_digrams(_lines(spark, args))


@register("maxlen")
def maxlen(spark: SparkSession, args) -> DataFrame:
    """How many digrams have each length."""
    return text.digram_lengths(_lines(spark, args))


@register("kmer")
def kmer(spark: SparkSession, args) -> DataFrame:
    """25-mers of FASTA files."""
    return text.count_kmers(S.fasta(spark, args.input[0]))


@register("nn")
def nn(spark: SparkSession, args) -> DataFrame:
    """The nearest other image, among the ten smallest of each cluster, of a file of image and hash pairs."""
    members = similar.clusters(S.codes(spark, args.input[0])).select("ck", F.explode("members").alias("m")).select("ck", "m.img", "m.hash")
    other = members.select("ck", F.col("img").alias("nn"), F.col("hash").alias("other"))
    pairs = members.join(other, "ck").where("img <> nn").select("img", "nn", K.hamming(F.col("hash"), F.col("other")).alias("dist"))
    return pairs.groupBy("img").agg(A.nearest("nn", "dist").alias("nn"), F.min("dist").alias("dist"))


@register("nnptr")
def nnptr(spark: SparkSession, args) -> DataFrame:
    """The same among all members of each cluster."""
    return similar.nearest(S.codes(spark, args.input[0]))


@register("pr")
def pr(spark: SparkSession, args) -> DataFrame:
    """One step of rank contributions of an adjacency list."""
    edges = S.adjacency(spark, args.input[0]).select("src", F.explode_outer("dst").alias("dst"))
    alone = edges.where("dst is null").select(F.col("src").alias("node"), F.lit(0.0).alias("rank"))
    ranks = similar.as_number(similar.contributions(edges.where("dst is not null")))
    return ranks.unionByName(alone).groupBy("node").agg(F.sum("rank").alias("rank"))


@register("hist")
def hist(spark: SparkSession, args) -> DataFrame:
    """The histogram of the channels of 24-bit bitmaps."""
    return numeric.histogram(S.bitmap(spark, args.input[0]))


@register("linear_regression")
def linear_regression(spark: SparkSession, args) -> DataFrame:
    """Least squares over files of two signed bytes a point."""
    return A.least_squares(S.points(spark, args.input[0]), "x", "y")


@register("string_match")
def string_match(spark: SparkSession, args) -> DataFrame:
    """How often the keys occur in a word list, compared by their ciphers; -x: the inverted comparison."""
    return text.match_strings(S.word_lines(spark, args.input[0]), args.k.split(","), literal=args.x)


@register("kmeans")
def kmeans(spark: SparkSession, args) -> DataFrame:
    """(k, mean, n): centres and sizes of the generated grid's clusters."""
    dim, k, n, greatest = map(int, args.input)
    points = S.grid_points(spark, n, dim, greatest)
    centres = numeric.kmeans(points, k)
    sizes = numeric.assign(points, centres).groupBy("k").agg(A.count().alias("n"))
    means = spark.createDataFrame(list(enumerate(centres)), "k long, mean array<long>")
    return means.join(sizes, "k", "left").select("k", "mean", F.coalesce("n", F.lit(0)).alias("n"))


@register("pca")
def pca(spark: SparkSession, args) -> DataFrame:
    """(i, j, cov) of the rows of a generated matrix."""
    return numeric.covariance(S.random_matrix(spark, args.R, args.C, args.M))


@register("matrix_mult")
def matrix_mult(spark: SparkSession, args) -> DataFrame:
    """(i, j, v): the product of two generated square matrices, in blocks."""
    a, b = (numeric.cells(S.random_matrix(spark, args.l, args.l, args.M, seed)) for seed in (1, 2))
    return numeric.blocked_product(a, b, 32)


@register("matrix_mult2")
def matrix_mult2(spark: SparkSession, args) -> DataFrame:
    """The same by a join of cells."""
    a, b = (numeric.cells(S.random_matrix(spark, args.l, args.l, args.M, seed)) for seed in (1, 2))
    return numeric.product(a, b)


@register("wr")
def wr(spark: SparkSession, args) -> DataFrame:
    """(word, part, p): the places of each word; a document is a line, numbered in order of the file's parts."""
    return text.index_words(_lines(spark, args).select(F.monotonically_increasing_id().alias("doc_id"), "value"))


@register("wrmem")
def wrmem(spark: SparkSession, args) -> DataFrame:
    """(word, part, p): the same over generated words, four bytes each."""
    words = S.random_words(spark, args.s * (1 << 20) // 4)
    return A.in_parts(words, ["word"], F.floor(F.col("pos") / (1 << 20)).cast("bigint"), F.col("pos"), "p")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyfold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("program", choices=sorted(REGISTRY))
    p.add_argument("input", nargs="*")
    for flag, default in (("-p", 0), ("-m", 0), ("-t", 0), ("-l", None), ("-s", 1), ("-R", 100), ("-C", 100), ("-M", 1000)):
        p.add_argument(flag, type=int, default=default)
    p.add_argument("-k", default=",".join(text.KEYS))
    for flag in ("-q", "-x", "-d"):
        p.add_argument(flag, action="store_true")
    p.add_argument("-o")
    return p


#: Programs without an input file.
GENERATED = {"kmeans": 4, "pca": 0, "matrix_mult": 0, "matrix_mult2": 0, "wrmem": 0}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Run a program; returns its rows."""
    p = parser()
    args = p.parse_args(argv)
    if len(args.input) != GENERATED.get(args.program, 1):
        p.error(f"{args.program} takes {GENERATED.get(args.program, 1)} arguments")
    shown = args.l if args.l is not None else 50 if args.program == "maxlen" else 5
    if args.program.startswith("matrix_mult"):
        shown, args.l = 5, args.l or 100
    if spark is None:
        spark = SparkSession.builder.master(f"local[{args.p or '*'}]").config("spark.ui.enabled", "false").getOrCreate()
    if args.t:
        spark.conf.set("spark.sql.shuffle.partitions", args.t)
    out = REGISTRY[args.program](spark, args)
    if args.d:
        print(json.dumps(timed(out)))
        return out
    if not args.q and shown:
        print(f"\n{args.program}: results")
        if args.program in SHOWN:
            key, value = SHOWN[args.program]
            for r in records(top(out, value, key, shown), key, value).collect():
                print(r.value)
        else:
            for r in out.orderBy(*out.columns[: 2 if args.program != "linear_regression" else 1]).limit(shown).collect():
                print(*r)
    if args.o:
        dump(out, args.o, order=[F.desc(SHOWN[args.program][1]), F.col(SHOWN[args.program][0])] if args.program in SHOWN else None)
    return out


__all__ = ["REGISTRY", "Job", "main", "parser"]

if __name__ == "__main__":
    main(sys.argv[1:])
