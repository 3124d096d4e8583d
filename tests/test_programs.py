"""Each program from its file or generator to its rows, the command line, job kinds, merges of one's own."""

import hashlib
import json
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import bitmap, rows_of

from keyfold import functions as K
from keyfold import operators as A
from keyfold import sources as S
from keyfold.apps import numeric, similar, text
from keyfold.plans import REGISTRY, Job, by_hash, dump, register, timed
from keyfold.programs import main

WORDS = "the cat and the dog\n\nand the bird_cat\n"


@pytest.fixture
def book(tmp_path):
    (tmp_path / "book").write_text(WORDS)
    return str(tmp_path / "book")


def words_of(line):
    return line.replace("_", " ").split()


@pytest.mark.parametrize("program", ["wc", "wcp"])
def test_word_count(spark, book, program):
    want = Counter(w for line in WORDS.splitlines() for w in words_of(line))
    assert dict(rows_of(main([program, book, "-q"], spark))) == want


def test_word_count_of_long_keys(spark, tmp_path):
    (tmp_path / "f").write_text("q" * 40 + " " + "q" * 35)
    assert rows_of(main(["wc", str(tmp_path / "f"), "-q", "-x"], spark)) == [("q" * 31, 2)]


def test_digrams_and_their_lengths(spark, book):
    pairs = Counter(f"{a}-{b}" for line in WORDS.splitlines() for a, b in zip(words_of(line), words_of(line)[1:]))
    assert dict(rows_of(main(["dg", book, "-q"], spark))) == pairs
    lengths = Counter()
    for p, n in pairs.items():
        lengths[str(len(p))] += n
    assert dict(rows_of(main(["maxlen", book, "-q"], spark))) == lengths


def test_lengths_leave_long_digrams_out(spark):
    df = spark.createDataFrame([("a" * 32 + " " + "b" * 31 + " " + "c" * 40,)], "value string")
    assert rows_of(text.digram_lengths(df)) == [("64", 1)]


def test_kmers_of_a_fasta_file(spark, tmp_path):
    reads = ["ACGT" * 8, "GGGG" * 7]
    (tmp_path / "f").write_text(f">one\n{reads[0][:20]}\n{reads[0][20:]}\n>two\n{reads[1]}\n>three\nACGT\n")
    want = Counter(r[i : i + 25] for r in reads for i in range(len(r) - 24))
    assert dict(rows_of(main(["kmer", str(tmp_path / "f"), "-q"], spark))) == want


def test_near_neighbours_of_a_file(spark, tmp_path):
    codes = {"i1": "0" * 20, "i2": "0" * 20, "i3": "1" + "0" * 19, "i4": "1" * 20, "i5": "0" * 18 + "11"}
    (tmp_path / "f").write_text("\n".join(f"{k} {v}" for k, v in codes.items()))
    keys = {k: {(v * 2)[4 * i : 4 * i + 16] for i in range(5)} for k, v in codes.items()}
    dist = lambda a, b: sum(x != y for x, y in zip(codes[a], codes[b]))
    want = {}
    for a in codes:
        near = [(dist(a, b), b) for b in codes if b != a and keys[a] & keys[b]]
        if near:
            want[a] = (min(near)[1], min(near)[0])
    for program in ("nn", "nnptr"):
        assert {r[0]: r[1:] for r in rows_of(main([program, str(tmp_path / "f"), "-q"], spark))} == want


def test_nn_holds_ten_of_a_cluster(spark, tmp_path):
    (tmp_path / "f").write_text("\n".join(f"i{i:02d} {'0' * 20}" for i in range(14)))
    assert [r[0] for r in rows_of(main(["nn", str(tmp_path / "f"), "-q"], spark))] == [f"i{i:02d}" for i in range(10)]
    assert len(rows_of(main(["nnptr", str(tmp_path / "f"), "-q"], spark))) == 14


def test_code_pairs_stand_for_classes(spark):
    codes = spark.createDataFrame([("a", "0" * 20), ("b", "0" * 20), ("c", "0" * 19 + "1")], "img string, hash string")
    one, two = "0" * 20, "0" * 19 + "1"
    assert rows_of(similar.code_pairs(codes)) == [(one, two, 1, 2, 1), (two, one, 1, 1, 2)]


def test_rank_contributions_of_a_file(spark, tmp_path):
    (tmp_path / "f").write_text("a b c\nb a\nd\n")
    assert rows_of(main(["pr", str(tmp_path / "f"), "-q"], spark)) == [("a", 1.0), ("b", 0.5), ("c", 0.5), ("d", 0.0)]


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    edges = [(f"s{i % 37}", f"d{i * 7 % 11}") for i in range(400)]
    df = spark.createDataFrame(edges, "src string, dst string").repartition(parts)
    df = df.unionAll(df.select("dst", "src"))
    ranks = {n: similar.UNIT for e in edges for n in e}
    both = edges + [(b, a) for a, b in edges]
    degree = Counter(a for a, _ in both)
    for _ in range(3):
        new = dict.fromkeys(ranks, 0)
        for a, b in both:
            new[b] += ranks[a] // degree[a]
        ranks = {n: 15 * similar.UNIT // 100 + 85 * r // 100 for n, r in new.items()}
    assert {r.node: int(r["rank"]) for r in similar.pagerank(df, 3).collect()} == ranks


def test_histogram_of_a_bitmap(spark, tmp_path):
    (tmp_path / "b").write_bytes(bitmap())
    assert rows_of(main(["hist", str(tmp_path / "b"), "-q"], spark)) == [(1001, 2), (2002, 1), (2255, 1), (3000, 1), (3003, 1)]


def test_regression_of_a_file(spark, tmp_path):
    points = [(x, 2 * x + 3 + (x % 3)) for x in range(-20, 30)]
    (tmp_path / "p").write_bytes(b"".join(struct.pack("bb", *p) for p in points))
    got = main(["linear_regression", str(tmp_path / "p"), "-q"], spark).first()
    x, y = np.array(points, float).T
    b, a = np.polyfit(x, y, 1)
    assert got.n == 50 and np.allclose([got.a, got.b, got.r2], [a, b, np.corrcoef(x, y)[0, 1] ** 2])


def test_string_match_of_a_file(spark, tmp_path):
    (tmp_path / "w").write_bytes(b"the\r\ncat\x00and\nthe\n\nqq")
    assert rows_of(main(["string_match", str(tmp_path / "w"), "-q", "-k", "the,and,none"], spark)) == [("and", 1), ("none", 0), ("the", 2)]
    assert rows_of(main(["string_match", str(tmp_path / "w"), "-q", "-x", "-k", "the"], spark)) == [("the", 5)]


def test_kmeans_of_the_grid(spark):
    from test_edges import lloyd

    x = np.array([[(i * j) % 40 + 1 for j in range(10)] for i in range(500)])
    centres, sizes, _ = lloyd(x, 4)
    assert rows_of(main(["kmeans", "10", "4", "500", "40", "-q"], spark)) == [(k, c, n) for k, (c, n) in enumerate(zip(centres, sizes))]


def test_covariance_of_a_generated_matrix_in_blocks(spark):
    rows = np.array([v for _, v in rows_of_matrix(spark, 30, 12, 50, 42)])
    mean = np.array([int(sum(v.tolist()) / 12) for v in rows])
    z = rows - mean[:, None]
    want = [(i, j, int((z[i] @ z[j]).item() / 29)) for i in range(30) for j in range(i, 30)]
    assert sorted(map(tuple, main(["pca", "-R", "30", "-C", "12", "-M", "50", "-q"], spark).collect())) == want
    assert sorted(map(tuple, numeric.covariance(S.random_matrix(spark, 30, 12, 50), 7).collect())) == want


def rows_of_matrix(spark, rows, cols, most, seed):
    return sorted(map(tuple, S.random_matrix(spark, rows, cols, most, seed).collect()))


@pytest.mark.parametrize("program", ["matrix_mult", "matrix_mult2"])
def test_product_of_generated_matrices(spark, program):
    a, b = (np.array([v for _, v in rows_of_matrix(spark, 20, 20, 30, s)]) for s in (1, 2))
    want = [(i, j, int((a @ b)[i, j])) for i in range(20) for j in range(20)]
    assert sorted(map(tuple, main([program, "-l", "20", "-M", "30", "-q"], spark).collect())) == want


def test_index_of_a_file_and_of_generated_words(spark, book):
    got = main(["wr", book, "-q"], spark).collect()
    assert sum(len(r.p) for r in got) == sum(len(words_of(x)) for x in WORDS.splitlines())
    assert [len(r.p) for r in got if r.word == "the"] == [3]
    words = 2**18
    assert main(["wrmem", "-s", "1", "-q"], spark).agg(F.sum(F.size("p"))).first()[0] == words


def test_index_in_parts_is_the_whole_list(spark):
    df = spark.createDataFrame([(i, "x y x") for i in range(10)], "doc_id long, value string")
    got = text.index_words(df, part=F.floor(F.col("doc_id") / 4)).where("word = 'x'").orderBy("part").collect()
    assert [len(r.p) for r in got] == [8, 8, 4] and [tuple(p) for r in got for p in r.p] == [(i, k) for i in range(10) for k in (0, 2)]


def test_command_line_shows_and_writes(spark, book, tmp_path, capsys):
    main(["wc", book, "-l", "2", "-m", "2", "-o", str(tmp_path / "out")], spark)
    assert capsys.readouterr().out == "\nwc: results\n" + " " * 12 + "the - 3\n" + " " * 12 + "and - 2\n"
    assert [r.key for r in spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("count"), "key").collect()] == ["the", "and", "cat", "bird", "dog"]
    main(["wc", book, "-d"], spark)
    assert json.loads(capsys.readouterr().out)["rows"] == 5
    with pytest.raises(SystemExit):
        main(["wc"], spark)
    with pytest.raises(SystemExit):
        main(["no_such_program", book], spark)


def test_registry(spark):
    assert {"wc", "wcp", "dg", "maxlen", "kmer", "nn", "nnptr", "pr", "hist", "linear_regression", "string_match", "kmeans", "pca", "matrix_mult", "matrix_mult2", "wr", "wrmem"} <= set(REGISTRY)
    with pytest.raises(ValueError, match="registered"):
        register("wc")(lambda: None)


def test_job_kinds_and_hooks(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1)], "key string, value int")
    job = Job(df, lambda d: d, ["key"], {"value": F.sum("value")}, split=lambda d: d.repartition(3), partition=by_hash(5, "key", K.djb2))
    assert rows_of(job.plan()) == [("a", 3), ("b", 1)]
    assert rows_of(Job(df, lambda d: d, ["key"], kind="group").plan()) == [("a", [1, 2]), ("b", [1])]
    assert rows_of(Job(df, lambda d: d.where("value > 1"), kind="map").plan()) == [("a", 2)]
    with pytest.raises(ValueError, match="reduces"):
        Job(df, lambda d: d, kind="sort").plan()


@pytest.mark.parametrize("key", ["", "a", "wörd", "q" * 40])
def test_djb2(spark, key):
    want = 5381
    for b in key.encode():
        want = (want * 33 + b) % 2**32
    assert spark.createDataFrame([(key,)], "k string").select(K.djb2(F.col("k"))).first()[0] == want


def test_digests_of_keys(spark):
    key = "a key ü"
    got = spark.createDataFrame([(key,)], "k string").select(F.md5(F.col("k").cast("binary")), F.sha1(F.col("k").cast("binary"))).first()
    assert tuple(got) == (hashlib.md5(key.encode()).hexdigest(), hashlib.sha1(key.encode()).hexdigest())


def test_a_merge_of_ones_own(spark):
    rows = [(f"k{i % 7}", i) for i in range(1000)] + [("hot", i) for i in range(3000)] + [(None, 5)]
    df = spark.createDataFrame(rows, "key string, value long").repartition(5)
    got = A.merged(df, ["key"], lambda r: (r["value"], r["value"], 1), lambda a, b: (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2]), lambda s: {"low": s[0], "high": s[1], "n": s[2]}, "low long, high long, n long", held=3)
    want = {}
    for k, v in rows:
        a = want.get(k, (v, v, 0))
        want[k] = (min(a[0], v), max(a[1], v), a[2] + 1)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert A.merged(df.limit(0), ["key"], dict, lambda a, b: a, dict, "n long").count() == 0


def test_sources_in_memory_and_kept(spark):
    assert rows_of(S.memory(spark, b"a b\n\nc\n", 2)) == [("a b",), ("c",)]
    kept = S.prefault(spark.range(10))
    assert kept.storageLevel.useMemory and kept.count() == 10
    kept.unpersist()


def test_sorted_dump_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([(i * 7919 % 100,) for i in range(100)], "k long")
    dump(df.select(F.col("k").cast("string").alias("value"), "k").select("value"), str(tmp_path / "o"), "text", [F.col("value").cast("long")])
    files = sorted((tmp_path / "o").glob("part-*"))
    assert [int(x) for f in files for x in f.read_text().split()] == list(range(100))
    got = timed(df.groupBy("k").count())
    assert got["rows"] == 100 and got["jobs"] >= 1 and got["tasks"] >= got["stages"] >= 1 and got["real_ms"] >= got["run_ms"]
