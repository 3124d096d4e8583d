"""Sources, tokenizers, merges, sinks and the stream on rows written by hand."""

import math
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyfold import functions as K
from keyfold import operators as A
from keyfold import sources as S
from keyfold import streaming
from keyfold.apps import numeric, similar
from keyfold.plans import Job, dump, records, timed, top


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column).first()[0]


@pytest.mark.parametrize(
    "text, words, digrams",
    [
        ("", [], []),
        ("a", ["a"], []),
        ("x_1-y", ["x", "1", "y"], ["x-1", "1-y"]),
        ("naïve Straße", ["na", "ve", "Stra", "e"], ["na-ve", "ve-Stra", "Stra-e"]),
        (None, None, None),
    ],
)
def test_words_and_digrams(spark, text, words, digrams):
    assert one(spark, text, K.words(F.col("text"))) == words
    assert one(spark, text, K.digrams(K.words(F.col("text")))) == digrams


def test_delimited_words_keep_other_letters(spark):
    assert one(spark, "naïve=Straße `x`!", K.delimited_words(F.col("text"))) == ["naïve", "Straße", "x"]


def test_long_words_make_one_key(spark):
    assert one(spark, "q" * 40, K.words(F.col("text"))) == ["q" * 40]
    assert one(spark, "q" * 40, K.literal_key(F.col("text"))) == "q" * 31


def test_kmers(spark):
    assert one(spark, "A" * 24, K.kmers(F.col("text"), 25)) == []
    read = "ACGTN\n" + "ACGT" * 6
    clean = "ACGT" * 7
    assert one(spark, read, K.kmers(F.col("text"), 25)) == [clean[i : i + 25] for i in range(4)]


def test_rotations_wrap_and_hamming(spark):
    code = "0123456789abcdefghij"
    assert one(spark, code, K.rotations(F.col("text"))) == [(code * 2)[4 * i : 4 * i + 16] for i in range(5)]
    assert one(spark, code, K.hamming(F.col("text"), F.lit("x" + code[1:19] + "y"))) == 2


def test_fasta(spark, tmp_path):
    (tmp_path / "f").write_text(">read one\nACGT\nACGT\n>ACGTTT\n>two\nGGGG\n")
    assert [r.read.replace("\n", "") for r in S.fasta(spark, str(tmp_path / "f")).collect()] == ["ACGTACGT", "ACGTTT", "GGGG"]


def test_adjacency_and_codes(spark, tmp_path):
    (tmp_path / "a").write_text("n1 n2 n3\n\nn4\n")
    assert rows_of(S.adjacency(spark, str(tmp_path / "a"))) == [("n1", ["n2", "n3"]), ("n4", [])]
    (tmp_path / "c").write_text("i1 0123456789\ti2 " + "1" * 25 + "\n\ni3 abcdefghij\n")
    assert rows_of(S.codes(spark, str(tmp_path / "c"))) == [("i1", "0" * 10 + "0123456789"), ("i2", "1" * 20), ("i3", "0" * 10 + "abcdefghij")]


def test_points_are_signed_and_an_odd_byte_goes(spark, tmp_path):
    (tmp_path / "p").write_bytes(bytes([1, 255, 128, 127, 9]))
    assert rows_of(S.points(spark, str(tmp_path / "p"))) == [(-128, 127), (1, -1)]
    (tmp_path / "q").write_bytes(b"\x01")
    assert S.points(spark, str(tmp_path / "q")).count() == 0


def bitmap(bits=24, magic=b"BM"):
    head = bytearray(54)
    head[:2] = magic
    head[10:12], head[28:30] = struct.pack("<H", 54), struct.pack("<H", bits)
    return bytes(head) + bytes([1, 2, 3, 1, 255, 0, 7])


def test_bitmap_histogram(spark, tmp_path):
    (tmp_path / "b").write_bytes(bitmap())
    got = rows_of(numeric.histogram(S.bitmap(spark, str(tmp_path / "b"))))
    assert got == [(1001, 2), (2002, 1), (2255, 1), (3000, 1), (3003, 1)]


@pytest.mark.parametrize("content", [bitmap(bits=32), bitmap(magic=b"XX")])
def test_other_bitmaps_give_an_error(spark, tmp_path, content):
    (tmp_path / "b").write_bytes(content)
    with pytest.raises(PySparkException):
        S.bitmap(spark, str(tmp_path / "b")).collect()


def test_generated_words_make_whole_groups(spark):
    words = S.random_words(spark, 5000)
    assert rows_of(words) == rows_of(S.random_words(spark, 5000)) and words.where(~F.col("word").rlike("^[A-Z]{3}$")).isEmpty()
    index = words.groupBy("word").agg(A.collected(F.col("pos")).alias("p"))
    assert index.agg(F.sum(F.size("p"))).first()[0] == 5000


@pytest.mark.parametrize("seed", [0, 4_000_000_000])
def test_generated_words_follow_the_sequence(spark, seed):
    want, x = [], seed
    for i in range(300):
        word = ""
        for _ in range(3):
            x = (x * S.MULTIPLIER + S.INCREMENT) % 2**32
            word += chr(65 + x % 2**31 % 26)
        want.append((i, word))
    assert sorted(map(tuple, S.random_words(spark, 300, seed).collect())) == want


def test_generated_points_and_matrix(spark):
    assert rows_of(S.grid_points(spark, 3, 3, 2)) == [(0, [1, 1, 1]), (1, [1, 2, 1]), (2, [1, 1, 1])]
    m = S.random_matrix(spark, 4, 5, 7)
    assert all(len(v) == 5 and all(0 <= x < 7 for x in v) for _, v in m.collect())
    assert numeric.covariance(m).count() == 4 * 5 // 2


def lloyd(x, k):
    """Centres and sizes once no point changes its centre, and the rounds it took."""
    centres, held, rounds = x[:k].copy(), None, 0
    while True:
        near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        if held is not None and (near == held).all():
            return centres.tolist(), np.bincount(near, minlength=k).tolist(), rounds
        held, rounds = near, rounds + 1
        for c in range(k):
            if (near == c).any():
                s = x[near == c].sum(0)
                centres[c] = np.sign(s) * (abs(s) // (near == c).sum())


def test_kmeans_fit_converges(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect())
    x = np.array([[math.floor(v * 1000) for v in e] for _, e in rows])
    _, sizes, rounds = lloyd(x, 4)
    assert rounds > 3
    got = numeric.kmeans_fit(spark, folder).collect()
    assert [n for _, n in sorted(map(tuple, got))] == sizes


def test_kmeans_has_no_limit_of_rounds_unless_asked(spark, monkeypatch):
    monkeypatch.setattr(numeric, "step", lambda points, centres: [[min(centres[0][0] + 1, 250)]])
    points = spark.createDataFrame([(0, [0])], "id long, v array<long>")
    assert numeric.kmeans(points, 1) == [[250]]
    with pytest.warns(UserWarning, match="without having converged"):
        assert numeric.kmeans(points, 1, 100) == [[100]]
    monkeypatch.setattr(numeric, "step", lambda points, centres: [[1 - centres[0][0]]])
    with pytest.raises(ValueError, match="earlier centres"):
        numeric.kmeans(points, 1)
    assert numeric.kmeans(points.limit(0), 2) == []


def test_matrices_hold_every_row_and_component(spark):
    folder = "/root/testdata/sf0.001"
    vectors = {r.vec_id: [math.floor(x * 100) for x in r.embedding] for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    e = np.array([vectors[i] for i in sorted(vectors)])
    cut = lambda x, n: int(abs(x) // n) * (1 if x >= 0 else -1)
    g = e.T @ e
    want = sorted(((i, j, int(g[i, j])) for i in range(64) for j in range(64)), key=repr)
    assert rows_of(numeric.matmul(spark, folder)) == rows_of(numeric.matmul_blocked(spark, folder)) == want
    assert rows_of(numeric.row_mean(spark, folder)) == sorted(((i, cut(sum(v), 64)) for i, v in vectors.items()), key=repr)
    z = e - np.array([cut(x, len(e)) for x in e.sum(0)])
    c = z.T @ z
    assert rows_of(numeric.covariance_components(spark, folder)) == sorted(((i, j, cut(c[i, j], 63)) for i in range(64) for j in range(i, 64)), key=repr)


def test_column_covariance_is_covariance_of_the_transposed(spark):
    m = [(i, [(i * 7 + j * 5) % 11 - 4 for j in range(9)]) for i in range(4)]
    turned = [(j, [v[j] for _, v in m]) for j in range(9)]
    df, of = (spark.createDataFrame(x, "row long, v array<long>") for x in (m, turned))
    assert rows_of(numeric.column_covariance(of)) == rows_of(numeric.covariance(df))


def test_row_means_truncate(spark):
    df = spark.createDataFrame([(1, [-7, 0]), (2, [3, 4])], "row long, v array<long>")
    assert rows_of(numeric.means(df)) == [(1, -3), (2, 3)]


def test_products_agree(spark):
    a = numeric.cells(S.random_matrix(spark, 9, 9, 50, seed=1))
    b = numeric.cells(S.random_matrix(spark, 9, 9, 50, seed=2))
    x, y = ([[0] * 9 for _ in range(9)] for _ in range(2))
    for m, t in ((x, a), (y, b)):
        for i, j, v in t.collect():
            m[i][j] = v
    want = sorted(((i, j, sum(x[i][k] * y[k][j] for k in range(9))) for i in range(9) for j in range(9)), key=repr)
    assert rows_of(numeric.product(a, b)) == rows_of(numeric.blocked_product(a, b, 4)) == want


def test_nearest_centre_ties_and_empty_clusters(spark):
    points = spark.createDataFrame([(0, [0]), (1, [2]), (2, [1])], "id long, v array<long>")
    centres = [[0], [2], [99]]
    assert rows_of(numeric.assign(points, centres).select("id", "k")) == [(0, 0), (1, 1), (2, 0)]
    assert numeric.step(points, centres) == [[0], [2], [99]]
    assert numeric.kmeans(points, 2) == [[0], [2]]  # the tie goes to 0, whose mean is truncated


def test_least_squares_on_a_line_and_where_undefined(spark):
    df = spark.createDataFrame([(1, 3), (2, 5), (3, 7)], "x long, y long")
    got = A.least_squares(df, "x", "y").first()
    assert (got.n, got.sx, got.sy, got.sxx, got.syy, got.sxy) == (3, 6, 15, 14, 83, 34) and (got.a, got.b, got.r2) == (1.0, 2.0, 1.0)
    got = A.least_squares(df.limit(1), "x", "y").first()
    assert (got.n, got.a, got.b, got.r2) == (1, None, None, None)


def test_bounded_collection_and_nearest(spark):
    df = spark.createDataFrame([("k", i, 5 - abs(i - 7)) for i in range(12)], "k string, i int, d int")
    got = df.groupBy("k").agg(A.collected(F.col("i")).alias("all"), A.nearest("i", "d").alias("nn")).first()
    assert (got["all"], got.nn) == (list(range(12)), 0)
    assert [[m.i for m in r.members] for r in A.smallest(df, ["k"], ["i"], 10).collect()] == [list(range(10))]


def test_rank_sum_keeps_neighbours(spark):
    df = spark.createDataFrame([("a", 0.5, None), ("a", 0.25, ["b"]), ("b", 1.0, None)], "node string, rank double, to array<string>")
    rank, to = A.rank_and_neighbours("rank", "to")
    assert rows_of(df.groupBy("node").agg(rank, to)) == [("a", 0.75, ["b"]), ("b", 1.0, None)]


def test_contributions_count_repeated_links(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("c", "a")], "src string, dst string")
    got = {n: r for n, r in similar.as_number(similar.contributions(edges)).collect()}
    assert got == {"a": 1.0, "b": 0.666666, "c": 0.333333}


def test_job_top_records_and_dump(spark, tmp_path):
    text = spark.createDataFrame([("b a b c",), ("c b",)], "text string")
    job = Job(text, lambda d: d.select(F.explode(K.words(F.col("text"))).alias("key")), ["key"], {"count": A.count()}, [F.desc("count"), F.col("key")], 2)
    assert [tuple(r) for r in job.plan().collect()] == [("b", 3), ("c", 2)]
    tied = spark.createDataFrame([("z", 1), ("y", 1), ("x", 0)], "key string, count long")
    assert [r.key for r in top(tied, "count", "key", 2).collect()] == ["y", "z"]
    dump(records(job.plan(), "key", "count"), str(tmp_path / "out"), "text")
    assert rows_of(spark.read.text(str(tmp_path / "out"))) == [(" " * 14 + "b - 3",), (" " * 14 + "c - 2",)]
    assert timed(tied)["rows"] == 3


def test_stream_counts_as_the_batch_does(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text("a b a\n")
    (tmp_path / "in" / "2").write_text("b c\n\n")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    query = streaming.word_count(stream, "value").writeStream.outputMode("complete").format("memory").queryName("edge_words").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = [("a", 2), ("b", 2), ("c", 1)]
    assert rows_of(spark.table("edge_words")) == rows_of(streaming.word_count(spark.read.text(str(tmp_path / "in")), "value")) == want
