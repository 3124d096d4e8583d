"""Near neighbours over banded codes, and rank contributions over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as K
from .. import operators as A

CAP = 10
#: Identifiers of a cluster that stand in one row.
PART = 4096


def codes(spark, d) -> DataFrame:
    """(img, hash): a 20-character sign code of each embedding."""
    signs = F.transform(F.slice("embedding", 1, 20), lambda x: F.when(x > 0, "1").otherwise("0"))
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("img"), F.lpad(F.array_join(signs, ""), 20, "0").alias("hash"))


def banded(codes: DataFrame) -> DataFrame:
    """(img, hash, ck): each code under its rotations, five if they differ."""
    return codes.select("img", "hash", F.explode(F.array_distinct(K.rotations(F.col("hash")))).alias("ck"))


def clusters(codes: DataFrame, most: int = CAP) -> DataFrame:
    """(ck, members): the ``most`` smallest members of each cluster."""
    return A.smallest(banded(codes), ["ck"], ["img", "hash"], most)


def all_clusters(codes: DataFrame, part) -> DataFrame:
    """(ck, part, members): every member of each cluster, in parts, so that a cluster isn't one row without bound."""
    return A.in_parts(banded(codes), ["ck"], part, F.struct("img", "hash"), "members")


def code_pairs(codes: DataFrame) -> DataFrame:
    """(hash, other, dist, n, m): ordered pairs of different codes of a cluster, with their images' numbers.

    Images of one code are at distance 0 and are a class, their number and members in ``codes``;
    a cluster's codes differ in four places only, so they are few however many images it has.
    """
    classes = codes.groupBy("hash").agg(F.count("*").alias("n"))
    a = classes.select("hash", "n", F.explode(F.array_distinct(K.rotations(F.col("hash")))).alias("ck"))
    b = a.select(F.col("hash").alias("other"), F.col("n").alias("m"), "ck")
    pairs = a.join(b, "ck").where("hash <> other").select("hash", "other", "n", "m").distinct()
    return pairs.select("hash", "other", K.hamming(F.col("hash"), F.col("other")).alias("dist"), "n", "m")


def nearest(codes: DataFrame) -> DataFrame:
    """(img, nn, dist): the nearest other member of an image's clusters, the smallest of equals; none for an image alone.

    Found for codes, of which each stands for its two smallest images.
    """
    two = A.smallest(codes, ["hash"], ["img"], 2).select("hash", F.get("members", F.lit(0))["img"].alias("first"), F.get("members", F.lit(1))["img"].alias("second"))
    a = two.select("hash", F.explode(F.array_distinct(K.rotations(F.col("hash")))).alias("ck"))
    b = two.select(F.col("hash").alias("other"), F.col("first").alias("nn"), F.explode(F.array_distinct(K.rotations(F.col("hash")))).alias("ck"))
    pairs = a.join(b, "ck").where("hash <> other").select("hash", "nn", K.hamming(F.col("hash"), F.col("other")).alias("dist"))
    best = pairs.groupBy("hash").agg(F.min(F.struct("dist", "nn")).alias("best"))
    of = codes.join(two, "hash").join(best, "hash", "left")
    same = F.when(F.col("second").isNull(), None).when(F.col("img") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    out = of.select("img", F.coalesce(same, F.col("best.nn")).alias("nn"), F.when(same.isNotNull(), F.lit(0).cast("bigint")).otherwise(F.col("best.dist")).alias("dist"))
    return out.where("nn is not null")


def nn_clusters(spark, d):
    """At most ten members of each cluster, the smallest ids."""
    return clusters(codes(spark, d)).select("ck", F.array_join(F.transform("members", lambda m: m.img), ",").alias("members"))


def nn_clusters_all(spark, d):
    """Every member of each cluster, by parts of the identifiers."""
    part = F.col("img").cast("bigint")
    return all_clusters(codes(spark, d), F.floor(part / PART).cast("bigint")).select("ck", "part", F.array_join(F.transform("members", lambda m: m.img), ",").alias("members"))


def nn_pairs(spark, d):
    return code_pairs(codes(spark, d))


def nn_nearest(spark, d):
    return nearest(codes(spark, d))


def nn_min_dist(spark, d):
    """The least distance alone."""
    return nearest(codes(spark, d)).select("img", "dist")


def links(spark, d) -> DataFrame:
    """(src, dst) of the orders' lines."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


#: Ranks are whole numbers of this part of one: their sums don't depend on the order of rows.
UNIT = 10**12


def contributions(edges: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(node, rank): each source (src) hands its rank (one without ``ranks``) on to its dst in equal parts; sources appear with 0.

    Ranks are decimals in units of 1 / UNIT, parts are rounded down to one; exact, so any
    partitioning and any repeated run gives the same.  A part may be at most nine million.
    """
    degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    whole = F.lit(UNIT).cast("decimal(38,0)")
    given = degree.join(ranks.withColumnRenamed("node", "src"), "src") if ranks else degree.withColumn("rank", whole)
    given = given.select("src", F.expr("rank div deg").alias("part"))
    out = edges.join(given, "src").select(F.col("dst").alias("node"), F.col("part").alias("rank")).unionAll(degree.select("src", F.lit(0).cast("bigint")))
    return out.groupBy("node").agg(F.sum(F.col("rank").cast("decimal(19,0)")).cast("decimal(38,0)").alias("rank"))


def as_number(ranks: DataFrame, digits: int = 6) -> DataFrame:
    """Ranks as doubles, rounded down to ``digits`` places."""
    return ranks.select("node", (F.expr(f"rank div {UNIT // 10**digits}").cast("double") / F.lit(float(10**digits))).alias("rank"))


def pagerank(edges: DataFrame, rounds: int, damping: int = 85) -> DataFrame:
    """(node, rank) after ``rounds`` steps, damped by ``damping`` percent; an extension of the single step."""
    ranks = None
    for _ in range(rounds):
        moved = F.expr(f"({(100 - damping) * (UNIT // 100)} + ({damping} * rank) div 100)").cast("decimal(38,0)")
        ranks = contributions(edges, ranks).select("node", moved.alias("rank"))
    return ranks


def pagerank_step(spark, d):
    return as_number(contributions(links(spark, d)))


def pagerank_iter(spark, d):
    """Two steps over links in both directions, damped by 0.85."""
    one = links(spark, d)
    return as_number(pagerank(one.unionAll(one.select("dst", "src")), 2))


_B = "SELECT DISTINCT img, hash, substr(hash || hash, 1 + 4 * r, 16) AS ck FROM (SELECT CAST(vec_id AS VARCHAR) AS img, array_to_string(list_transform(embedding[1:20], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS hash FROM embeddings), range(5) t(r)"
_P = f"SELECT DISTINCT a.img, b.img AS nn, a.hash, b.hash AS other, CAST(hamming(a.hash, b.hash) AS BIGINT) AS dist FROM ({_B}) a JOIN ({_B}) b ON a.ck = b.ck AND a.img <> b.img"
_E = "SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem"


def _step(edges: str, ranks: str) -> str:
    return f"""SELECT node, sum(rank) AS rank FROM (
      SELECT e.dst AS node, r.rank // g.deg AS rank FROM {edges} e JOIN (SELECT src, count(*) AS deg FROM {edges} GROUP BY src) g ON e.src = g.src JOIN {ranks} r ON r.node = e.src
      UNION ALL SELECT DISTINCT src, 0::HUGEINT FROM {edges}) GROUP BY node"""


_MOVED = f"{15 * UNIT // 100} + (85 * rank) // 100"
_NUMBER = f"CAST(rank // {UNIT // 10**6} AS DOUBLE) / 1000000.0::DOUBLE AS rank"
ORACLE_SQL = {
    "nn_clusters": f"SELECT ck, array_to_string(list_sort(list(img))[1:{CAP}], ',') AS members FROM ({_B}) GROUP BY ck",
    "nn_clusters_all": f"SELECT ck, CAST(img AS BIGINT) // {PART} AS part, string_agg(img, ',' ORDER BY img) AS members FROM ({_B}) GROUP BY ALL",
    "nn_pairs": f"SELECT hash, other, dist, count(DISTINCT img) AS n, count(DISTINCT nn) AS m FROM ({_P}) WHERE hash <> other GROUP BY ALL",
    "nn_nearest": f"SELECT img, arg_min(nn, (dist, nn)) AS nn, min(dist) AS dist FROM ({_P}) GROUP BY img",
    "nn_min_dist": f"SELECT img, min(dist) AS dist FROM ({_P}) GROUP BY img",
    "pagerank_step": f"WITH e AS ({_E}), o AS (SELECT DISTINCT src AS node, {UNIT}::HUGEINT AS rank FROM e) SELECT node, {_NUMBER} FROM ({_step('e', 'o')})",
    "pagerank_iter": f"""WITH l AS ({_E}), e AS (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l),
      o AS (SELECT DISTINCT src AS node, {UNIT}::HUGEINT AS rank FROM e), a AS (SELECT node, {_MOVED} AS rank FROM ({_step('e', 'o')})),
      b AS (SELECT node, {_MOVED} AS rank FROM ({_step('e', 'a')})) SELECT node, {_NUMBER} FROM b""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
