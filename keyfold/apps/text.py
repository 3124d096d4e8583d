"""Word, word-pair and k-mer counts, inverted index, string matching: over any DataFrame, and as queries of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as K
from .. import operators as A
from ..plans import Job, top
from ..sources import INCREMENT, MULTIPLIER, random_words

KEYS = ("the", "and", "que", "der")
LONG = "x" * 27
GENERATED = 4000
#: Documents, or generated words, whose places of a word stand in one row of an index.
PART = 4096


def counts(df: DataFrame, keys: Column) -> DataFrame:
    """(key, count) of an array column."""
    return Job(df, lambda x: x.select(F.explode(keys).alias("key")), ["key"], {"count": A.count()}).plan()


def count_words(df: DataFrame, text: str = "value") -> DataFrame:
    """(key, count) of the words of a text column."""
    return counts(df, K.words(F.col(text)))


def count_digrams(df: DataFrame, text: str = "value") -> DataFrame:
    """(key, count) of adjacent words ``a-b``.

    Pairs stay two columns until they are counted, so only distinct ones are joined to a string.
    """
    tokens = df.select(K.words(F.col(text)).alias("t"))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("t", F.lit(1), n).alias("a"), F.slice("t", F.lit(2), n).alias("b"))
    return tokens.select(F.inline(pairs).alias("a", "b")).groupBy("a", "b").agg(A.count().alias("count")).select(F.concat("a", F.lit("-"), "b").alias("key"), "count")


def digram_lengths(df: DataFrame, text: str = "value", most: int = 64) -> DataFrame:
    """(len, count): how many digrams have each length, of at most ``most`` characters; no digram is made for it."""
    lengths = F.transform(K.words(F.col(text)), lambda w: F.length(w))
    tokens = df.select(lengths.alias("t"))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    sums = F.zip_with(F.slice("t", F.lit(1), n), F.slice("t", F.lit(2), n), lambda a, b: a + b + 1)
    pairs = tokens.select(F.explode(sums).alias("n")).where(F.col("n") <= most).groupBy("n").agg(A.count().alias("count"))
    return pairs.select(F.col("n").cast("string").alias("len"), "count")


def count_kmers(df: DataFrame, read: str = "read", k: int = 25) -> DataFrame:
    """(key, count) of windows of ``k`` bases."""
    return counts(df, K.kmers(F.col(read), k))


def index_words(df: DataFrame, text: str = "value", id_: str = "doc_id", part: Column | None = None) -> DataFrame:
    """(word, part, p): the places (document, ordinal) of each word, in order, a bounded run of documents in a row.

    The parts of a word, one after another, are its whole list; a word of every document isn't one row.
    """
    places = df.select(F.col(id_).alias("doc_id"), F.posexplode(K.words(F.col(text))).alias("pos", "word"))
    return A.in_parts(places, ["word"], part if part is not None else F.floor(F.col("doc_id") / PART).cast("bigint"), F.struct("doc_id", "pos"), "p")


def match_strings(words: DataFrame, keys: list[str], literal: bool = False, word: str = "word") -> DataFrame:
    """(key, count): how often each key's cipher equals a word's, or with ``literal`` how often the plain key differs from it.

    Words are counted first, so each distinct one is ciphered once.
    """
    distinct = words.groupBy(F.col(word).alias("w")).agg(A.count().alias("n")).select(K.caesar(F.col("w")).alias("c"), "n")
    met = [(F.col("c") != k) if literal else (F.col("c") == K.caesar(F.lit(k))) for k in keys]
    sums = distinct.agg(*(F.sum(F.when(m, F.col("n")).otherwise(0)).alias(f"k{i}") for i, m in enumerate(met)))
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(f"k{i}", F.lit(0)).cast("long").alias("count")) for i, k in enumerate(keys)))
    return sums.select(F.explode(each).alias("r")).select("r.key", "r.count")


def _docs(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def word_count(spark, d):
    return count_words(_docs(spark, d), "text")


def word_count_top10(spark, d):
    return top(word_count(spark, d), "count", "key", 10)


def word_count_trunc31(spark, d):
    tokens = F.transform(K.words(F.col("text")), lambda w: K.literal_key(F.concat(F.lit(LONG), w)))
    return counts(_docs(spark, d), tokens)


def word_count_delims(spark, d):
    return counts(_docs(spark, d), K.delimited_words(F.col("text")))


def _tokens(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", "lang", K.words(F.col("text")).alias("t"))


def digram_count(spark, d):
    return count_digrams(_docs(spark, d), "text")


def digram_top10(spark, d):
    return top(digram_count(spark, d), "count", "key", 10)


def digram_len_hist(spark, d):
    return digram_lengths(_docs(spark, d), "text")


def max_word_len(spark, d):
    return _tokens(spark, d).select("lang", F.explode("t").alias("w")).groupBy("lang").agg(A.longest(F.length("w").cast("long")).alias("longest"))


#: Letters as bases, so that whole texts make reads.
BASES = "".join("ACGT"[i % 4] for i in range(26))
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def kmer_count(spark, d):
    """25-mers of whole texts: each letter stands for a base, other characters are none."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]+", "")
    return count_kmers(_docs(spark, d).select(F.translate(letters, LETTERS, BASES).alias("read")))


def word_index(spark, d):
    """Places of each word, as ``doc:ordinal`` in order, by runs of documents."""
    out = index_words(_docs(spark, d), "text")
    places = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x.doc_id.cast("string"), x.pos.cast("string"))), ",")
    return out.select("word", "part", places.alias("positions"), F.size("p").cast("long").alias("n"))


def word_index_counts(spark, d):
    return count_words(_docs(spark, d), "text").select(F.col("key").alias("word"), F.col("count").alias("n"))


def word_index_total(spark, d):
    return _tokens(spark, d).agg(F.sum(F.size("t")).cast("long").alias("total"))


def word_index_generated(spark, d):
    """The index of generated words."""
    out = A.in_parts(random_words(spark, GENERATED), ["word"], F.floor(F.col("pos") / PART).cast("bigint"), F.col("pos"), "p")
    return out.select("word", "part", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("positions"), F.size("p").cast("long").alias("n"))


def string_match(spark, d):
    """How often each key's cipher equals a word's."""
    return match_strings(_tokens(spark, d).select(F.explode("t").alias("word")), list(KEYS))


def string_match_literal(spark, d):
    """The inverted comparison with the plain key: how often it differs."""
    return match_strings(_tokens(spark, d).select(F.explode("t").alias("word")), list(KEYS), literal=True)


_W = "SELECT doc_id, lang, regexp_extract_all(text, '[A-Za-z0-9]+') AS t FROM documents"
_KEYS = "(VALUES " + ", ".join(f"('{k}')" for k in KEYS) + ") k(key)"
_DIGRAMS = f"SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '-' || t[i + 1])) AS g FROM ({_W})"
_WORDS = f"SELECT unnest(t) AS key FROM ({_W})"
_WORD_COUNT = f"SELECT key, count(*) AS count FROM ({_WORDS}) GROUP BY key"
_DIGRAM_COUNT = f"SELECT g AS key, count(*) AS count FROM ({_DIGRAMS}) GROUP BY g"
_PLACES = f"SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM ({_W})"
_FROM, _TO = "".join(map(chr, range(33, 122))).replace("'", "''"), "".join(map(chr, range(38, 127))).replace("'", "''")
_NEXT = lambda x: f"(({x}) * {MULTIPLIER} + {INCREMENT}) % 4294967296"
_LETTERS = " || ".join(f"chr(CAST(65 + {x} % 2147483648 % 26 AS INTEGER))" for x in "xyz")
_GENERATED = f"""WITH RECURSIVE g(pos, x, y, z) AS (
  SELECT -1, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT
  UNION ALL SELECT pos + 1, {_NEXT("z")}, {_NEXT(_NEXT("z"))}, {_NEXT(_NEXT(_NEXT("z")))} FROM g WHERE pos < {GENERATED - 1})
SELECT word, CAST(pos // {PART} AS BIGINT) AS part, string_agg(pos, ',' ORDER BY pos) AS positions, count(*) AS n FROM (SELECT pos, {_LETTERS} AS word FROM g WHERE pos >= 0) GROUP BY 1, 2"""

ORACLE_SQL = {
    "word_count": _WORD_COUNT,
    "word_count_top10": f"{_WORD_COUNT} ORDER BY count DESC, key LIMIT 10",
    "word_count_trunc31": f"SELECT substr('{LONG}' || key, 1, 31) AS key, count(*) AS count FROM ({_WORDS}) GROUP BY 1",
    "word_count_delims": r"""SELECT key, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '[^ .\-=_\t\n\r''"?,;:`!*()]+')) AS key FROM documents) GROUP BY key""",
    "digram_count": _DIGRAM_COUNT,
    "digram_top10": f"{_DIGRAM_COUNT} ORDER BY count DESC, key LIMIT 10",
    "digram_len_hist": f"SELECT CAST(length(g) AS VARCHAR) AS len, count(*) AS count FROM ({_DIGRAMS}) WHERE length(g) <= 64 GROUP BY 1",
    "max_word_len": f"SELECT lang, max(length(w)) AS longest FROM (SELECT lang, unnest(t) AS w FROM ({_W})) GROUP BY lang",
    "kmer_count": f"SELECT key, count(*) AS count FROM (SELECT unnest(list_transform(range(1, length(r) - 23), lambda i: substr(r, i, 25))) AS key FROM (SELECT translate(regexp_replace(lower(text), '[^a-z]+', '', 'g'), '{LETTERS}', '{BASES}') AS r FROM documents)) GROUP BY key",
    "word_index": f"SELECT word, doc_id // {PART} AS part, string_agg(doc_id || ':' || pos, ',' ORDER BY doc_id, pos) AS positions, count(*) AS n FROM ({_PLACES}) GROUP BY 1, 2",
    "word_index_counts": f"SELECT word, count(*) AS n FROM ({_PLACES}) GROUP BY word",
    "word_index_total": f"SELECT CAST(sum(len(t)) AS BIGINT) AS total FROM ({_W})",
    "word_index_generated": _GENERATED,
    "string_match": f"SELECT k.key, count(w.key) AS count FROM {_KEYS} LEFT JOIN ({_WORDS}) w ON translate(w.key, '{_FROM}', '{_TO}') = translate(k.key, '{_FROM}', '{_TO}') GROUP BY k.key",
    "string_match_literal": f"SELECT k.key, CAST(sum(CASE WHEN translate(w.key, '{_FROM}', '{_TO}') <> k.key THEN 1 ELSE 0 END) AS BIGINT) AS count FROM {_KEYS}, ({_WORDS}) w GROUP BY k.key",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
