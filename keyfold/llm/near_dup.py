"""MinHash near-dedup with sequential Bayesian verification.

Signatures are banded; documents that share a band are candidates.  Within a bucket each member
is compared with the bucket's hub, the member that shares most bands with others; what that
leaves apart is compared across components only, in blocks.  A candidate's signatures are read a
batch at a time and it is dropped as soon as the posterior probability of reaching the threshold
falls below the miss probability; the texts of survivors alone are fetched, and verified on their
whole sets of shingles, word by word.

A hub is the partner of as many documents as its bucket holds: its pairs are dealt to blocks,
each with a copy of the hub, and read one after another.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import Output, all_columns, checkpoint, fewer_parts, first_rows, is_small, keep_ids, lookup, rows, texts
from .components import components

BATCH = 24
#: Members of a bucket, and their shingles, that are held at once.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
#: Partners that share a copy of their hub.
PARTNERS = 64


@dataclass(frozen=True)
class Settings:
    """Similarity to reach (percent of the union), words in a shingle, rows of a band, and the
    probability at which a pair at the threshold may share no band or be dropped unverified."""

    percent: int = 80
    words: int = 5
    band_rows: int = 5
    miss: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.band_rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.band_rows


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, A-Z lower-cased; of the whole
    text if it has fewer; none without words."""
    data = R.LOWER[np.frombuffer(text, np.uint8)]
    v = R.word_values(data, *R.word_bounds(data))
    if len(v) < words:
        return R.windows(v, len(v)) if len(v) else v
    return np.unique(R.windows(v, words))


def shingle_set(text: bytes, words: int) -> set[bytes]:
    """The same set as words themselves."""
    w = text.lower().split()  # of bytes: A-Z, and the contract's white space
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(words)))))


@functools.cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(71)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of the set under random linear maps modulo 2**32."""
    a, b = _permutations(n)
    x, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i : i + 1024, None] * a + b).min(0), out=out)
    return out


@functools.cache
def least_matches(n_hashes: int, percent: int, miss: float) -> list[tuple[int, int]]:
    """(hashes read, matches needed): below, the posterior (uniform prior) of reaching the threshold is under ``miss``."""
    s = (np.arange(20_000) + 0.5) / 20_000
    above, out = s >= percent / 100, []
    for n in [*range(BATCH, n_hashes, BATCH), n_hashes]:
        m = 0
        while m < n:
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            mass = np.exp(log - log.max())
            if mass[above].sum() / mass.sum() >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def plausible(left: np.ndarray, right: np.ndarray, cfg: Settings) -> np.ndarray:
    """Indices of the signature pairs (rows of two arrays) that no batch rules out."""
    live, hits, read = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, needed in least_matches(cfg.hashes, cfg.percent, cfg.miss):
        hits += (left[live, read:n] == right[live, read:n]).sum(1)
        keep = hits >= needed
        live, hits, read = live[keep], hits[keep], n
    return live


def linked(a: set, b: set, percent: int) -> bool:
    """Whether the intersection of two sets reaches ``percent`` of their union."""
    if not a or not b or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _features(docs: DataFrame, cfg: Settings) -> DataFrame:
    """row, doc_id, n_shingles, 128 bits of the whole set, signature, band keys."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches):
        out = Output(schema)
        salt = R.mix(np.arange(1, cfg.bands + 1, dtype=np.uint64))
        for row, doc, text in rows(batches, "row", "doc_id", "text"):
            s = shingles(text, cfg.words)
            if not len(s):
                out.add(row, doc, 0, None, None, None, None)
            else:
                sig = signature(s, cfg.hashes)
                keys = R.join(R.fold(sig.reshape(cfg.bands, cfg.band_rows)), salt)
                out.add(row, doc, len(s), int(R.mix(s).sum().astype(np.int64)), int(R.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)), sig.tobytes(), keys.view(np.int64).tolist())
            if out.full():
                yield out.take()
        yield from out.rest()

    named = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return named.mapInArrow(sign, "row long, doc_id long, n_shingles long, hi long, lo long, sig binary, bands array<long>")


PAIR = pa.schema([("hub", pa.int64()), ("doc_id", pa.int64())])


def _with_hub(pairs: DataFrame, values: DataFrame, check: Callable[[list], Callable[[bytes], bool]]) -> DataFrame:
    """Those pairs (hub, doc_id, salt) of which some value (doc_id, value) of either side passes.

    ``check`` takes the values of a hub and returns a test of a partner's.  Rows are dealt by hub
    and salt and read in order, so one hub and one partner are held at a time.
    """
    partners = pairs.join(values, "doc_id").select("hub", "salt", "doc_id", "value")
    hubs = pairs.select("hub", "salt").distinct().join(values.withColumnRenamed("doc_id", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("doc_id"), "value")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, key, passes = Output(PAIR), [], None, None
        for hub, salt, doc, value in rows(batches, "hub", "salt", "doc_id", "value"):
            if key != (hub, salt):
                key, held = (hub, salt), []
            if doc is None:
                held.append(value)
                passes = None
                continue
            if passes is None:
                passes = check(held)
            if passes(value):
                out.add(hub, doc)
                if out.full():
                    yield out.take()
        yield from out.rest()

    dealt = hubs.unionByName(partners).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc_id").asc_nulls_first())
    return dealt.mapInArrow(walk, "hub long, doc_id long")


def _verified(pairs: DataFrame, features: DataFrame, docs: DataFrame, cfg: Settings) -> DataFrame:
    """Those pairs (hub, doc_id, salt) whose sets are linked, as (a, b): signatures first, then texts."""

    def likely(hubs: list):
        left = np.frombuffer(b"".join(hubs), np.uint32).reshape(-1, cfg.hashes)
        return lambda sig: len(plausible(left, np.broadcast_to(np.frombuffer(sig, np.uint32), left.shape), cfg)) > 0

    def same(hubs: list):
        sets = [shingle_set(t, cfg.words) for t in hubs]

        def passes(text):
            other = shingle_set(text, cfg.words)
            return any(linked(s, other, cfg.percent) for s in sets)

        return passes

    left = checkpoint(_with_hub(pairs, features.select("doc_id", F.col("sig").alias("value")), likely).distinct())
    left = left.join(pairs, ["hub", "doc_id"])
    ids = checkpoint(left.select(F.explode(F.array("hub", "doc_id")).alias("doc_id")).distinct())
    whole = keep_ids(docs, ids, "semi").select("doc_id", F.col("text").alias("value"))
    return checkpoint(_with_hub(left, whole, same).distinct().select(F.col("hub").alias("a"), F.col("doc_id").alias("b")))


def _blocks(inside: DataFrame, *values: str) -> DataFrame:
    """Members (key, band, doc_id, label, most, n_shingles) dealt so that each of a bucket that isn't
    of the component of most members (asks = 1) meets each member (asks = 0) in one block."""
    asks = F.when(F.col("label") != F.col("most"), 1).otherwise(0)
    sizes = inside.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.sum(asks).alias("others"), F.sum(asks * F.col("n_shingles")).alias("t"))
    parts = lambda n, s: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK), F.ceil(F.col(s) / BLOCK_SHINGLES)).cast("int")
    inside = lookup(inside, checkpoint(sizes.select("key", parts("n", "s").alias("blocks"), parts("others", "t").alias("turns"))), "key")
    dealt, columns = F.xxhash64("doc_id", "key"), ["doc_id", "label", *values]
    own = inside.select("key", "band", F.pmod(dealt, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("asks"), *columns)
    asked = inside.where("label <> most").select("key", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(dealt, "turns").cast("int").alias("turn"), F.lit(1).alias("asks"), *columns)
    return own.unionByName(asked)


def _across(members: DataFrame, labels: DataFrame, features: DataFrame, docs: DataFrame, cfg: Settings) -> DataFrame | None:
    """Links between members of a bucket that are in no common component yet; None if no bucket has such.

    Signatures alone are compared first; texts are fetched for the documents that have a likely
    partner.  A pair is looked at in the first band it shares only, and of a member's links to one
    component one is returned, so the result stays small where many are alike.
    """
    named = checkpoint(members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    split = checkpoint(sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("most")).where("parts > 1").select("key", F.col("most.label").alias("most")))
    if split.isEmpty():
        return None

    def candidates(t: pa.Table):
        """(asking row, rows it may be linked with) of one block."""
        asks, label = t.column("asks").to_numpy(), t.column("label").to_numpy()
        band = t.column("band")[0].as_py()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, cfg.hashes)
        by_band, here = sig.reshape(len(sig), cfg.bands, cfg.band_rows), np.flatnonzero(asks == 0)
        for q in np.flatnonzero(asks == 1).tolist():
            to = here[label[here] != label[q]]
            to = to[plausible(sig[to], np.broadcast_to(sig[q], (len(to), cfg.hashes)), cfg)]
            if len(to):
                to = to[(by_band[to] == by_band[q]).all(2).argmax(1) == band]
            if len(to):
                yield q, to

    def alike(t: pa.Table) -> pa.Table:
        doc, live = t.column("doc_id").to_numpy(), set()
        for q, to in candidates(t):
            live.add(int(doc[q]))
            live.update(doc[to].tolist())
        return pa.table([pa.array(sorted(live), pa.int64())], names=["doc_id"])

    def compare(t: pa.Table) -> pa.Table:
        doc, label, text = t.column("doc_id").to_numpy(), t.column("label").to_numpy(), t.column("text")
        of = functools.cache(lambda i: shingle_set(text[i].as_py().encode(), cfg.words))
        found = []
        for q, to in candidates(t):
            done = set()
            for v in to.tolist():
                if label[v] not in done and linked(of(q), of(v), cfg.percent):
                    done.add(label[v])
                    found.append((int(doc[q]), int(doc[v])))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    inside = lookup(named, split, "key").join(features.select("doc_id", "n_shingles", "sig"), "doc_id")
    inside = checkpoint(inside)
    live = checkpoint(_blocks(inside, "sig").groupBy("key", "block", "turn").applyInArrow(alike, "doc_id long").distinct())
    if live.isEmpty():
        return None
    few = checkpoint(keep_ids(inside, live, "semi"))
    dealt = _blocks(few, "sig").join(keep_ids(docs, live, "semi"), "doc_id")
    return checkpoint(dealt.groupBy("key", "block", "turn").applyInArrow(compare, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, cfg: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked when the intersection of their sets of distinct shingles reaches
    ``cfg.percent`` of the union; component_id is the smallest doc_id reachable, kept marks that
    one.  Null, empty and blank texts have no shingles and are linked with nothing; equal sets
    are one class, searched once.  Rows that share an identifier share a component, whatever
    their texts; rows without identifier are left out.
    """
    docs = texts(docs, id_col, text_col)
    features = checkpoint(_features(docs, cfg))
    parts = features.rdd.getNumPartitions()
    classes = checkpoint(features.where("n_shingles > 0").groupBy("hi", "lo", "n_shingles").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "row")).alias("first")).where("c > 1").drop("c"))
    classed = fewer_parts(features, parts).join(F.broadcast(classes) if is_small(classes) else classes, ["hi", "lo", "n_shingles"], "left")
    narrow = checkpoint(classed.select("row", "doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("rep"), (F.coalesce("first.row", "row") == F.col("row")).alias("leads")))
    features = keep_ids(features, narrow.where("not leads").select("row"), "anti")

    rows_ = features.where("n_shingles > 0").select("doc_id", F.posexplode("bands").alias("band", "key"))
    shared = checkpoint(rows_.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    members = checkpoint(lookup(fewer_parts(rows_, parts), shared, "key"))
    score = members.groupBy("doc_id").agg(F.sum("c").alias("score"))
    hubs = checkpoint(members.join(score, "doc_id").groupBy("key").agg(F.max(F.struct("score", "doc_id"))["doc_id"].alias("hub")))
    stars = lookup(members, hubs, "key").where("doc_id <> hub").groupBy("hub", "doc_id").agg(F.max("c").alias("c"))
    stars = checkpoint(stars.select("hub", "doc_id", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / PARTNERS)).cast("int").alias("salt")))
    links = _verified(stars, features, docs, cfg)
    # Rows of one identifier belong together: their classes are linked.
    spread = narrow.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    links = checkpoint(links.unionByName(narrow.join(spread, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))))
    labels = components(links)
    more = _across(members, labels, features, docs, cfg)
    if more is not None and not more.isEmpty():
        labels = components(links.union(more))
    out = lookup(narrow, labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_duplicates(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``docs`` with one row of each component; columns as they were.

    Rows that share an identifier are one document, of which the longest text stays; texts
    without words are linked with nothing and stay; rows without identifier go.
    """
    found = near_duplicates(docs, cfg).select("doc_id", "kept")
    out = keep_ids(docs.where("doc_id is not null"), checkpoint(found.where("not kept").select("doc_id").distinct()), "anti")
    again = checkpoint(found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    return first_rows(out, again).select(*all_columns(docs))


def op1_minhash_bayes(spark, sf_dir: str) -> DataFrame:
    """Contract query: links at 85 percent."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Settings(percent=85))


def brute_force(docs: list[tuple[int, str]], percent: int, words: int = 5) -> list[tuple[int, int, int, bool]]:
    """The contract on a few documents, for tests."""
    sets = {}
    for d, t in docs:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict[tuple, list] = {}
    for d in sorted(sets):
        common: dict[int, int] = {}
        for s in sets[d]:
            for o in holders.setdefault(s, []):
                common[o] = common.get(o, 0) + 1
            holders[s].append(d)
        for o, c in common.items():
            if 100 * c >= percent * (len(sets[d]) + len(sets[o]) - c):
                a, b = sorted((root(d), root(o)))
                parent[b] = a
    return [(d, len(sets[d]), root(d), root(d) == d) for d in sorted(sets)]
