"""Byte-level substring dedup through blockwise suffix arrays.

A suffix array of a whole corpus fits nowhere, and most suffixes have no partner.  Winnowed byte
grams find the windows that may have one; each window goes, with the text around it, to the
bucket of the gram it chose, so equal windows meet.  A bucket's text is sorted by suffix, block by
block, long ties resolved by the ranks of a difference-cover sample (``suffix_sort``).

The bucket of a gram with very many places is split by where the gram lies in a window and by the
bytes that all windows of such a part share; a part that still has very many is split once
more, by the whole window.  Every part is sorted like any other bucket.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import Output, attach, buckets_for, checkpoint, intervals, is_small, keep_ids, partitions_for, rows, text_bytes
from .repeats import DOCUMENT, as_runs, hot_keys, is_in, named_texts, recurring_anchors, settle_pieces, unpack
from .suffix_sort import repeated

BUCKET_BYTES = 6 << 20
#: A gram with more places than this is hot: its pieces alone could fill half a bucket.
HOT = 8192
#: Places of the gram in a window that go together when a hot gram is split; a multiple of eight.
STEP = 24


def segments(text: bytes, runs, length: int, gram: int, often: np.ndarray, still: np.ndarray):
    """(key, level, start of the first window, windows, place of the gram) for the windows whose gram recurs.

    Level 0: windows that chose one gram; 1: a part of those of a hot gram, keyed by the
    bytes that they share; 2: one window of a part that is hot as well, keyed by itself.
    """
    data, w = np.frombuffer(text, np.uint8), length - gram + 1
    flag = np.zeros(len(data) + 1, bool)
    flag[unpack(runs)] = True
    for a, z in R.blocks(len(data), length):
        if not flag[a:z].any():
            continue
        grams = R.byte_grams(data[a:z], gram)
        at = R.window_places(grams, w)
        starts = np.flatnonzero(flag[a + at])
        if not len(starts):
            continue
        chosen, level = at[starts], np.zeros(len(starts), np.int64)
        keys, part = grams[chosen], (chosen - starts) // STEP
        hot = is_in(keys, often)
        if hot.any():
            level[hot] = 1
            shared = R.byte_grams(data[a:z], length - STEP)
            keys = keys.copy()
            keys[hot] = R.join(shared[chosen[hot] - part[hot] * STEP], part[hot].astype(np.uint64))
            more = hot & is_in(keys, still)
            if more.any():
                level[more] = 2
                keys[more] = R.byte_grams(data[a:z], length)[starts[more]]
        new = (np.diff(chosen) != 0) | (np.diff(starts) != 1) | (np.diff(level) != 0) | ((level[1:] > 0) & (np.diff(part) != 0)) | (level[1:] == 2)
        cut = np.append(0, np.flatnonzero(new) + 1)
        many = np.diff(np.append(cut, len(starts)))
        yield from zip(keys[cut].tolist(), level[cut].tolist(), (a + starts[cut]).tolist(), many.tolist(), (a + chosen[cut]).tolist())


def compare(pieces: list[tuple], length: int) -> list[tuple]:
    """Runs of windows of distinct pieces that recur among them, as arrays (doc, var, start, count); a
    piece known to recur whole is searched for the others alone."""
    if not pieces:
        return []
    sizes = np.array([len(p[-1]) for p in pieces])
    begin, counts = np.cumsum(sizes) - sizes, sizes - length + 1
    ends = np.cumsum(counts)
    inside = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    hit = repeated(np.frombuffer(b"".join(p[-1] for p in pieces), np.uint8), np.repeat(begin, counts) + inside, length)
    hit &= np.repeat(np.array([not p[6] for p in pieces]), counts)
    doc, var, lo = (np.repeat(np.array([p[i] for p in pieces], np.int64), counts)[hit] for i in (1, 2, 3))
    return [as_runs(doc, var, lo + inside[hit])]


def repeated_windows(docs: DataFrame, length: int = 200, gram: int = 32, hot: int = HOT) -> DataFrame:
    """(doc_id, var, data): packed starts of the windows of ``length`` bytes that also start elsewhere."""
    spark, w, total = docs.sparkSession, length - gram + 1, text_bytes(docs)

    def anchors(batches):
        for doc, var, text in rows(batches, *DOCUMENT, "text"):
            data, found, hashes = np.frombuffer(text, np.uint8), [], []
            for a, z in R.blocks(len(data), length):
                g = R.byte_grams(data[a:z], gram)
                at = R.chosen_places(g, w)
                found.append(at + a)
                hashes.append(g[at])
            if found:
                at, first = np.unique(np.concatenate(found), return_index=True)
                yield doc, var, np.concatenate(hashes)[first], at

    recurring, often = recurring_anchors(docs, anchors, buckets_for(spark, total), hot, 2 * total // w)
    with_anchors = attach(docs, recurring, DOCUMENT)[0].select(*DOCUMENT, "text", "data")
    listed, still = spark.sparkContext.broadcast(often), np.zeros(0, np.uint64)

    def parts(batches):
        """How often each part of a hot gram's bucket is met."""
        out, held = Output(pa.schema([("key", pa.int64()), ("n", pa.int64())])), Counter()

        def flush():
            for key, n in held.items():
                out.add(key - (1 << 64) if key >> 63 else key, n)
                if out.full():
                    yield out.take()
            held.clear()

        for text, runs in rows(batches, "text", "data"):
            held.update(key for key, level, *_ in segments(text, runs, length, gram, listed.value, np.zeros(0, np.uint64)) if level)
            if len(held) > 1 << 18:
                yield from flush()
        yield from flush()
        yield from out.rest()

    if len(often):
        still = hot_keys(with_anchors.select("text", "data").mapInArrow(parts, "key long, n long"), hot)
    listed_too = spark.sparkContext.broadcast(still)

    def pieces(batches):
        for doc, var, text, runs in rows(batches, *DOCUMENT, "text", "data"):
            for key, _, start, many, at in segments(text, runs, length, gram, listed.value, listed_too.value):
                yield key, doc, var, start, at - start, many, 0, text[start : start + many + length - 1]

    places = (recurring.select(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0) // 8
    return settle_pieces(with_anchors, pieces, lambda p: compare(p, length), partitions_for(places * (length + w // 2), BUCKET_BYTES), False)


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 32, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a string of ``length`` bytes that also starts anywhere else.

    Texts are their UTF-8 bytes, null as empty; matches stay within a document, may overlap
    themselves, and are judged on the input.  Returns one row a document: doc_id, n_bytes,
    spans (maximal removed runs of bytes, end exclusive), kept (binary; a cut may fall inside a
    character).  Texts shorter than ``length`` are kept whole.  A repeated row is another place
    where its text occurs; rows that share an identifier are judged each by its own text; rows
    without identifier are left out.  ``length`` is a multiple of eight above ``gram`` and STEP.
    """
    docs = named_texts(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    # Equal texts: each of their windows occurs again, so only one of them need be searched.
    digest = checkpoint(docs.select(*DOCUMENT, F.octet_length("text").alias("n"), F.sha2("text", 256).alias("digest")).where(F.col("n") >= length))
    groups = checkpoint(digest.groupBy("digest").agg(F.count("*").alias("c"), F.min(F.struct(*DOCUMENT)).alias("first")).where("c > 1"))
    copies = checkpoint(digest.join(F.broadcast(groups) if is_small(groups) else groups, "digest").groupBy(*DOCUMENT).agg(F.min("first").alias("first")))
    # A repeated row of the one that is searched goes with it: places of one document aren't told apart by row.
    one_each = keep_ids(docs, copies.where("doc_id <> first.doc_id or var <> first.var").select(*DOCUMENT), "anti")

    def cut(batches):
        out = Output(schema)
        for doc, text, runs, whole in rows(batches, "doc_id", "text", "data", "whole"):
            if whole:
                a, z = np.array([0]), np.array([len(text)])
            else:
                a, z = intervals(unpack(runs), length)
            at, kept = 0, []
            for s, e in zip(a.tolist(), z.tolist()):
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            out.add(doc, len(text), [{"start": s, "end": e} for s, e in zip(a.tolist(), z.tolist())], b"".join(kept))
            if out.full():
                yield out.take()
        yield from out.rest()

    whole, rest = attach(docs, copies.select(*DOCUMENT), DOCUMENT)
    hit, clean = attach(rest, checkpoint(repeated_windows(one_each, length, gram, hot)), DOCUMENT)
    blank, no, yes = F.lit(None).cast("binary").alias("data"), F.lit(False).alias("whole"), F.lit(True).alias("whole")
    parts = hit.select("doc_id", "text", "data", no).unionByName(clean.select("doc_id", "text", blank, no)).unionByName(whole.select("doc_id", "text", blank, yes))
    return parts.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op9_suffix_array(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of ``remove_repeats`` over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str]], length: int = 200) -> list[tuple[int, int, int, int, str]]:
    """The contract on a few documents, for tests."""
    seen: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in sorted(docs)]
    for _, t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for doc, t in data:
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        kept = bytes(b for b, g in zip(t, gone[1:-1]) if not g)
        out.append((doc, len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
