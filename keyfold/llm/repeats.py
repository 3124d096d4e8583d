"""Anchors that recur anywhere, and pieces of text dealt to the bucket of the anchor they hold.

Anchors (64-bit hashes with a document and a place) are far too many for a row each.  Every map
task sorts what it has, settles recurrences that it sees itself, and forwards one occurrence of
each anchor in packed blobs, one for each bucket of anchors; a bucket's task then sorts a bounded
array.  An anchor that a third of all places hold is thus forwarded once a flush and cannot fill a
bucket.  Pieces travel the same way: equal pieces are settled where they meet, and one goes on.

A document is named by its identifier and a hash of its text (``var``), so that rows which share
an identifier but not a text are told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Output, checkpoint, texts, unpack_runs
from .rolling import mix

BLOB = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("data", pa.binary())])
FLAGS = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
LISTS = pa.schema([("doc_id", pa.int64()), ("var", pa.int32()), ("data", pa.binary())])
DOCUMENT = ["doc_id", "var"]
FLUSH = 1 << 20
HELD_BYTES = 16 << 20
#: An anchor with more places than this is split by what stands beside it.
HOT = 50_000
#: Most anchors that are listed as hot, whatever the size of the table.
MOST_HOT = 4_000_000

_SEED = np.dtype([("key", "<u8"), ("doc", "<i8"), ("var", "<i4"), ("at", "<u4"), ("times", "<u4")])


def named_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, var, text)."""
    return texts(docs, id_col, text_col).select("doc_id", F.hash("text").alias("var"), "text")


def _settle(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one occurrence of each anchor to forward, occurrences of those that recur here)."""
    y = x[np.argsort(x["key"], kind="stable")]
    first = np.append(True, y["key"][1:] != y["key"][:-1])
    at = np.flatnonzero(first)
    times = np.add.reduceat(y["times"].astype(np.int64), at)
    ahead = y[first]
    ahead["times"] = np.minimum(times, 0xFFFFFFFF)
    return ahead, y[np.repeat(times > 1, np.diff(np.append(at, len(y))))]


def pack_flags(doc: np.ndarray, var: np.ndarray, start: np.ndarray, count: np.ndarray) -> bytes:
    """Flagged runs of places: (document, first place, number of places)."""
    return b"".join((np.int64(len(doc)).tobytes(), doc.astype("<i8").tobytes(), var.astype("<i4").tobytes(), start.astype("<u4").tobytes(), count.astype("<u4").tobytes()))


def unpack_flags(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i4", n, 8 + 8 * n), np.frombuffer(data, "<u4", n, 8 + 12 * n), np.frombuffer(data, "<u4", n, 8 + 16 * n)


def as_runs(doc: np.ndarray, var: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Single places as runs."""
    order = np.lexsort((at, var, doc))
    doc, var, at = doc[order], var[order], at[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (var[1:] != var[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], var[first], at[first], np.diff(np.append(first, len(doc)))


def flag_rows(parts: list[tuple], n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Flagged runs, dealt to the buckets of their documents."""
    if not parts:
        return
    doc, var, start, count = (np.concatenate(x) for x in zip(*parts))
    bucket = (mix(doc.astype("<i8").view("<u8")) >> np.uint64(33)) % np.uint64(n_buckets)
    order = np.lexsort((start, var, doc, bucket))
    bucket, doc, var, start, count = bucket[order], doc[order], var[order], start[order], count[order]
    cut = np.append(0, np.flatnonzero(np.diff(bucket)) + 1) if len(bucket) else []
    for a, z in zip(cut, [*cut[1:], len(bucket)]):
        yield int(bucket[a]), pack_flags(doc[a:z], var[a:z], start[a:z], count[a:z])


def by_document(flags: DataFrame) -> DataFrame:
    """(doc_id, var, data) out of dealt flags; data of bucket -1 is handed on without a document."""

    def merge(t: pa.Table) -> pa.Table:
        out, parts = Output(LISTS), []
        for bucket, data in zip(t.column("bucket").to_pylist(), t.column("data").to_pylist()):
            if bucket < 0:
                out.add(None, None, data)
            else:
                parts.append(unpack_flags(data))
        if parts:
            doc, var, start, count = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((start, var, doc))
            doc, var, runs = doc[order], var[order], np.stack([start[order], count[order]], 1).astype("<u4")
            cut = np.append(0, np.flatnonzero((np.diff(doc) != 0) | (np.diff(var) != 0)) + 1) if len(doc) else []
            for a, z in zip(cut, [*cut[1:], len(doc)]):
                out.add(int(doc[a]), int(var[a]), runs[a:z].tobytes())
        return pa.Table.from_batches(list(out.rest()), LISTS)

    return flags.groupBy("bucket").applyInArrow(merge, "doc_id long, var int, data binary")


def recurring_anchors(docs: DataFrame, anchors: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], n_buckets: int, hot: int, places: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, var, data): the places of each document whose anchor occurs again anywhere, packed
    (``unpack`` reads them); and the sorted anchors that occur over ``hot`` times.

    ``anchors`` yields (doc_id, var, hashes, places) for the rows of a partition; ``places`` is
    about how many there are.  The list of hot anchors never holds over MOST_HOT.
    """
    hot = max(hot, -(-places // MOST_HOT))

    def split(batches):
        out = Output(BLOB)

        def flush(held):
            ahead, flagged = _settle(np.concatenate(held))
            for bucket, data in flag_rows([as_runs(flagged["doc"], flagged["var"], flagged["at"])], n_buckets):
                out.add(bucket, 1, data)
            bucket = (ahead["key"] >> np.uint64(33)) % np.uint64(n_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, ahead = bucket[order], ahead[order]
            cut = np.append(0, np.flatnonzero(np.diff(bucket)) + 1) if len(bucket) else []
            for a, z in zip(cut, [*cut[1:], len(bucket)]):
                out.add(int(bucket[a]), 0, ahead[a:z].tobytes())
                if out.full():
                    yield out.take()
            yield from out.rest()

        held, n = [], 0
        for doc, var, hashes, at in anchors(batches):
            for a in range(0, len(at), FLUSH):
                x = np.zeros(min(FLUSH, len(at) - a), _SEED)
                x["key"], x["doc"], x["var"], x["at"], x["times"] = hashes[a : a + FLUSH], doc, var, at[a : a + FLUSH], 1
                held.append(x)
                n += len(x)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    def settle(t: pa.Table) -> pa.Table:
        held, parts, often = [], [], np.zeros(0, "<u8")
        for what, data in zip(t.column("kind").to_pylist(), t.column("data").to_pylist()):
            if what:
                parts.append(unpack_flags(data))
            else:
                held.append(np.frombuffer(data, _SEED))
        if held:
            ahead, flagged = _settle(np.concatenate(held))
            parts.append(as_runs(flagged["doc"], flagged["var"], flagged["at"]))
            often = ahead["key"][ahead["times"] > hot]
        out = Output(FLAGS)
        for bucket, data in flag_rows(parts, n_buckets):
            out.add(bucket, data)
        if len(often):
            out.add(-1, often.tobytes())
        return pa.Table.from_batches(list(out.rest()), FLAGS)

    dealt = docs.mapInArrow(split, "bucket int, kind byte, data binary").groupBy("bucket").applyInArrow(settle, "bucket int, data binary")
    seen = checkpoint(by_document(dealt))
    often = [np.frombuffer(r["data"], "<u8") for r in seen.where("doc_id is null").collect()]
    return seen.where("doc_id is not null"), np.unique(np.concatenate([np.zeros(0, "<u8"), *often]))


def hot_keys(counted: DataFrame, hot: int) -> np.ndarray:
    """The sorted keys of (key, n) whose sum exceeds ``hot``: as few as the rows summed over ``hot``."""
    found = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def is_in(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which items a sorted array holds."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


_PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("var", "<i4"), ("lo", "<u4"), ("anchor", "<u4"), ("windows", "<u4"), ("size", "<u4"), ("many", "<u4")])


def _pack(pieces: list[tuple]) -> bytes:
    head = np.array([p[:-1] for p in pieces], _PIECE)
    return np.int64(len(pieces)).tobytes() + head.tobytes() + b"".join(p[-1] for p in pieces)


def _unpack(data: bytes) -> Iterator[tuple]:
    n = int.from_bytes(data[:8], "little")
    head, o = np.frombuffer(data, _PIECE, n, 8), 8 + n * _PIECE.itemsize
    for key, doc, var, lo, anchor, windows, size, many in head.tolist():
        yield key, doc, var, lo, anchor, windows, many, data[o : o + size]
        o += size


class Held:
    """Distinct pieces with one occurrence each, and the runs of windows settled so far.

    ``later``: every window of an occurrence but the earliest is flagged; else every window of
    each that occurs twice.  Two occurrences at the same place of one identifier do not precede
    each other.
    """

    def __init__(self, later: bool):
        self.later = later
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[bytes, list] = {}
        self.twins: dict[bytes, list] = {}  # the same place under other texts of one identifier
        self.settled: list[tuple[int, int, int, int]] = []
        self.size = 0

    def add(self, key, doc, var, lo, anchor, windows, many, piece) -> None:
        have = self.pieces.get(piece)
        if have is None:
            self.pieces[piece] = [key, doc, var, lo, anchor, windows, many]
            self.size += len(piece) + 200
        elif not self.later:
            self.settled.append((doc, var, lo, windows))
            if not have[6]:
                self.settled.append((*have[1:4], windows))
                have[6] = 1
        elif (doc, lo) == (have[1], have[3]):
            if var != have[2]:
                self.twins.setdefault(piece, []).append([key, doc, var, lo, anchor, windows, many])
        elif (doc, lo) < (have[1], have[3]):
            self.settled += [(*x[1:4], windows) for x in (have, *self.twins.pop(piece, ()))]
            have[1:4] = doc, var, lo
        else:
            self.settled.append((doc, var, lo, windows))

    def full(self) -> bool:
        return self.size >= HELD_BYTES or len(self.settled) >= 1 << 17

    def items(self) -> Iterator[tuple]:
        for piece, have in self.pieces.items():
            yield (*have, piece)
        for piece, others in self.twins.items():
            for have in others:
                yield (*have, piece)

    def flags(self) -> list[tuple]:
        return [tuple(np.array(self.settled, np.int64).T)] if self.settled else []


def settle_pieces(docs: DataFrame, pieces: Callable, compare: Callable, n_buckets: int, later: bool) -> DataFrame:
    """(doc_id, var, data): starts of the flagged windows of each document, packed.

    ``pieces`` yields (key, doc, var, lo, anchor, windows, 0, piece) for the rows of a partition: text that holds
    ``windows`` windows from place ``lo`` on, all under one key; equal windows have equal keys.
    ``compare`` takes a list of distinct pieces of one bucket and yields flagged runs (arrays doc, var, start, count).
    """

    def split(batches):
        out, held = Output(BLOB), Held(later)

        def flush():
            buckets: dict[int, list] = {}
            for key, doc, var, lo, anchor, windows, many, piece in held.items():
                buckets.setdefault((key >> 33) % n_buckets, []).append((key, doc, var, lo, anchor, windows, len(piece), many, piece))
            for b, of in sorted(buckets.items()):
                out.add(b, 0, _pack(of))
                if out.full():
                    yield out.take()
            for b, data in flag_rows(held.flags(), n_buckets):
                out.add(b, 1, data)
            yield from out.rest()
            held.clear()

        for p in pieces(batches):
            held.add(*p)
            if held.full():
                yield from flush()
        yield from flush()

    def sort(t: pa.Table) -> pa.Table:
        parts, held = [], Held(later)
        for what, data in zip(t.column("kind").to_pylist(), t.column("data").to_pylist()):
            if what:
                parts.append(unpack_flags(data))
            else:
                for p in _unpack(data):
                    if p[6] and not later:  # it recurred in its map task, which flagged that place
                        have = held.pieces.get(p[-1])
                        if have is not None and not have[6]:
                            held.settled.append((*have[1:4], p[5]))
                            have[6] = 1
                        elif have is None:
                            held.add(*p)
                    else:
                        held.add(*p)
        by_key: dict[int, list] = {}
        for p in held.items():
            by_key.setdefault(p[0], []).append(p)
        parts += held.flags()
        parts += compare([p for of in by_key.values() if len(of) > 1 for p in of])
        out = Output(FLAGS)
        for bucket, data in flag_rows(parts, n_buckets):
            out.add(bucket, data)
        return pa.Table.from_batches(list(out.rest()), FLAGS)

    found = docs.mapInArrow(split, "bucket int, kind byte, data binary").groupBy("bucket").applyInArrow(sort, "bucket int, data binary")
    return by_document(found)


def unpack(data: bytes | None) -> np.ndarray:
    """Ascending distinct places of a row of flags."""
    return np.unique(unpack_runs(data or b""))

