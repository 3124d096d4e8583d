"""Best-fit packing of token sequences, improved by swap-based local search.

Pieces are dealt by hash to blocks of bounded size and each block is packed: best fit, longest
first, then exchanges between underfull bins (one for one, two for one, one for two, or a move),
each raising the sum of squared fills, until bins empty and there are as few as the tokens need,
or no exchange is left.  The least filled bins of all blocks, a sixteenth of their pieces, are then dealt to
fewer blocks and packed anew, and so on until one block holds them all; so what a block leaves
over is made up for by others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Output, checkpoint, texts
from .tokens import encoded

#: Pieces a block holds on average, and the share of them that it hands on.
BLOCK_PIECES, HANDED = 2048, 16

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole ones but for the first."""
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))] if n > capacity else [(0, n)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): a document's ids and ``end_id``, cut into pieces of at
    most ``capacity``; ids are little-endian unsigned 32-bit.

    Only longer documents are cut, into whole pieces but for the first.  A null or empty text is
    ``end_id`` alone; rows without identifier are left out; repeated rows are documents each.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def pieces(batches):
        out = Output(schema)
        for doc, ids in encoded(batches, tokenizer):
            ids = np.append(ids, end_id).astype("<u4")
            for i, (a, n) in enumerate(cut(len(ids), capacity)):
                out.add(doc, i, a, n, ids[a : a + n].tobytes())
                if out.full():
                    yield out.take()
        yield from out.rest()

    return texts(docs, id_col, text_col).mapInArrow(pieces, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: each item, longest first, goes where it leaves least room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, some = [], 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room[r - n].append(b)
        some |= 1 << (r - n)
    return bins


def _bits(sizes: list[int]) -> tuple[int, int]:
    """Sets, as bits of a number, of the sizes and of the sums of two."""
    ones = twos = 0
    for n in sizes:
        twos |= ones << n
        ones |= 1 << n
    return ones, twos


def _each(bits: int) -> list[int]:
    """Members of a set, largest first."""
    out = []
    while bits:
        n = bits.bit_length() - 1
        out.append(n)
        bits ^= 1 << n
    return out


def _least_from(bits: int, low: int) -> int | None:
    """The least member from ``low`` on."""
    bits >>= low
    return low + (bits & -bits).bit_length() - 1 if bits else None


class _Search:
    """Bins by number; sizes in a bin, and sums of two, as sets in which one lookup finds the best partner of a size."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = dict(enumerate(map(list, bins)))
        self.fill, self.sets = {}, {}
        for b in self.bins:
            self._count(b)

    def _count(self, b: int) -> None:
        sizes = [self.lengths[i] for i in self.bins[b]]
        if sizes:
            self.fill[b], self.sets[b] = sum(sizes), _bits(sizes)
        else:
            del self.bins[b], self.fill[b], self.sets[b]

    def best(self, source: int, order: list[int]) -> tuple[int, int, int, int] | None:
        """(gain, target, what goes, what comes back) of the exchange that raises squared fill most.

        ``order`` holds the underfull bins, the emptiest first: what a target gains is bounded by
        its room, so the search ends when no later one can do better.
        """
        room = self.capacity - self.fill[source]
        ones, twos = (_each(x) for x in self.sets[source])
        best = None
        for t in order:
            free = self.capacity - self.fill[t]
            if t == source:
                continue
            if best and 2 * free * room <= best[0]:
                break
            one, two = self.sets[t]
            for sizes, back in ((ones, one | two | 1), (twos, one | 1)):
                for out in sizes:
                    came = _least_from(back, max(0, out - free))
                    if came is None or came >= out:
                        continue
                    d = out - came
                    gain = 2 * d * (self.fill[t] - self.fill[source] + d)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, t, out, came
                    if d == free:
                        break
        return best

    def _take(self, b: int, size: int) -> list[int]:
        """One item of ``size``, or two that make it up; none for nothing."""
        if not size:
            return []
        at: dict[int, int] = {}
        for i in self.bins[b]:
            n = self.lengths[i]
            if n == size:
                return [i]
            at.setdefault(n, i)
        seen: dict[int, int] = {}
        for i in self.bins[b]:
            n = self.lengths[i]
            if size - n in seen:
                return [seen[size - n], i]
            seen[n] = i
        raise KeyError(size)

    def exchange(self, source: int, target: int, out: int, back: int) -> None:
        goes, comes = self._take(source, out), self._take(target, back)
        self.bins[source] = [i for i in self.bins[source] if i not in goes] + comes
        self.bins[target] = [i for i in self.bins[target] if i not in comes] + goes
        self._count(source)
        self._count(target)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchange items between underfull bins while squared fill rises, emptying the least filled.

    A bin hands one or two items to another for one, two or none of less together.  The least
    filled bin that has any such exchange makes the best one; ends when the bins are as few as
    their tokens need, or no bin has one.
    """
    fewest, at = -(-sum(lengths) // capacity), _Search(bins, lengths, capacity)
    while len(at.bins) > fewest:
        order = sorted((b for b in at.bins if at.fill[b] < capacity), key=lambda b: (at.fill[b], b))
        for source in order:
            found = at.best(source, order)
            if found:
                at.exchange(source, *found[1:])
                break
        else:
            break
    return list(at.bins.values())


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices for one block."""
    whole = [[i] for i, n in enumerate(lengths) if n == capacity]
    part = [i for i, n in enumerate(lengths) if n < capacity]
    short = [lengths[i] for i in part]
    return whole + [[part[i] for i in b] for b in local_search(best_fit(short, capacity), short, capacity)]


def _packed(pieces: DataFrame, level: int, n_blocks: int, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id, offset and ``handed``: whether the bin is one to be packed anew."""
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long").add("handed", "boolean")
    # Blocks are little data and much work, so they aren't left to be coalesced.
    tasks = min(n_blocks, max(4 * pieces.sparkSession.sparkContext.defaultParallelism, n_blocks // 64))
    salted = pieces.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(n_blocks)).cast("int"))

    def place(t: pa.Table) -> pa.Table:
        # in a fixed order, so that a task that runs again numbers alike
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length")])
        block = t.column("_block")[0].as_py()
        lengths = t.column("length").to_pylist()
        sequence, offset, handed = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        bins, left = pack_lengths(lengths, capacity), len(lengths) // HANDED if n_blocks > 1 else 0
        fills = [sum(lengths[i] for i in b) for b in bins]
        for k in sorted(range(len(bins)), key=lambda k: (fills[k], k)):
            at = 0
            for i in bins[k]:
                sequence[i], offset[i] = (level << 58) + (block << 28) + k, at
                at += lengths[i]
            if left > 0 and fills[k] < capacity:
                handed[bins[k]] = True
                left -= len(bins[k])
        t = t.drop_columns(["_block"]).append_column("sequence_id", pa.array(sequence))
        return t.append_column("offset", pa.array(offset)).append_column("handed", pa.array(handed))

    return checkpoint(salted.repartition(tasks, "_block").groupBy("_block").applyInArrow(place, schema))


def pack(pieces: DataFrame, n_pieces: int, capacity: int = 2048, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, length and others; about ``n_pieces``) with sequence_id and offset."""
    blocks, level, done = max(1, -(-n_pieces // block_pieces)), 0, None
    while True:
        placed = _packed(pieces, level, blocks, capacity)
        kept = placed.where("not handed").drop("handed")
        done = kept if done is None else done.unionByName(kept)
        if blocks == 1:
            return done
        pieces = placed.where("handed").drop("sequence_id", "offset", "handed")
        # A bin more than the share may go on with each block; blocks fall all the same.
        blocks, level = min(-(-blocks // 2), max(1, -(-pieces.count() // block_pieces))), level + 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    Ids stay where they were made; only lengths and digests are shuffled.  A null or empty text is
    one piece, ``end_id`` alone; rows without identifier are left out; repeated rows are
    documents each; an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, docs.count(), capacity)


def op4_best_fit(spark, sf_dir: str) -> DataFrame:
    """Contract query."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
