"""Substring dedup over words by seed and extend.

Anchors are winnowed word grams: any ``length`` consecutive words hold at least one, and equal
windows choose the same one.  Anchors that occur only once anywhere are dropped; documents are
joined on those that recur, and around each the match is extended a word at a time to either side,
on the words themselves, for as long as another occurrence still agrees.  Where both sides reach
``length`` words together with the anchor, the later occurrence repeats an earlier one; what
neighbouring anchors give is united to maximal repeats.

An anchor with very many places is split by the words beside it, up to a whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .common import Output, attach, buckets_for, checkpoint, intervals, rows, text_bytes
from .repeats import DOCUMENT, HOT, as_runs, is_in, named_texts, recurring_anchors, settle_pieces, unpack

OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
PIECE_BYTES = 8 << 20


def _values(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return R.word_values(data, *R.word_bounds(data))


def _numbered(pairs: np.ndarray) -> np.ndarray:
    """Dense numbers of equal values; -1 stays."""
    out = np.full(len(pairs), -1, np.int64)
    live = pairs >= 0
    out[live] = np.unique(pairs[live], return_inverse=True)[1]
    return out


def _alone_out(group: np.ndarray) -> np.ndarray:
    """``group`` with -1 where no other row is in it: its match goes no further."""
    live = group >= 0
    if live.any():
        group[live] = np.where(np.bincount(group[live])[group[live]] > 1, group[live], -1)
    return group


def extend(pieces: list[tuple], length: int, gram: int) -> list[tuple]:
    """Runs of windows of pieces (key, doc, var, lo, anchor, windows, many, words joined by spaces)
    that an earlier piece repeats, as arrays (doc, var, start, count).

    All pieces are extended together: after ``r`` steps to one side, those with the same anchor
    and the same ``r`` words there have the same number, and those left alone drop out.
    """
    if not pieces:
        return []
    split = [p[-1].split(b" ") for p in pieces]
    doc, var, lo, anchor, windows = (np.array([p[i] for p in pieces], np.int64) for i in (1, 2, 3, 4, 5))
    order = np.lexsort((lo + anchor, doc))  # by the place of the anchor: the earliest first
    split = [split[i] for i in order.tolist()]
    doc, var, lo, anchor, windows = (x[order] for x in (doc, var, lo, anchor, windows))
    n, reach = len(split), length - gram
    ids: dict[bytes, int] = {}
    number = lambda w: ids.setdefault(w, len(ids))
    core = np.fromiter((number(b" ".join(w[a : a + gram])) for w, a in zip(split, anchor.tolist())), np.int64, n)
    sides = np.full((2, reach, n), -1, np.int64)
    for i, (w, a) in enumerate(zip(split, anchor.tolist())):
        for k, x in enumerate(w[max(0, a - reach) : a][::-1]):
            sides[0, k, i] = number(x)
        for k, x in enumerate(w[a + gram : a + gram + reach]):
            sides[1, k, i] = number(x)
    reached = []
    for side in sides:
        group = [_alone_out(_numbered(core))]
        for words in side:
            last = group[-1]
            group.append(_alone_out(_numbered(np.where((last >= 0) & (words >= 0), last * len(ids) + words, -1))))
        reached.append(group)
    found = [np.zeros((3, 0), np.int64)]
    place = lo + anchor
    for left in range(reach + 1):
        one, two = reached[0][left], reached[1][reach - left]
        at = np.flatnonzero((one >= 0) & (two >= 0) & (left <= anchor) & (anchor - left < windows))
        if len(at) < 2:
            continue
        _, first, group = np.unique(one[at] * n + two[at], return_index=True, return_inverse=True)
        lead = at[first[group]]
        again = at[(doc[at] != doc[lead]) | (place[at] != place[lead])]
        found.append(np.stack([doc[again], var[again], place[again] - left]))
    return [as_runs(*np.concatenate(found, 1))]


def repeated_spans(docs: DataFrame, length: int = 20, gram: int = 8, hot: int = HOT) -> DataFrame:
    """(doc_id, var, data): packed starts of the windows of ``length`` words that also start earlier."""
    w, total = length - gram + 1, text_bytes(docs)

    def anchors(batches):
        for doc, var, text in rows(batches, *DOCUMENT, "text"):
            v, found, hashes = _values(text), [], []
            for a, z in R.blocks(len(v), length):
                g = R.windows(v[a:z], gram)
                at = R.chosen_places(g, w)
                found.append(at + a)
                hashes.append(g[at])
            if found:
                at, first = np.unique(np.concatenate(found), return_index=True)
                yield doc, var, np.concatenate(hashes)[first], at

    recurring, often = recurring_anchors(docs, anchors, buckets_for(docs.sparkSession, total), hot, total // (3 * w))
    listed = docs.sparkSession.sparkContext.broadcast(often)

    def pieces(batches):
        often = listed.value
        for doc, var, text, runs in rows(batches, *DOCUMENT, "text", "data"):
            known = unpack(runs)
            words = text.split()
            flag = np.zeros(len(words) + 1, bool)
            flag[known] = True
            joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            begins, values = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1, _values(text)
            for a, z in R.blocks(len(values), length):
                grams = R.windows(values[a:z], gram)
                at = R.window_places(grams, w)
                starts = np.flatnonzero(flag[a + at])
                if not len(starts):
                    continue
                chosen = at[starts]
                split = is_in(grams[chosen], often)
                new = (np.diff(chosen) != 0) | (np.diff(starts) != 1) | split[1:]
                cut = np.append(0, np.flatnonzero(new) + 1)
                first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
                keys = grams[at[first]]
                if split.any():
                    keys = np.where(split[cut], R.windows(values[a:z], length)[first], keys)
                for s, e, c, key in zip((a + first).tolist(), (a + last).tolist(), (a + at[first]).tolist(), keys.tolist()):
                    yield key, doc, var, s, c - s, e - s + 1, 0, joined[begins[s] : ends[e + length - 1] - 1]

    with_anchors = attach(docs, recurring, DOCUMENT)[0].select(*DOCUMENT, "text", "data")
    found = recurring.select(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    return checkpoint(settle_pieces(with_anchors, pieces, lambda p: extend(p, length, gram), buckets_for(docs.sparkSession, found // 8 * 200, PIECE_BYTES), True))


def remove_repeats(docs: DataFrame, length: int = 20, gram: int = 8, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word covered by a window of ``length`` words that also starts earlier.

    Earlier: in a document of smaller id, or in the same one at a smaller place; windows are
    judged on the input.  Words are runs of bytes other than space and 0x09-0x0D.  Returns one
    row a document: doc_id, n_words, n_removed, spans (maximal repeats, in words, end
    exclusive), kept_text (kept words joined by one space).  Null or empty texts have no words
    and no spans.  Rows that share an identifier are judged each by its own text, and none
    precedes another at the same place; rows without identifier are left out.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_text", pa.string())])

    def cut(batches):
        out = Output(schema)
        for doc, text, runs in rows(batches, "doc_id", "text", "data"):
            words = text.split()
            starts = unpack(runs)
            a, z = intervals(starts, length)
            kept, at = [], 0
            for s, e in zip(a.tolist(), z.tolist()):
                kept += words[at:s]
                at = e
            kept += words[at:]
            out.add(doc, len(words), len(words) - len(kept), [{"start": s, "end": e} for s, e in zip(a.tolist(), z.tolist())], b" ".join(kept).decode())
            if out.full():
                yield out.take()
        yield from out.rest()

    docs = named_texts(docs, id_col, text_col)
    hit, clean = attach(docs, repeated_spans(docs, length, gram, hot), DOCUMENT)
    blank = F.lit(None).cast("binary").alias("data")
    return hit.select("doc_id", "text", "data").unionByName(clean.select("doc_id", "text", blank)).mapInArrow(cut, OUT)


def op5_seed_extend(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of ``remove_repeats`` over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str]], length: int = 20) -> list[tuple[int, int, int, str]]:
    """The contract on a few documents, for tests."""
    seen, out = set(), []
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                gone[i : i + length] = True
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out
