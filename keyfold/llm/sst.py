"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their identifier:

    blocks   entries (shared key bytes u8, value bytes u32, rest of the key, ids), keys
             prefix-compressed from the block's first on
    index    for each block: first key, offset, bytes, entries, ids before it in the shard
    filter   Bloom filter of the keys (ten bits a key, seven probes)
    footer   fixed size, at the end: places and sizes of index and filter, counts, id width

A key is the identifier as eight big-endian bytes with the sign bit turned, so bytes sort as
numbers do.  A reader finds a document by the filter, a binary search in the index and one block.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Output, checkpoint, checkpoint_dir, partitions_for, remove_folder, text_bytes, texts
from .rolling import mix
from .tokens import encoded

BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
#: Text that a task encodes: about a shard's worth, and less where there is little.
TASK_BYTES, LEAST_BYTES = 256 << 20, 16 << 20
MAGIC = b"KFSST001"
INDEX = np.dtype([("key", ">u8"), ("offset", "<u8"), ("bytes", "<u4"), ("entries", "<u4"), ("before", "<u8")])
FOOTER = struct.Struct("<QQQQQQI8s")  # index at, blocks, filter at, filter bytes, documents, ids, id width
ENTRY = struct.Struct("<BI")
PROBES = 7

MANIFEST = "path string, part int, nth int, first long, last long, documents long, ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder's URI; executors and driver resolve it alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def shard_name(root: str, part: int, nth: int) -> str:
    return f"{root}/shard-{part:06d}-{nth:04d}.sst"


def settle(files: pa.fs.FileSystem, name: str, final: str) -> None:
    """Give a finished file its final name; where an earlier attempt left the same file, that one stays."""

    def there() -> bool:
        return files.get_file_info(final).type != pa.fs.FileType.NotFound

    if not there():
        try:
            return files.move(name, final)
        except OSError:
            if not there():
                raise
    files.delete_file(name)


def key_of(doc_id: int) -> int:
    return doc_id + (1 << 63)


def doc_of(key: int) -> int:
    return key - (1 << 63)


def bloom_bits(keys: np.ndarray, n_bits: int) -> np.ndarray:
    """Places of each key's bits, one row a key."""
    one, two = mix(keys.astype(np.uint64)), mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    return (one[:, None] + np.arange(PROBES, dtype=np.uint64) * two[:, None]) % np.uint64(n_bits)


class Writer:
    """Writes one shard, a block at a time; keys come in ascending order."""

    def __init__(self, stream, width: int):
        self.stream, self.width, self.at, self.ids = stream, width, 0, 0
        self.index: list[tuple] = []
        self.keys: list[int] = []
        self._open()

    def _open(self) -> None:
        self.block, self.first, self.last, self.entries, self.before = bytearray(), None, b"", 0, self.ids

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key, value = key_of(doc_id).to_bytes(8, "big"), ids.astype(f"<u{self.width}").tobytes()
        if self.first is None:
            self.first = key
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(8, len(self.last)))
        self.block += ENTRY.pack(shared, len(value)) + key[shared:] + value
        self.last = key
        self.entries += 1
        self.ids += len(ids)
        self.keys.append(key_of(doc_id))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            self.index.append((int.from_bytes(self.first, "big"), self.at, len(self.block), self.entries, self.before))
            self.stream.write(bytes(self.block))
            self.at += len(self.block)
        self._open()

    def close(self) -> None:
        self._flush()
        index = np.array(self.index, INDEX).tobytes()
        n_bits = max(64, 10 * len(self.keys))
        bits = np.zeros(n_bits, np.uint8)
        bits[bloom_bits(np.array(self.keys, np.uint64), n_bits).ravel().astype(np.int64)] = 1
        bloom = struct.pack("<Q", n_bits) + np.packbits(bits).tobytes()
        self.stream.write(index + bloom + FOOTER.pack(self.at, len(self.index), self.at + len(index), len(bloom), len(self.keys), self.ids, self.width, MAGIC))
        self.stream.close()


class Shard:
    """Reads one shard; only the parts asked for."""

    def __init__(self, files: pa.fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        index_at, blocks, bloom_at, bloom_bytes, self.documents, self.ids, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        self.index = np.frombuffer(self.file.read_at(blocks * INDEX.itemsize, index_at), INDEX)
        self.starts = self.index["key"].tolist()
        self.bloom_at, self.bloom_bytes, self.bloom = bloom_at, bloom_bytes, b""

    def close(self) -> None:
        self.file.close()

    def may_contain(self, doc_id: int) -> bool:
        data = self.bloom = self.bloom or self.file.read_at(self.bloom_bytes, self.bloom_at)
        n_bits = int.from_bytes(data[:8], "little")
        at = bloom_bits(np.array([key_of(doc_id)], np.uint64), n_bits)[0].astype(np.int64)
        return all(data[8 + (a >> 3)] >> (7 - (a & 7)) & 1 for a in at.tolist())

    def block(self, i: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, ids before it in the shard, ids) of one block's entries."""
        row = self.index[i]
        data, at, key, before = self.file.read_at(int(row["bytes"]), int(row["offset"])), 0, b"", int(row["before"])
        for _ in range(int(row["entries"])):
            shared, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + 8 - shared]
            at += 8 - shared
            ids = np.frombuffer(data, f"<u{self.width}", n // self.width, at)
            at += n
            yield doc_of(int.from_bytes(key, "big")), before, ids
            before += len(ids)

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document (of the first, if several rows had this identifier), or None."""
        if not len(self.index) or not self.may_contain(doc_id):
            return None
        i = max(0, bisect_right(self.starts, key_of(doc_id)) - 1)
        while i > 0 and self.starts[i] == key_of(doc_id):
            i -= 1  # repeated rows may begin in the block before
        for j in range(i, len(self.index)):
            if self.starts[j] > key_of(doc_id):
                return None
            for doc, _, ids in self.block(j):
                if doc == doc_id:
                    return ids
        return None


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids (each with ``end_id`` appended) as shards; returns their manifest.

    Null and empty texts are ``end_id`` alone; rows without identifier are left out; repeated rows
    are entries each.  A shard is written under a name of its own attempt and then renamed, so a
    task that runs again, or twice, leaves the same files.
    """
    docs = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])

    def write(batches):
        from .tokens import shared

        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        part, out = TaskContext.get().partitionId(), Output(schema)
        writer = name = first = None
        width = shared(tokenizer).dtype.itemsize if end_id < 1 << 16 else 4

        def done():
            writer.close()
            final = shard_name(root, part, len(out.columns[0]))
            settle(files, name, final)
            out.add(final, part, len(out.columns[0]), first, doc_of(writer.keys[-1]), len(writer.keys), writer.ids)

        for doc, ids in encoded(batches, tokenizer):
            if writer is None:
                name, first = f"{root}/.{uuid.uuid4().hex}", doc
                writer = Writer(files.open_output_stream(name), width)
            writer.add(doc, np.append(ids, np.array(end_id, f"<u{width}")))
            if writer.at >= SHARD_BYTES:
                done()
                writer = None
        if writer is not None:
            done()
        yield from out.rest()

    total = text_bytes(docs)
    parts = max(partitions_for(total, TASK_BYTES), min(4 * spark.sparkContext.defaultParallelism, partitions_for(total, LEAST_BYTES)))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return checkpoint(ordered.mapInArrow(write, MANIFEST))


#: Parts of a manifest whose shards are placed together.
TOGETHER = 1024


def placed(manifest: DataFrame) -> DataFrame:
    """``manifest`` with start, the ids of all shards before: sums of many parts first, then within each of them."""
    groups = manifest.withColumn("many", F.expr(f"part div {TOGETHER}"))
    sums = groups.groupBy("many").agg(F.sum("ids").alias("of_many"))
    ahead = Window.orderBy("many").rowsBetween(Window.unboundedPreceding, -1)  # one row for TOGETHER parts
    within = Window.partitionBy("many").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("many", F.coalesce(F.sum("of_many").over(ahead), F.lit(0)).alias("ahead"))
    return groups.join(sums, "many").withColumn("start", F.col("ahead") + F.coalesce(F.sum("ids").over(within), F.lit(0))).drop("many", "ahead")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, out of the files; ids are little-endian
    unsigned 32-bit, start counts the ids of all documents before."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    each = placed(manifest).select("path", "start").repartition(max(1, manifest.count()))

    def read(batches):
        files, _ = filesystem(folder)
        out = Output(schema)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(files, path)
                for doc, ahead, ids in shard:
                    out.add(doc, start + ahead, len(ids), ids.astype("<u4").tobytes())
                    if out.full():
                        yield out.take()
                shard.close()
        yield from out.rest()

    return each.mapInArrow(read, DOCUMENTS)


def find_documents(manifest: DataFrame, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted documents that the shards hold, each looked up by filter, index and one block.

    Where rows shared an identifier, the ids of the first; null and unknown identifiers give no
    row.  The identifiers that bound each shard, a few numbers for SHARD_BYTES of ids, are
    broadcast to find the shard of each wanted one.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    shards = manifest.select("first", "last", "part", "nth").orderBy("part", "nth").toArrow()
    bounds = manifest.sparkSession.sparkContext.broadcast([shards.column(c).to_numpy() for c in shards.column_names])

    def route(batches):
        first, last, part, nth = bounds.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(last, ids)  # the first shard that reaches as far
            inside = at < len(last)
            inside[inside] = first[at[inside]] <= ids[inside]
            at, ids = at[inside], ids[inside]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part[at]), pa.array(nth[at])], names=["doc_id", "part", "nth"])

    def look(batches):
        files, root = filesystem(folder)
        out, shard, at = Output(schema), None, None
        for batch in batches:
            for doc, part, nth in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "nth"))):
                if at != (part, nth):
                    if shard is not None:
                        shard.close()
                    shard, at = Shard(files, shard_name(root, part, nth)), (part, nth)
                ids = shard.get(doc)
                if ids is not None:
                    out.add(doc, ids.astype("<u4").tobytes())
                    if out.full():
                        yield out.take()
        if shard is not None:
            shard.close()
        yield from out.rest()

    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    asked = ids.mapInArrow(route, "doc_id long, part int, nth int").repartition("part", "nth").sortWithinPartitions("part", "nth", "doc_id")
    return asked.mapInArrow(look, "doc_id long, ids binary")


def op7_sorted_string_table(spark, sf_dir: str) -> DataFrame:
    """Contract query: write the shards into the shared folder, read them back, digest the ids, delete the shards."""
    import public_tokenizers

    folder = f"{checkpoint_dir(spark)}/sst-{uuid.uuid4().hex}"
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("word_bpe_49k.json"))
    out = checkpoint(read_shards(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    remove_folder(spark, folder)
    return out
