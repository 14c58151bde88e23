"""Token-id shards as sorted string tables (operator 1).

A shard file holds data blocks, a block index, a Bloom filter and a footer. Keys are 9 bytes that sort as the ids do
(null first); a value is a document's token ids, little-endian, 2 bytes each where the vocabulary allows and else 4.

    block   entries: shared key bytes u8, other key bytes u8, value bytes u32, the other key bytes, value
    index   by block: last key, offset u64, bytes u32, entries u32
    bloom   10 bits a key, 7 probes by double hashing
    footer  index offset u64, index blocks u32, bloom offset u64, bloom bytes u32, entries u64, ids u64, bytes an id u8,
            the shard's first key, crc32 of index and bloom u32, magic

Files are written by Spark's own text writer, one row a file, so any Hadoop file system and its commit protocol serve;
the writer's line end is the file's last byte. They are read by Spark's binaryFile source.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegraph.llm.bpe import encoder
from clausegraph.llm.common import gathered, materialise, partitions_for, small_batches

MAGIC = b"CGSSTAB1"
FOOTER = struct.Struct("<QIQIQQB9sI8s")
INDEX = struct.Struct("<9sQII")
ENTRY = struct.Struct("<BBI")
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 32 << 20
BLOOM_BITS, BLOOM_PROBES = 10, 7


def pack_key(doc_id: int | None) -> bytes:
    """9 bytes in the order of the ids; null before all."""
    return bytes(9) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def unpack_key(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """Bit positions by key and probe."""
    low = np.array([int.from_bytes(k[1:], "big") for k in keys], np.uint64)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = low + np.uint64(seed)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return (out[0][:, None] + out[1][:, None] * np.arange(BLOOM_PROBES, dtype=np.uint64)) % np.uint64(bits)


class ShardWriter:
    """Builds one shard from entries in key order."""

    def __init__(self, id_bytes: int):
        self.id_bytes, self.parts, self.size, self.index, self.keys, self.n_ids = id_bytes, [], 0, [], [], 0
        self.block: list[bytes] = []
        self.block_size, self.block_entries, self.last = 0, 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.tobytes()
        shared = 0
        while shared < min(len(self.last), len(key)) and self.last[shared] == key[shared]:
            shared += 1
        self.block += [ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
        self.block_size += ENTRY.size + len(key) - shared + len(value)
        self.block_entries += 1
        self.keys.append(key)
        self.n_ids += len(ids)
        self.last = key
        if self.block_size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            self.index.append(INDEX.pack(self.last, self.size, self.block_size, self.block_entries))
            self.parts += self.block
            self.size += self.block_size
            self.block, self.block_size, self.block_entries, self.last = [], 0, 0, b""

    def bytes_so_far(self) -> int:
        return self.size + self.block_size

    def finish(self) -> bytes:
        self._end_block()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits, np.uint8)
        bloom[_probes(self.keys, bits).ravel().astype(np.int64)] = 1
        bloom, index = np.packbits(bloom).tobytes(), b"".join(self.index)
        footer = FOOTER.pack(self.size, len(self.index), self.size + len(index), len(bloom), len(self.keys), self.n_ids, self.id_bytes, self.keys[0], zlib.crc32(index + bloom), MAGIC)
        return b"".join([*self.parts, index, bloom, footer])


class Shard:
    """Reads one shard: a point lookup asks the Bloom filter, bisects the block index and scans one block or more."""

    def __init__(self, content: bytes):
        self.content = content = content[:-1] if content[-9:-1] == MAGIC else content
        (self.index_at, self.blocks, self.bloom_at, self.bloom_bytes, self.entries, self.n_ids, self.id_bytes, self.first, crc, magic) = FOOTER.unpack_from(content, len(content) - FOOTER.size)
        if magic != MAGIC or zlib.crc32(content[self.index_at : self.bloom_at + self.bloom_bytes]) != crc:
            raise ValueError("not a whole shard file")
        self.dtype = np.dtype(f"<u{self.id_bytes}")
        self.index = [INDEX.unpack_from(content, self.index_at + i * INDEX.size) for i in range(self.blocks)]
        self.bloom = np.frombuffer(content, np.uint8, self.bloom_bytes, self.bloom_at)

    def stored(self, i: int) -> tuple[bytes, int]:
        """Bytes that hold block ``i``, and where it starts in them."""
        return self.content, self.index[i][1]

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        content, at = self.stored(i)
        n, last = self.index[i][3], b""
        for _ in range(n):
            shared, other, size = ENTRY.unpack_from(content, at)
            at += ENTRY.size
            last = last[:shared] + content[at : at + other]
            at += other
            yield last, np.frombuffer(content, self.dtype, size // self.id_bytes, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(self.blocks):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        at = _probes([key], self.bloom_bytes * 8)[0].astype(np.int64)
        return bool(((self.bloom[at >> 3] >> (7 - (at & 7))) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with that key; documents may repeat."""
        key, found = pack_key(doc_id), []
        if not self.may_hold(key):
            return found
        for i in range(bisect_left(self.index, (key,)), self.blocks):
            for k, ids in self.block(i):
                if k > key:
                    return found
                if k == key:
                    found.append(ids)
        return found


class SeekingShard(Shard):
    """A shard that fetches footer, index and filter, and single blocks by ``read(offset, bytes)``."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        tail = read(size - FOOTER.size - 1, FOOTER.size + 1)
        tail = tail[:-1] if tail[-9:-1] == MAGIC else tail[1:]
        (self.index_at, self.blocks, self.bloom_at, self.bloom_bytes, self.entries, self.n_ids, self.id_bytes, self.first, self.crc, magic) = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a whole shard file")
        self.read, self.dtype = read, np.dtype(f"<u{self.id_bytes}")

    @cached_property
    def both(self) -> bytes:
        found = self.read(self.index_at, self.bloom_at + self.bloom_bytes - self.index_at)
        if zlib.crc32(found) != self.crc:
            raise ValueError("not a whole shard file")
        return found

    @cached_property
    def index(self) -> list[tuple]:
        return [INDEX.unpack_from(self.both, i * INDEX.size) for i in range(self.blocks)]

    @cached_property
    def bloom(self) -> np.ndarray:
        return np.frombuffer(self.both, np.uint8, self.bloom_bytes, self.bloom_at - self.index_at)

    def stored(self, i: int) -> tuple[bytes, int]:
        return self.read(*self.index[i][1:3]), 0


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs(doc_id, text)`` and write shard files under ``path``, in ascending doc_id order over file names.

    Null text counts as empty, so that document holds the end id alone. A null doc_id sorts first; repeated ids keep one
    entry a row. Further columns are ignored. An empty table writes no shard. One shuffle: the texts by id range; a task
    holds one slice of texts and one shard of ``shard_bytes``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer = encoder(tokenizer), None

        def row(w: ShardWriter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary())], ["shard"])

        for part in gathered(batches, "text", 8 << 20):
            ids, offsets = enc.encode(part.column(1))
            ends = np.insert(ids, offsets[1:], np.asarray(end_id, ids.dtype))
            offsets = offsets + np.arange(len(offsets))
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                writer = writer or ShardWriter(ids.dtype.itemsize)
                writer.add(pack_key(doc_id), ends[offsets[k] : offsets[k + 1]])
                if writer.bytes_so_far() >= shard_bytes:
                    yield row(writer)
                    writer = None
        if writer:
            yield row(writer)

    ordered = rows.repartitionByRange(partitions_for(rows), "doc_id").sortWithinPartitions("doc_id")
    made = ordered.mapInArrow(shards, "shard binary")
    made.select(F.expr("cast(shard as string)").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry: doc_id, shard (file name), row (place in the shard), before (ids before it in the shard),
    n_tokens, ids_crc32 of the ids as little-endian u32, and the ids' bytes as stored."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before, out = 0, []
                for n, (key, ids) in enumerate(Shard(content.as_py())):
                    out.append((unpack_key(key), name, n, before, len(ids), zlib.crc32(ids.astype("<u4")), ids.tobytes()))
                    before += len(ids)
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["doc_id", "shard", "row", "before", "n_tokens", "ids_crc32", "ids"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")
    return files.mapInArrow(entries, "doc_id long, shard string, row long, before long, n_tokens long, ids_crc32 long, ids binary")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Point lookups of a stated list of ids: doc_id and ids (array of long), a row per entry found."""
    if len(doc_ids) > 100_000:
        raise ValueError("lookup takes at most 100000 ids; join read_shards() beyond that")
    wanted = sorted(set(doc_ids))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                hits = [(i, ids.tolist()) for i in wanted for ids in shard.get(i)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(found, "doc_id long, ids array<long>")


def seek(spark: SparkSession, path: str, doc_ids: list[int | None]) -> list[tuple[int | None, np.ndarray]]:
    """Point lookups of a few ids from the driver, without a job: (doc_id, ids) by entry, in the order asked.

    Files follow each other by id, so each id bisects them by the first key in their footers, then asks that file's Bloom
    filter, bisects its index and fetches the blocks that may hold it, through Hadoop's file system. Nothing else is read;
    an id that is not there gives no entry. :func:`lookup` serves long lists.
    """
    java = spark._jvm
    folder = java.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(tuple(map(int, m.groups())), f) for f in system.listStatus(folder) if f.getLen() and (m := re.search(r"part-(\d+)-.*-c(\d+)", f.getPath().getName()))]
    files = [f for _, f in sorted(files, key=lambda x: x[0])]

    def reader(f) -> Callable[[int, int], bytes]:
        def read(at: int, size: int) -> bytes:
            stream = system.open(f.getPath())
            try:
                stream.seek(at)
                return bytes(java.org.apache.commons.io.IOUtils.toByteArray(stream, size))
            finally:
                stream.close()

        return read

    opened: dict[int, SeekingShard] = {}

    def shard(i: int) -> SeekingShard:
        if i not in opened:
            opened[i] = SeekingShard(reader(files[i]), files[i].getLen())
        return opened[i]

    out = []
    for doc_id in doc_ids:
        key = pack_key(doc_id)
        i = bisect_right(range(len(files)), key, key=lambda j: shard(j).first) - 1
        runs = []
        while i >= 0:  # an id's entries may begin in an earlier file only where this one starts with it
            runs.append(shard(i).get(doc_id))
            i = i - 1 if shard(i).first == key else -1
        out += [(doc_id, ids) for run in reversed(runs) for ids in run]
    return out


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    Shards follow each other by the numbers of partition and file in their names, so a start is the ids of earlier shards
    plus those before it in its own. The one global window runs over a row per shard file.
    """
    rows = materialise(read_shards(spark, path).drop("ids"), "sstable-digest")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    place = [F.regexp_extract("shard", r"part-(\d+)-.*-c(\d+)", g).cast("long") for g in (1, 2)]
    starts = totals.select("shard", (F.sum("total").over(Window.orderBy(*place)) - F.col("total")).alias("base"))
    return rows.join(starts, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")
