"""Operator 9, token-ID output: bit-plane shuffling.

A file holds whole documents: their ids as fixed-size blocks, each block transposed into bit or byte
planes and each plane compressed with zstandard, and a chunk index with the place of every plane, so that
one block can be read alone. Files are rows of a Parquet table in the shared folder (the bytes in column
``file``), which any store that Spark reaches can hold.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import wordtok
from veilspark.llm.base import doc_id, keyed, partitions, record, stash

MAGIC = b"IDPL"
#: Ids in a block, ids in a file (it ends with the document that reaches them), the id appended to each document.
BLOCK, FILE_IDS, END_ID = 16_384, 1 << 18, 1
_HEAD = struct.Struct("<4sBBHIQQ")  # magic, version, 1 for bit planes, planes, ids in a block, documents, ids


def to_planes(block: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest first."""
    cells = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [x.tobytes() for x in np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1)]
    return [x.tobytes() for x in np.ascontiguousarray(cells.T)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    cells = np.stack([np.frombuffer(x, np.uint8) for x in planes])
    if bits:
        cells = np.packbits(np.unpackbits(cells, axis=1, count=n).T, axis=1, bitorder="little")
        return np.ascontiguousarray(cells).view("<u4").reshape(-1)
    return np.ascontiguousarray(cells.T).view("<u4").reshape(-1)


def write_file(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    pack = zstandard.ZstdCompressor(level=level).compress
    table = pack(doc_ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes())
    parts = [pack(p) for low in range(0, len(ids), BLOCK) for p in to_planes(ids[low : low + BLOCK], bits)]
    index = np.cumsum([0, *map(len, parts)]).astype("<u8").tobytes()
    head = _HEAD.pack(MAGIC, 1, bits, 32 if bits else 4, BLOCK, len(sizes), len(ids))
    return b"".join((head, struct.pack("<I", len(table)), table, index, *parts))


class File:
    """Reads the bytes that write_file made: doc_ids, sizes, block(i), ids()."""

    def __init__(self, data: bytes):
        magic, version, bits, self.planes, self.block_ids, docs, self.n = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a file of id planes")
        self.data, self.bits, self.unpack = data, bool(bits), zstandard.ZstdDecompressor().decompress
        (size,) = struct.unpack_from("<I", data, _HEAD.size)
        at = _HEAD.size + 4
        both = np.frombuffer(self.unpack(data[at : at + size]), "<i8")
        self.doc_ids, self.sizes = both[:docs], both[docs:]
        self.blocks = -(-self.n // self.block_ids)
        self.index = np.frombuffer(data, "<u8", self.blocks * self.planes + 1, at + size)
        self.base = at + size + self.index.nbytes

    def block(self, i: int) -> np.ndarray:
        at = (self.index[i * self.planes : (i + 1) * self.planes + 1].astype(np.int64) + self.base).tolist()
        return from_planes([self.unpack(self.data[a:b]) for a, b in zip(at, at[1:], strict=False)], min(self.block_ids, self.n - i * self.block_ids), self.bits)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint32)


_FILES = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("file", pa.binary())])


def write_ids(docs: DataFrame, path: str | None = None, bits: bool = False, end_id: int = END_ID) -> DataFrame:
    """Encodes whole texts, appends end_id to each and writes all ids in ascending doc_id order as files.

    Returns the stored table (shard, seq, n_ids, file); (shard, seq) is the order of the files. Rows of one
    doc_id follow one another by a hash of the text; an empty or null text is end_id alone."""
    path = path or wordtok.default_path()

    def files(batches):
        shard, seq, held, waiting = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids, keys, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            return record(_FILES, [shard], [seq], [len(ids)], [write_file(ids, keys, sizes, bits)])

        for batch in batches:
            texts, encoder = batch.column("text").to_pylist(), wordtok.shared_encoder(path)
            keys = np.asarray(batch.column("k"))
            for low, high in wordtok.groups(texts, 500_000):
                ids, ends = encoder.encode(texts[low:high])
                held.append((np.insert(ids, ends, end_id), keys[low:high], np.diff(ends, prepend=0) + 1))
                waiting += len(held[-1][0])
                if waiting >= FILE_IDS:
                    yield flush()
                    seq, held, waiting = seq + 1, [], 0
        if held:
            yield flush()

    k = keyed(docs)
    ordered = k.withColumn("t", F.xxhash64("text")).repartitionByRange(partitions(docs.sparkSession), "k", "t").sortWithinPartitions("k", "t").select("k", "text")
    return stash(ordered.mapInArrow(files, "shard int, seq int, n_ids long, file binary"))


_READ = pa.schema([("k", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def starts(files: DataFrame) -> DataFrame:
    """files with ``first``, the ids in all files before: running sums in each shard, and over the shards' totals."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    first = files.select("shard", "seq", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard").select("shard", "seq", (F.col("base") + F.col("inside")).alias("first"))
    return files.join(first, ["shard", "seq"])


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the stored files."""

    def rows(batches):
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("file").to_pylist(), strict=True):
                file = File(data)
                ids, ends = file.ids().astype("<u4"), np.cumsum(file.sizes)
                yield record(_READ, file.doc_ids, first + ends - file.sizes, file.sizes, [zlib.crc32(ids[a:b].data) for a, b in zip((ends - file.sizes).tolist(), ends.tolist(), strict=True)])

    return starts(files).select("first", "file").mapInArrow(rows, "k long, start long, n_tokens long, ids_crc32 long").select(doc_id(), "start", "n_tokens", "ids_crc32")
