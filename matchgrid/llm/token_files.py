"""Token ids in fixed-width bit packing, with block offsets for vectorised unpacking and random access.

File format (little-endian), one file per shard of consecutive documents:

    8 bytes   b"MGTOK\\x01\\x00\\x00"
    4 x u64   width in bits, ids per block, number of ids, number of documents
    u64 x (blocks + 1)      byte offset of each block from the start of the payload, and the payload's length
    i64 x documents         doc_id (0 where null)
    u8  x documents         1 where doc_id is null
    u64 x (documents + 1)   index of each document's first id in the shard, and the number of ids
    payload                 blocks; each starts on a byte and holds its ids in `width` bits each, lowest bit first

Every block but the last holds the same number of ids, so the block of an id is a division and a read touches only the
blocks that it needs.

Writing: documents are range-partitioned by doc_id (ties by a hash of the text), each task tokenises its range in
order and writes its shards under names that its partition number gives, so a task that runs again writes the same
files. Shards go through pyarrow's file systems to the shared folder; Spark's binaryFile source reads them back.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchgrid.llm import storage, tokens

MAGIC = b"MGTOK\x01\x00\x00"
BLOCK = 4096
#: Ids after which a shard is closed at the next document's start; a shard is read as one value.
SHARD_IDS = 8_000_000
END_ID = 2


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in `width` bits each, lowest bit first, padded to a byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=None, bitorder="little").tobytes()


def unpack(data: bytes | memoryview, count: int, width: int) -> np.ndarray:
    """The first `count` ids of a packed block, as uint32."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def encode_shard(doc_ids: list[int | None], ids: list[np.ndarray], width: int, block: int = BLOCK) -> bytes:
    """One shard file's bytes."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.uint64)]).astype("<u8")
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    blocks = [pack(flat[k : k + block], width) for k in range(0, len(flat), block)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in blocks], dtype=np.uint64)]).astype("<u8")
    head = np.array([width, block, len(flat), len(doc_ids)], "<u8")
    keys = np.array([0 if x is None else x for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], "u1")
    return b"".join([MAGIC, head.tobytes(), offsets.tobytes(), keys.tobytes(), nulls.tobytes(), starts.tobytes(), *blocks])


class Shard:
    """A shard file's contents; read() unpacks only the blocks that a range of ids touches."""

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.width, self.block, self.n_ids, self.n_docs = (int(x) for x in np.frombuffer(self.data, "<u8", 4, 8))
        at, blocks = 40, -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at)
        at += 8 * (blocks + 1)
        keys = np.frombuffer(self.data, "<i8", self.n_docs, at)
        nulls = np.frombuffer(self.data, "u1", self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if n else int(k) for k, n in zip(keys, nulls, strict=True)]
        at += 9 * self.n_docs
        self.starts = np.frombuffer(self.data[at : at + 8 * (self.n_docs + 1)].tobytes(), "<u8").astype(np.int64)
        self.payload = at + 8 * (self.n_docs + 1)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            a, b = self.payload + int(self.offsets[k]), self.payload + int(self.offsets[k + 1])
            parts.append(unpack(self.data[a:b], min(self.block, self.n_ids - k * self.block), self.width))
        flat = np.concatenate(parts)
        return flat[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_files(df: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise df's texts (null: empty), append end_id to each and write shards under path, in ascending doc_id order.

    Returns the manifest: one row per shard with its ordinal parts (task, piece), numbers of ids and documents.
    Null doc_ids come first; rows that repeat an id are ordered by a hash of their text. An empty table writes no shard.
    """
    width = bits_for(tokens.vocabulary_size(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        ids_of, task, piece = tokens.byte_encoder(vocabulary_path), TaskContext.get().partitionId(), 0
        to, root = fs.FileSystem.from_uri(path)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            name = f"{root}/shard-{task:07d}-{piece:05d}.tok"
            part = f"{root}/_part-{uuid.uuid4().hex}"
            with to.open_output_stream(part) as f:
                f.write(encode_shard(keys, ids, width))
            to.move(part, name)
            return pa.RecordBatch.from_pydict({"task": [task], "piece": [piece], "n_ids": [size], "n_docs": [len(keys)]}, schema)

        schema = pa.schema([("task", pa.int64()), ("piece", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])
        to.create_dir(root, recursive=True)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size >= SHARD_IDS:
                    yield close()
                    keys, ids, size, piece = [], [], 0, piece + 1
                keys.append(key)
                ids.append(np.append(ids_of(text.as_py()), np.uint32(end_id)))
                size += len(ids[-1])
        if keys:
            yield close()

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    tie = F.xxhash64("_text")
    ordered = rows.repartitionByRange(F.col("_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("_id").asc_nulls_first(), tie)
    manifest = ordered.mapInArrow(run, "task long, piece long, n_ids long, n_docs long")
    return storage.written(manifest, "token-manifest")


def read_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, shard, doc_in_shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_buffer())
                task, piece = (int(x) for x in name.rsplit("shard-", 1)[1].removesuffix(".tok").split("-"))
                n = np.diff(shard.starts)
                crc = [zlib.crc32(shard.document(k).astype("<u4").tobytes()) for k in range(shard.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(shard.n_docs, task)),
                        pa.array(np.full(shard.n_docs, piece)),
                        pa.array(np.arange(shard.n_docs)),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(shard.starts[:-1]),
                        pa.array(n),
                        pa.array(crc, pa.int64()),
                    ],
                    ["task", "piece", "doc_in_shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("task", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("task", "piece", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("shard_start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select("path", "content")
    docs = files.mapInArrow(run, "task long, piece long, doc_in_shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["task", "piece"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = storage.new_path(spark, "token-files")
    manifest = write_files(docs, path, tokens.default_path())
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(spark, path, manifest)
