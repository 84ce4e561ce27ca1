"""Token ids in a binary format: frequency ranks, byte-aligned, with separate control bytes (Stream VByte).

Ids are replaced by their rank in the corpus (0 for the most frequent), so that most take one byte. Of four values each, a
control byte holds the lengths (two bits each); the data bytes stand apart. Decoding looks the control byte up in a table
of byte positions. A block holds whole documents; files hold blocks in ascending order of the key.

Steps: (1) encode every text once into a stored table; (2) count ids per partition and sum them: the only thing sent to the
driver is a count per vocabulary entry; (3) range-partition the stored ids by key, sort, write blocks with Spark's
committing writer; (4) read the files back. Lost executors repeat only their tasks.

A folder is complete by itself: blocks are in `blocks`, and `header`, one small row, has the format's version, the end id, the
vocabulary's name and size and the id of each rank. read_files() and read_ids() take a path and nothing else.

Nulls: a null text is an empty one and holds the end id only; a null key sorts first. Repeated keys and rows stay, each with
its tokens, beside each other, in the order of a hash of their ids. Very long texts are a block of their own. An empty table
gives no row. Other columns may have any name.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, map_batches, shared_dir, small_batches, stored, text_of
from .pieces import PIECES, PieceEncoder, encoder

END_ID = 0
BLOCK_TOKENS = 1 << 18

# A control byte holds four lengths less one, the first in the lowest bits.
_CODES = np.array([[(c >> (2 * k)) & 3 for k in range(4)] for c in range(256)], np.int64)
_LENGTHS = (_CODES + 1).sum(axis=1)
#: Of each control byte, where the 16 bytes of four 32-bit values stand after the group's start, and which of them count.
_PLACES = np.zeros((256, 16), np.int32)
_COUNT = np.zeros((256, 16), np.uint8)
for _c in range(256):
    _at = 0
    for _k in range(4):
        for _b in range(_CODES[_c, _k] + 1):
            _PLACES[_c, 4 * _k + _b] = _at
            _COUNT[_c, 4 * _k + _b] = 0xFF
            _at += 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit unsigned values."""
    v = np.zeros(-(-len(values) // 4) * 4, "<u4")
    v[: len(values)] = values
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    c = code.reshape(-1, 4)
    control = c[:, 0] | (c[:, 1] << 2) | (c[:, 2] << 4) | (c[:, 3] << 6)
    keep = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n values."""
    c = np.frombuffer(control, np.uint8)
    if not len(c):
        return np.empty(0, np.uint32)
    sizes = _LENGTHS[c]
    starts = (np.cumsum(sizes) - sizes).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[:, None] + _PLACES[c]]
    raw &= _COUNT[c]
    return raw.reshape(-1).view("<u4")[:n]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, pieces: int = PIECES) -> DataFrame:
    """key, n_tokens and the compressed ids of each whole text, with the end id. pieces: see encoder()."""

    def run(b: dict) -> dict:
        e = encoder(path, pieces)
        end = np.array([end_id], e.dtype).tobytes()
        press = zstandard.ZstdCompressor(level=1)
        raw = [e.ids(x) + end for x in b["__text"].to_pylist()]
        return {"key": b["__key"], "n_tokens": [len(r) // e.dtype.itemsize for r in raw], "ids": [press.compress(r) for r in raw]}

    return map_batches(docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text")), run, "key long, n_tokens int, ids binary")


_press = zstandard.ZstdDecompressor()


def _inflate(blob: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(_press.decompress(blob), dtype)


def frequency_ranks(encoded: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """ids in the order of falling frequency over the whole corpus, then of id; unseen ids follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            for at in range(0, len(blobs), 64):  # a count takes as long as the vocabulary is large
                total += np.bincount(np.concatenate([_inflate(x, dtype) for x in blobs[at : at + 64]]), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    small_batches(encoded.sparkSession)
    sums = encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(size, np.int64)
    count[sums["id"].to_numpy()] = sums["n"].to_numpy()
    return np.argsort(-count, kind="stable").astype(np.uint32)


def write_blocks(encoded: DataFrame, by_rank: np.ndarray, dtype: np.dtype, folder: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write blocks in ascending order of the key: part and block number them, over all files."""
    spark = encoded.sparkSession
    rank_of = np.empty_like(by_rank)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, keys, counts, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            control, data = pack(shared.value[np.concatenate(parts)])
            arrays = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "keys", "counts", "control", "data"])

        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _inflate(blob, dtype)
                keys.append(k)
                counts.append(len(ids))
                parts.append(ids)
                held += len(ids)
                if held >= block_tokens:
                    yield flush()
                    block, keys, counts, parts, held = block + 1, [], [], [], 0
        if keys:
            yield flush()

    # rows of one key stand in the order of their ids' hash, so that retries write the same, and can go to several files
    ordered = encoded.select("key", "ids", F.xxhash64("ids").alias("tie")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    ordered.select("key", "ids").mapInArrow(run, "part int, block int, keys array<long>, counts array<int>, control binary, data binary").write.option("compression", "zstd").parquet(f"{folder}/blocks")


VERSION = 1
_BLOCKS = "part int, block int, keys array<long>, counts array<int>, control binary, data binary"
_HEADER = "version int, end_id int, vocabulary string, size int, ids binary"


def write_header(spark: SparkSession, by_rank: np.ndarray, vocabulary: str, folder: str, end_id: int = END_ID) -> None:
    """What decoding needs beside the blocks; as large as the vocabulary."""
    row = (VERSION, end_id, vocabulary, len(by_rank), by_rank.astype("<u4").tobytes())
    spark.createDataFrame([row], _HEADER).coalesce(1).write.parquet(f"{folder}/header")


def open_files(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray, int]:
    """Blocks, the id of each rank and the end id of a folder."""
    head = spark.read.schema(_HEADER).parquet(f"{folder}/header").first()
    if head.version != VERSION:
        raise ValueError(f"token files of version {head.version} can't be read")
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks"), np.frombuffer(bytes(head.ids), "<u4"), head.end_id


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """key and ids (with the end id) of each document."""
    blocks, by_rank, _ = open_files(spark, folder)
    shared = spark.sparkContext.broadcast(by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = shared.value[unpack(r["control"], r["data"], sum(r["counts"]))].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r["keys"], pa.int64()), pa.array(np.split(ids, np.cumsum(r["counts"])[:-1]), pa.list_(pa.int64()))], names=["key", "ids"])

    small_batches(spark)
    return blocks.mapInArrow(run, "key long, ids array<long>")


def read_blocks(blocks: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """part, block, place, key, n_tokens and the ids' checksum of each document, decoded from the files."""
    shared = blocks.sparkSession.sparkContext.broadcast(by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = shared.value[unpack(r["control"], r["data"], sum(r["counts"]))].astype("<u4")
                ends = np.cumsum(r["counts"])
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(r["counts"], ends, strict=True)]
                m = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * m, pa.int32()), pa.array([r["block"]] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(r["keys"], pa.int64()), pa.array(r["counts"], pa.int64()), pa.array(crc, pa.int64())], names=["part", "block", "place", "key", "n_tokens", "ids_crc32"])

    spark = blocks.sparkSession
    small_batches(spark)
    return blocks.mapInArrow(run, "part int, block int, place int, key long, n_tokens long, ids_crc32 long")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document of a folder.

    start is the number of ids of all documents before it. Parts are summed first, so that the running sum over all parts
    has one row for each written part and the others run within a part.
    """
    blocks, by_rank, _ = open_files(spark, folder)
    rows = read_blocks(blocks, by_rank)
    totals = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    # one row for each written file: bounded by the number of tasks
    return placed.join(F.broadcast(offsets), "part").select("key", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", folder: str | None = None, pieces: int = PIECES) -> DataFrame:
    """Encode docs, write the files and read them back, by their folder alone: see read_files()."""
    spark = docs.sparkSession
    own: PieceEncoder = encoder(path)
    encoded = stored(encode(docs, path, key, text, pieces=pieces), "token-ids", compression="none")
    by_rank = frequency_ranks(encoded, own.size, own.dtype)
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_blocks(encoded, by_rank, own.dtype, folder)
    write_header(spark, by_rank, path.rpartition("/")[2], folder)
    drop_stored(encoded)
    return read_files(spark, folder).withColumnRenamed("key", key)
