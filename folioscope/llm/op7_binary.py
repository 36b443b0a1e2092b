"""Token-ID / binary output: patched frame-of-reference blocks in segments of whole documents.

A segment's payload is a little-endian byte string:

    magic  4s  b"PFR1"
    u32    number of blocks;  u64 number of ids
    blocks x u64   where each block starts, from the payload's beginning (the index)
    blocks, each:  u32 minimum, u16 number of ids, u8 width in bits, u16 number of exceptions,
                   the values less the minimum packed at that width (their low bits for exceptions),
                   exceptions: u16 place in the block and u32 value less the minimum, each as an array

Blocks hold BLOCK ids, the last of a segment fewer.  The width is that of the PERCENTILE-th value in size; larger
values are exceptions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Ranges, dealt, documents, only, partitions, staged, steps, tie_of, trim
from .encoding import encoder
from .op1_tokens import BATCH_BYTES

END_ID = 1
BLOCK = 1024
PERCENTILE = 90
#: A segment is closed by the document with which it reaches so many ids.
SEGMENT_IDS = 1 << 18

_HEAD, _BLOCK = struct.Struct("<4sIQ"), struct.Struct("<IHBH")
SEGMENTS = "bucket int, segment long, n long, doc_ids binary, doc_nulls binary, lengths binary, payload binary"


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    """A payload of any uint32 ids."""
    ids = np.asarray(ids, np.uint32)
    count = -(-len(ids) // block)
    parts, starts, at = [], [], _HEAD.size + 8 * count
    for b in range(count):
        own = ids[b * block : (b + 1) * block]
        low = own.min()
        rest = own - low
        ranked = np.partition(rest, k := min(len(rest) - 1, len(rest) * percentile // 100))
        width = int(ranked[k]).bit_length()
        out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        body = np.packbits(bits.reshape(-1), bitorder="little").tobytes() if width else b""
        part = _BLOCK.pack(int(low), len(own), width, len(out)) + body + out.astype("<u2").tobytes() + rest[out].astype("<u4").tobytes()
        starts.append(at)
        parts.append(part)
        at += len(part)
    return b"".join([_HEAD.pack(b"PFR1", count, len(ids)), np.asarray(starts, "<u8").tobytes(), *parts])


def decode_block(payload: bytes, number: int) -> np.ndarray:
    """The ids of one block, found by the index."""
    magic, count, _ = _HEAD.unpack_from(payload)
    if magic != b"PFR1" or not 0 <= number < count:
        raise ValueError("no such block in this payload")
    (at,) = struct.unpack_from("<Q", payload, _HEAD.size + 8 * number)
    low, n, width, outliers = _BLOCK.unpack_from(payload, at)
    at += _BLOCK.size
    packed = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, packed, at), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    rest = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint32)
    at += packed
    place = np.frombuffer(payload, "<u2", outliers, at)
    rest[place] = np.frombuffer(payload, "<u4", outliers, at + 2 * outliers)
    return rest + np.uint32(low)


def decode_blocks(payload: bytes) -> np.ndarray:
    """All ids of a payload."""
    _, count, total = _HEAD.unpack_from(payload)
    ids = np.concatenate([np.zeros(0, np.uint32), *[decode_block(payload, b) for b in range(count)]])
    if len(ids) != total:
        raise ValueError("a payload with missing ids")
    return ids


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, bucket, tie as given, ids: each document's ids with the end id, as little-endian bytes of two or four bytes an id (`wide`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        wide = tool.tokenizer.get_vocab_size() > 1 << 16
        for part in steps(batches, limit=BATCH_BYTES):
            ids, bounds = tool.encode(part["text"])
            own = [np.append(ids[a:b], np.uint32(end_id)).astype("<u4" if wide else "<u2").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["bucket"], part["tie"], pa.array(own, pa.binary()), pa.array([wide] * len(own))], ["doc_id", "bucket", "tie", "ids", "wide"])

    return docs.mapInArrow(run, "doc_id long, bucket int, tie long, ids binary, wide boolean")


def write_segments(docs: DataFrame, tokenizer: str, end_id: int = END_ID, name: str = "token-segments") -> DataFrame:
    """Write docs(doc_id, text) as segments in ascending doc_id order (nulls first, equal ids by a hash of their texts, then their token ids); the table of them.

    Range buckets of doc_id, cut at quantiles from a narrow scan, give the order without a global sort; many rows of one id, or of
    none, are split into several buckets by that hash.  Only token ids are shuffled, two bytes an id where the vocabulary allows.  A bucket's task writes whole documents into
    one segment after another; a table commit makes retried tasks harmless.
    """
    table = only(docs, doc_id="long", text="string")
    ranges, tie = Ranges(table, "doc_id", partitions(docs.sparkSession)), tie_of(F.col("text"))
    ids = encoded(table.select("doc_id", "text", ranges.number(F.col("doc_id"), tie).alias("bucket"), tie.alias("tie")), tokenizer, end_id)
    ordered = dealt(ids, "bucket", len(ranges)).sortWithinPartitions("bucket", "doc_id", "tie", "ids").drop("tie")

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size, number, bucket = [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            lengths = np.asarray([len(x) for x in held], "<i8")
            row = [bucket, number, int(lengths.sum()), np.asarray([k or 0 for k in keys], "<i8").tobytes(), np.asarray([k is None for k in keys], np.uint8).tobytes(), lengths.tobytes(), encode_blocks(np.concatenate(held))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], ["bucket", "segment", "n", "doc_ids", "doc_nulls", "lengths", "payload"])

        for batch in batches:
            for key, b, ids, wide in zip(batch["doc_id"].to_pylist(), batch["bucket"].to_pylist(), batch["ids"], batch["wide"].to_pylist()):
                if held and (b != bucket or size >= SEGMENT_IDS):
                    yield close()
                    number = number + 1 if b == bucket else 0
                    keys, held, size = [], [], 0
                bucket = b
                own = np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2").astype(np.uint32)
                keys.append(key)
                held.append(own)
                size += len(own)
        if held:
            yield close()

    return staged(ordered.mapInArrow(segment, SEGMENTS), name)


def _documents_of(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """doc_ids, where each document's ids begin (the end last), and all ids of one segment."""
    starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], "<i8"))])
    keys = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_nulls"], np.uint8).astype(bool))
    return keys, starts, decode_blocks(row["payload"]).astype("<u4")


def read_documents(segments: DataFrame) -> DataFrame:
    """bucket, segment, doc_id, first (ids before it in its segment), ids (uint32 bytes) of every document in the files."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, starts, ids = _documents_of(row)
                own = [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int64()), keys, pa.array(starts[:-1]), pa.array(own, pa.binary())], ["bucket", "segment", "doc_id", "first", "ids"])

    return segments.mapInArrow(decode, "bucket int, segment long, doc_id long, first long, ids binary")


def digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files.

    Where a document starts follows from the segments' column n, without their payloads.  The driver gets one number for each segment's bucket (as many as partitions), never one for each document.
    Empty texts have the end id alone; null doc_ids come first; an empty table gives none.
    """
    counts = segments.select("bucket", "segment", "n")
    base, before = {}, 0
    for bucket, n in sorted(counts.groupBy("bucket").agg(F.sum("n")).collect()):
        base[bucket] = before
        before += n
    spark = segments.sparkSession
    bases = spark.createDataFrame(sorted(base.items()), "bucket int, base long")
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("segment")) - F.col("n")
    starts = counts.withColumn("inside", inside).join(bases, "bucket").select("bucket", "segment", (F.col("base") + F.col("inside")).alias("base"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, at, ids = _documents_of(row)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int64()), keys, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["bucket", "segment", "doc_id", "first", "n_tokens", "ids_crc32"])
            trim()

    rows = segments.mapInArrow(digest, "bucket int, segment long, doc_id long, first long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["bucket", "segment"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(write_segments(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
