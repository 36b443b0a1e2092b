"""Packing: first-fit decreasing over randomised groups of documents, with a tournament tree of bin capacities."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, only, steps
from .encoding import encoder
from .op1_tokens import BATCH_BYTES

LENGTH = 2048
END_ID = 1
#: Bytes of text whose pieces make one group on average: some thousands of documents.
GROUP_BYTES = 16 << 20
#: One document in so many is cut into small powers of two, to fill what first fit leaves open.
FILLER_EVERY = 8
FILLER_MOST = 256

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(tokens: int, length: int, filler: bool) -> list[int]:
    """Lengths of a document's pieces: full sequences first, then the rest whole, or in powers of two for a filler."""
    full, rest = divmod(tokens, length)
    pieces = [length] * full
    if not filler:
        return pieces + [rest] * bool(rest)
    largest = min(FILLER_MOST, length)
    pieces += [largest] * (rest // largest)
    rest %= largest
    bit = largest
    while rest:
        if rest >= bit:
            pieces.append(bit)
            rest -= bit
        bit //= 2
    return pieces


def pieces_of(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Every document's pieces: doc_id, start, length, ids_crc32, doc_tokens, salt.  One pass over the text; the ids stay in the worker.

    salt tells equal documents apart: the input partition, and how many equal ones came before in it.  Tasks that run
    again give the same rows, in whatever order they read theirs.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen, task = encoder(tokenizer), Counter(), TaskContext.get().partitionId()
        for part in steps(batches, limit=BATCH_BYTES):
            ids, bounds = tool.encode(part["text"])
            doc, start, size, crc, total, salt = [], [], [], [], [], []
            for i, key in enumerate(part["doc_id"].to_pylist()):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4").tobytes()
                n, at = len(own) // 4, 0
                seen[same := (key, n, zlib.crc32(own))] += 1
                for k in cut(n, length, zlib.crc32(own) % FILLER_EVERY == 0):
                    salt.append((task << 32) + seen[same])
                    doc.append(key)
                    start.append(at)
                    size.append(k)
                    crc.append(zlib.crc32(own[4 * at : 4 * (at + k)]))
                    total.append(n)
                    at += k
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, size, crc, total, salt)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return only(docs, doc_id="long", text="string").mapInArrow(encode, PIECES + ", salt long")


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items given longest first: each goes to the earliest bin with room.

    A tournament tree holds the largest free room below each node; going down to the left wherever the left has
    room finds the earliest such bin in log steps.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i] = node - leaves
        offsets[i] = capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most `length` ids: one row for each piece, with its place.

    Full sequences are cut off the front of long documents.  Each piece goes to one of the groups by a hash of its
    document's id, the piece's place and ids, and what tells equal documents apart; each group is packed alone by first-fit
    decreasing, so no task sees more than about a group's share, whatever one source, one document or rows that
    repeat hold.  Fillers (a random eighth of the
    documents) have their rest cut into powers of two of at most FILLER_MOST, which close the gaps.
    Null and empty texts: the end id alone.  Null doc_ids stay null.  Repeated rows are packed each for itself.
    An empty table gives no rows; other columns are ignored.  Sequence ids: group number * 2^32 + number in group.
    """
    table = only(docs, doc_id="long", text="string")
    total = table.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    groups = max(1, -(-int(total) // group_bytes))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "salt"), F.lit(groups)).cast("int")
    grouped = pieces_of(table, tokenizer, length, end_id).withColumn("group_id", key).drop("salt")

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        rows["sequence_id"], rows["offset"] = first_fit(rows["length"].to_numpy(), length)
        rows["sequence_id"] += int(key[0]) << 32
        return rows.drop(columns="group_id")

    return grouped.groupBy("group_id").applyInPandas(fill, PIECES + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
