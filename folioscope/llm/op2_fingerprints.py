"""Document fingerprints: MinHash by many universal hash permutations, with banded search and exact check."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Ranges, dealt, documents, only, partitions, scratch, staged, steps, tie_of
from .linking import BROADCAST_IDS, bands, classified
from .shingles import mixed, set_hash, shingles

PERMUTATIONS = 128
SHINGLE = 5

_DRAW = np.random.Generator(np.random.PCG64(2_718_281))
_A = _DRAW.integers(1 << 31, size=(PERMUTATIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _DRAW.integers(1 << 32, size=(PERMUTATIONS, 1), dtype=np.uint32)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """Smallest values of a x + b mod 2^32 (a odd: a permutation) over the shingles, for each of PERMUTATIONS; none: all ones."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (_A * x[at : at + 2048] + _B).min(axis=1), out=out)
    return out


def prints(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """One row of PERMUTATIONS values of 16 bits for each text: the low halves of its minima."""
    h, bounds = shingles(texts, size)
    rows = [minhash(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    return (np.asarray(rows, np.uint32).reshape(-1, PERMUTATIONS) & np.uint32(0xFFFF)).astype("<u2")


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal values: the estimate of the Jaccard likeness."""
    return float(np.mean(one == other))


def as_text(row: np.ndarray) -> str:
    return base64.b64encode(row.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as much of the beginning of `following`."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def signatures(docs: DataFrame, size: int, count: int, rows: int) -> DataFrame:
    """Of docs(node, text): node, n_shingles, content (hash of the whole set; null: empty set), count band keys of so many values, and a bit of each value in w0, w1."""
    words = [f"w{i}" for i in range(PERMUTATIONS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = np.random.Generator(np.random.PCG64(5)).integers(1 << 63, size=(count, rows), dtype=np.uint64) | np.uint64(1)
        for part in steps(batches):
            h, bounds = shingles(part["text"], size)
            own = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            values = np.asarray([minhash(x) for x in own], np.uint32).reshape(-1, PERMUTATIONS)
            wide = mixed(values[:, : count * rows].astype(np.uint64) + np.uint64(1)).reshape(-1, count, rows)
            keys = mixed((wide * seeds).sum(axis=2, dtype=np.uint64) + np.arange(count, dtype=np.uint64)).view(np.int64)
            sketch = np.packbits(values & 1 > 0, axis=1).view(np.int64).reshape(-1, len(words))
            content = [set_hash(x) if len(x) else None for x in own]
            lists = [k if len(x) else None for k, x in zip(keys, own)]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array([len(x) for x in own], pa.int64()), pa.array(content, pa.binary()), pa.array(lists, pa.list_(pa.int64())), *[pa.array(c) for c in sketch.T]], ["node", "n_shingles", "content", "keys", *words])

    return docs.mapInArrow(run, "node long, n_shingles long, content binary, keys array<long>" + "".join(f", {w} long" for w in words))


def near_classes(docs: DataFrame, size: int = SHINGLE, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id of every row of docs(doc_id, text): the smallest doc_id in reach by links of that likeness.

    Signature bands (as many as miss a pair at the threshold with at most 1e-6, see bands) are joined in Spark; the
    Jaccard likeness of full shingle sets decides.  Rows with a null doc_id, and texts without words, are their own
    class.  Rows of one doc_id with unlike texts are documents of their own.  An empty table gives none.
    """
    return classified(docs, lambda table: signatures(table, size, *bands(part / whole, PERMUTATIONS)), size, part, whole).drop("own_text", "group_id")


def with_edits(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends with the beginning of the next document's.

    One shuffle: rows go to ranges of doc_id (null first, equal ids by a hash of their texts, then the text), and the first row of
    each range goes to the range before it as well, as what comes next there; the first of all follows the last of all.
    Many rows of one id, or of none, are split into several ranges by that hash.  What is first in each range is a small
    table (a row for each range) that Spark makes and joins.  A task holds two texts and one step of them.
    Null texts count as empty.  A table of one row follows itself; an empty one gives none; other columns are ignored.
    Two empty fingerprints are alike (1.0).
    """
    table = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    ranges = Ranges(table, "doc_id", partitions(docs.sparkSession))
    tie = tie_of(F.col("text"))
    number = ranges.number(F.col("doc_id"), tie)
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", (tie if ranges.split else F.lit(0).cast("long")).alias("tie"))
    whole = Window.orderBy("bucket")
    heads = table.groupBy(number.alias("bucket")).agg(F.min(key).alias("head"))
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(whole), F.max("bucket").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    placed = table.select("doc_id", "text", number.alias("bucket"), tie.alias("tie"), key.alias("key"))
    firsts = placed.join(F.broadcast(staged(heads, "range-heads").select(F.col("bucket").alias("of"), "head", "before")), (F.col("bucket") == F.col("of")) & F.col("key").eqNullSafe(F.col("head")))
    firsts = firsts.groupBy("before", "doc_id").agg(F.min(F.struct("tie", "text")).alias("first")).select("doc_id", "first.text", F.col("before").alias("bucket"), "first.tie", F.lit(True).alias("next"))
    placed = placed.select("doc_id", "text", "bucket", "tie", F.lit(False).alias("next")).unionByName(firsts)
    ordered = dealt(placed, "bucket", len(ranges)).sortWithinPartitions("bucket", "next", F.col("doc_id").asc_nulls_first(), "tie", "text").select("doc_id", "text", "next")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, known, carried = [], [], None, 0

        def close() -> pa.RecordBatch:
            """Answers for all held rows but the last, which becomes the first held."""
            nonlocal keys, own, known, carried
            changed = [edited(a, b) for a, b in zip(own, own[1:])]
            fresh = prints(pa.array(own[1:] if known is not None else own, pa.large_string()), size)
            plain = fresh if known is None else np.concatenate([known[None], fresh])
            after = prints(pa.array(changed, pa.large_string()), size)
            n = len(changed)
            columns = [
                pa.array(keys[:n], pa.int64()), pa.array([len(x) for x in own[:n]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                pa.array([as_text(x) for x in plain[:n]], pa.string()), pa.array([as_text(x) for x in after], pa.string()),
                pa.array([likeness(plain[i], after[i]) for i in range(n)], pa.float64()), pa.array([likeness(plain[i], plain[i + 1]) for i in range(n)], pa.float64()),
            ]
            known, keys, own, carried = plain[-1], keys[-1:], own[-1:], 0
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for part in steps(batches):
            for key, text, following in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["next"].to_pylist()):
                keys.append(key)
                own.append(text)
                carried += len(text)
                if following:  # it ends its range and isn't answered here
                    yield close()
                    keys, own, known = [], [], None
                elif carried > 1 << 20 and len(own) > 1:
                    yield close()

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def with_classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """with_edits and class_id: the class among near copies of each row's doc_id (of several unlike texts under it, the smallest)."""
    with scratch() as kept:
        moved = near_classes(docs, size).where("class_id <> doc_id").groupBy(F.col("doc_id").alias("of")).agg(F.min("class_id").alias("class_id"))
        moved = staged(moved, "moved")
        kept.append(moved)
    few = moved.count() <= BROADCAST_IDS
    edits = with_edits(docs, size)
    return edits.join(F.broadcast(moved) if few else moved, F.col("doc_id") == F.col("of"), "left").select(*edits.columns, F.coalesce("class_id", "doc_id").alias("class_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(documents(spark, sf_dir))
