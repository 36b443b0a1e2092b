"""Postings of character trigrams: which notes could hold a keyword, without looking at their bodies.

Every trigram of the folded title, body and location points to the numbers of the notes that hold it.  Numbers ascend
in a list and are packed as deltas in the task that makes it, so no shuffle or sort holds them as longs; lists are cut by segment (what one task has read), spread over BUCKETS
folders by gram and sorted by gram in each, so a keyword reads a few row groups of a few folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.store import bounded_batches, listed

BUCKETS = 31
#: Pairs of gram and note that are gathered in a task, about, before they are given on.
SEGMENT_CHARACTERS = 2 << 20
#: Characters whose grams are made at once, a longer text apart.
STEP_CHARACTERS = 1 << 19
#: Bytes of bodies whose lists one task writes, about.
TASK_BYTES = 256 << 20
#: Lists that are intersected: the rarest of a keyword's.
INTERSECTED = 4
SHAPE = "gram long, segment long, n long, notes binary"
#: Changes with SHAPE and with how notes are packed.
FORMAT = 2


def bucket(gram: Column | int) -> Column | int:
    return gram % BUCKETS if isinstance(gram, int) else (gram % BUCKETS).cast("int")


def of_keyword(keyword: str) -> list[int]:
    """The different trigrams of a folded keyword, as numbers: three code points of 21 bits."""
    c = [ord(x) for x in keyword]
    return sorted({c[i] << 42 | c[i + 1] << 21 | c[i + 2] for i in range(len(c) - 2)})


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram, number of text) of every place of every text; null has none."""
    own = [t or "" for t in texts.to_pylist()]
    c = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, own), np.int64, len(own))
    doc = np.repeat(np.arange(len(own)), size)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = doc[2:] == doc[:-2]
    return (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[whole], doc[:-2][whole]


def _steps(batch: pa.RecordBatch, fields: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about STEP_CHARACTERS, whole rows always."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for field in fields:
        sizes += pc.fill_null(pc.utf8_length(batch[field]), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(ends, ends[begin] + STEP_CHARACTERS))
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def pack(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of ascending numbers from 0 on, list i from ends[i] to ends[i + 1], each as bytes: differences in groups of seven bits, low ones first, the top bit where more follow."""
    step = np.diff(numbers, prepend=0)
    step[ends[:-1]] = numbers[ends[:-1]]
    size = np.ones(len(step), np.int64)
    for bits in range(7, 63, 7):
        size += step >> bits > 0
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        some = size > k
        out[at[:-1][some] + k] = step[some] >> 7 * k & 127 | np.where(size[some] > k + 1, 128, 0)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at[ends].astype(np.int32)), pa.py_buffer(out)])


def unpack(lists: pa.Array) -> pa.Array:
    """The lists of numbers that pack() was given."""
    whole = [x.as_buffer() for x in lists]
    data = np.frombuffer(b"".join(whole), np.uint8)
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    step = np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin) if len(begin) else np.zeros(0, np.int64)
    ends = np.searchsorted(begin, np.cumsum([0, *(len(x) for x in whole)]))
    total = np.concatenate([[0], np.cumsum(step)])
    numbers = total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(numbers))


def postings(notes: DataFrame, fields: tuple[str, ...], number: str = "n") -> DataFrame:
    """gram, segment, n (length of the list), notes (ascending numbers, packed) of notes(number, *fields), folded with lower()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            gram, note = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((note, gram))
            gram, note = gram[order], note[order]
            fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (note[1:] != note[:-1])])
            gram, note = gram[fresh], note[fresh]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            ends = np.append(first, len(gram))
            for a in range(0, len(first), 8192):
                b = min(a + 8192, len(first))
                lists = pack(note[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
                yield pa.RecordBatch.from_arrays([pa.array(gram[first[a:b]]), pa.array(np.full(b - a, (task << 24) + count)), pa.array(np.diff(ends[a : b + 1])), lists], ["gram", "segment", "n", "notes"])

        for batch in batches:
            for rows in _steps(batch, fields):
                numbers = rows[number].to_numpy()
                for field in fields:
                    gram, doc = _grams(rows[field])
                    pair, place = np.unique(gram, return_inverse=True)
                    at = np.unique(place * np.int64(len(numbers)) + doc)
                    held.append((pair[at // len(numbers)], numbers[at % len(numbers)]))
                    size += len(at)
                if size >= SEGMENT_CHARACTERS:
                    yield from close()
                    held, size, count = [], 0, count + 1
        if held:
            yield from close()

    bounded_batches(notes.sparkSession)
    folded = notes.select(F.col(number).cast("long").alias(number), *[F.lower(f).alias(f) for f in fields])
    return folded.mapInArrow(run, SHAPE)


def write(lists: DataFrame, path: str, spread: int = 1) -> None:
    """Postings as a table: a folder for each bucket, sorted by gram.

    Each bucket is written by `spread` tasks, which share its segments; so no gram, however frequent, is one task's alone.
    """
    own = lists.withColumn("bucket", bucket(F.col("gram")))
    dealt = own.repartition("bucket") if spread == 1 else own.repartition(BUCKETS * spread, "bucket", F.pmod(F.xxhash64("segment"), F.lit(spread)))
    own = dealt.sortWithinPartitions("bucket", "gram", "segment")
    own.write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(8 << 20)).partitionBy("bucket").parquet(path)


def asked(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """The lists of a folded keyword's grams in written postings; only their folders and row groups are read."""
    own = of_keyword(keyword)
    there = {name for name, _, _ in listed(spark, path)}
    folders = [f"{path}/{name}" for name in sorted({f"bucket={bucket(g)}" for g in own}) if name in there]
    if not folders:
        return spark.createDataFrame([], SHAPE)
    return spark.read.schema(SHAPE).parquet(*folders).where(F.col("gram").isin(own))


def candidates(spark: SparkSession, path: str, keyword: str) -> tuple[DataFrame, int] | None:
    """n of the notes whose lists all hold it, of the INTERSECTED rarest grams of a folded keyword of three characters or more; and a bound of their number.

    Lists are intersected segment by segment.  A note that has the keyword is always among them; one that has not can be, so
    what they hold is looked through afterwards.  None: some gram is nowhere, so no note has the keyword.
    """
    own = asked(spark, path, keyword)
    sizes = sorted((r["n"], r["gram"]) for r in own.groupBy("gram").agg(F.sum("n").alias("n")).collect())
    if len(sizes) < len(of_keyword(keyword)):
        return None
    rarest = [g for _, g in sizes[:INTERSECTED]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["segment"], unpack(batch["notes"])], ["segment", "notes"])

    lists = own.where(F.col("gram").isin(rarest)).select("segment", "notes").mapInArrow(run, "segment long, notes array<long>")
    together = lists.groupBy("segment").agg(F.collect_list("notes").alias("all")).where(F.size("all") == len(rarest))
    both = F.aggregate(F.slice("all", 2, len(rarest)), F.element_at("all", 1), lambda x, y: F.array_intersect(x, y))
    return together.select(F.explode(both).alias("n")), sizes[0][0]
