"""Pieces every operator of this subpackage shares: staging tables, doc_id ranges, batches cut by bytes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch at most, a single row apart.
BATCH_LIMIT = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder; on a cluster it is an error, since executors would not
    see each other's tables.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of staged tables that are still there, with their sessions.
_held: dict[str, SparkSession] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and Spark knows the table's true size.

    The table goes with discard(), at the end of scratch(), or when the interpreter ends.  Shuffle files of the plan go as
    soon as the table is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioscope/{name}-{uuid.uuid4().hex}"
    cleaned = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, cleaned)
    _held[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads; frames that aren't staged themselves are left alone."""
    for table in tables:
        delete(getattr(table, "_staged_at", None))


def delete(path: str | None) -> None:
    """Delete a folder that staged() or a pipeline wrote."""
    spark = _held.pop(path, None)
    if spark is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Everything staged inside is deleted at the end, but for staged tables that are put on the list."""
    before, kept = set(_held), []
    try:
        yield kept
    finally:
        for path in set(_held) - before - {table._staged_at for table in kept}:
            delete(path)


def hold(spark: SparkSession, path: str) -> str:
    """Have a folder deleted like a staged table."""
    _held[path] = spark
    return path


@atexit.register
def _end() -> None:
    for path in list(_held):
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            delete(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Ranges:
    """Ranges of about equally many rows by an integer column, nulls first; a value that holds many rows is split by a second key.

    bounds: ascending cuts; a value is in range r if r cuts are below it.  subs: into how many parts range r is split (a range with
    more than one holds a single value), nulls: the null rows.  Numbers of parts follow the order of (value, tie).
    """

    def __init__(self, ids: DataFrame, column: str, pieces: int):
        """From two narrow scans; the driver gets the cuts, which are quantiles within a tenth of a piece (of up to 10,000 pieces)."""
        total, nulls = ids.agg(F.count("*"), F.count_if(F.col(column).isNull())).first()
        self.nulls = max(1, -(-pieces * nulls // max(1, total)))
        cuts: list[int] = []
        if pieces > 1 and total > nulls:
            at = [i / pieces for i in range(1, pieces)]
            cuts = [int(x) for x in ids.where(F.col(column).isNotNull()).stat.approxQuantile(column, at, min(0.002, max(1e-5, 0.1 / pieces))) or []]
        times = Counter(cuts)
        self.bounds = sorted({*cuts, *(b - 1 for b, n in times.items() if n > 1)})
        self.subs = [max(1, times[b]) for b in self.bounds] + [1]

    def __len__(self) -> int:
        return self.nulls + sum(self.subs)

    def number(self, column: Column, tie: Column) -> Column:
        """Number of a row's part; tie: 0 to 2^31 - 1, about uniform, equal for rows that are equal."""
        part = lambda k: F.shiftright(tie.cast("long") * k, 31)
        number = range_of(column, self.bounds)
        if max(self.subs) > 1:
            first = np.cumsum([0, *self.subs[:-1]]).tolist()
            number = F.element_at(longs(first), number + 1) + part(F.element_at(longs(self.subs), number + 1))
        null = part(F.lit(self.nulls)) if self.nulls > 1 else F.lit(0)
        return F.when(column.isNull(), null).otherwise(number + self.nulls).cast("int")

    @property
    def split(self) -> bool:
        """Whether numbers depend on the second key."""
        return self.nulls > 1 or max(self.subs) > 1


def tie_of(text: Column) -> Column:
    """31 bits of a hash of a text, null as empty."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 31) - 1))


def longs(values: list[int]) -> Column:
    """An array as one literal, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(column: Column, bounds: list[int]) -> Column:
    """How many cuts are below a value; null: 0.  Many cuts are looked through in two levels."""
    if not bounds:
        return F.lit(0)
    if len(bounds) <= 64:
        number = sum((F.when(column > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    else:
        step = int(len(bounds) ** 0.5) + 1
        below = lambda cuts: F.size(F.filter(cuts, lambda b: b < column))
        whole = below(longs(bounds[step - 1 :: step])) * step
        number = whole + below(F.slice(longs(bounds), whole + 1, F.lit(step)))
    return F.when(column.isNull(), 0).otherwise(number).cast("int")


def dealt(df: DataFrame, number: str, pieces: int) -> DataFrame:
    """One partition for each value 0 .. pieces - 1 of an int column."""
    return df.repartitionById(max(1, pieces), F.col(number))


_calls = [0]


def now_and_then() -> None:
    """trim() at every 64th call, for functions that get many small groups."""
    _calls[0] += 1
    if _calls[0] % 64 == 0:
        trim()


def text_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins and the last ends; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return body, offsets - first


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about `limit` bytes of text, whole rows always."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
        trim()


def trim() -> None:
    """Give free memory back to the system, so that a worker waiting for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches between Spark and Python to BATCH_LIMIT bytes, where no smaller limit is set."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-") or 0)
    if now <= 0 or now > BATCH_LIMIT:
        spark.conf.set(key, str(BATCH_LIMIT))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to the given types and nothing else, so that extra columns can't clash; batches of them are bounded."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns.items()])
