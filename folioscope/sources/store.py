"""Files through Hadoop's file systems: the folder that all executors share, listings, and files that appear whole or not at all."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a local master gets a temporary folder, and a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modified) of what is in a folder, by name; a file lists itself; nothing there: none."""
    target, fs = _open(spark, folder)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(target)) if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    target, fs = _open(spark, path)
    stream = fs.open(target)
    try:
        out = spark._jvm.java.io.ByteArrayOutputStream()
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65536)
        return bytes(out.toByteArray()).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A file with this text, which readers see whole; False where there is one of that name, which stays as it is."""
    target, fs = _open(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part)
    stream.write(text.encode())
    stream.close()
    fs_of = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(fs_of.Options.Rename, 0)
    try:
        fs_of.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(target), none)
        return True
    except Exception as error:
        if not fs.exists(target):
            raise error
        return False
    finally:
        if fs.exists(part):
            fs.delete(part, False)


def delete(spark: SparkSession, path: str) -> None:
    target, fs = _open(spark, path)
    fs.delete(target, True)


def source_key(spark: SparkSession, *paths: str) -> str:
    """A name for the state that these files are in: their paths, sizes and times."""
    return hashlib.sha256(repr([(p, listed(spark, p)) for p in paths]).encode()).hexdigest()[:24]


#: Bytes of an Arrow batch between Spark and Python at most, a single row apart.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES, where no smaller limit is set; without it ten thousand bodies are one batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in spark.conf.get(key) if c.isdigit() or c == "-") or 0)
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_bounded_batches(udf: Callable[..., Column]) -> Callable[..., Column]:
    """A UDF over whole texts that gets them in batches of BATCH_BYTES, whichever query uses it."""

    def call(*columns: str | Column) -> Column:
        bounded_batches(SparkSession.active())
        return udf(*columns)

    return call


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: they go when a write has ended, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
