"""A folder tree listed by tasks, a level at a time: every file and folder, those that Spark's own listing leaves out too."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.packages import LEVELS
from folioscope.sources.store import shared_folder

SHAPE = "path string, folder boolean, bytes long, mtime long"
#: Folders that one task lists, about.
FOLDERS = 64
#: Fixed value: a file that no snapshot counts.
IGNORED = ".DS_Store"


def walk(spark: SparkSession, root: str, levels: int | None = None) -> DataFrame:
    """path (relative to root), folder, bytes (0 for folders), mtime (seconds) of everything below root, `levels` deep (all).

    The folders of one level are dealt to tasks, which list them; what they find is written to the shared folder and its
    folders are the next level, so nothing is listed twice and the driver sees a count for each level.  Links to folders are not
    followed, a folder that can't be listed or is gone has nothing below it, and a root that isn't there gives no rows.
    """
    base, out = f"{shared_folder(spark)}/folioscope-walk/{uuid.uuid4().hex}", []
    uri = root if "://" in root else f"file://{root}"

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder in batch["path"].to_pylist():
                at = posixpath.join(top, folder) if folder else top
                try:
                    found = [i for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.type != pafs.FileType.NotFound]
                except OSError:
                    continue
                rows = [(posixpath.join(folder, i.base_name), i.type == pafs.FileType.Directory and not _link(fs, i.path), i.size or 0, int(i.mtime_ns // 10**9) if i.mtime_ns is not None else 0, i.type) for i in found]
                rows = [r[:4] for r in rows if r[1] or r[4] == pafs.FileType.File]
                for a in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 8192]), (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["path", "folder", "bytes", "mtime"])

    level, count, number = spark.createDataFrame([("",)], "path string"), 1, 0
    while count and (levels is None or number < levels):
        path = f"{base}/{number:04d}"
        level.repartition(max(1, min(-(-count // FOLDERS), 4096)), "path").mapInArrow(listing, SHAPE).write.parquet(path)
        out.append(path)
        level = spark.read.schema(SHAPE).parquet(path).where("folder").select("path")
        count, number = level.count(), number + 1
    return spark.read.schema(SHAPE).parquet(*out) if out else spark.createDataFrame([], SHAPE)


def _link(fs: pafs.FileSystem, path: str) -> bool:
    """Whether a local folder is a link, which could lead back up."""
    import os

    return fs.type_name == "local" and os.path.islink(path)


def snapshot(spark: SparkSession, root: str, whitelist: list[str]) -> DataFrame:
    """path, bytes, mtime of files and folders (0, 0) whose first segment is in whitelist, from listings alone; what library.snapshot_diff compares."""
    rows = walk(spark, root).where(F.split_part("path", F.lit("/"), F.lit(1)).isin(*whitelist))
    size = lambda c: F.when(F.col("folder"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return rows.select("path", size("bytes"), size("mtime"))


def folders(spark: SparkSession, root: str, levels: int = LEVELS) -> DataFrame:
    """path (/a/b/) of every folder below root, empty ones too, `levels` deep at most, without those below a name that begins with _ or a dot."""
    rows = walk(spark, root, levels).where("folder").where(~F.col("path").rlike(r"(^|/)[_.]"))
    return rows.select(F.concat(F.lit("/"), "path", F.lit("/")).alias("path"))


def attachments(spark: SparkSession, root: str) -> DataFrame:
    """path, display_name, guid, bytes of the files below root by path, without the system's own; a guid may stand in brackets before the name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = walk(spark, root).where(~F.col("folder") & (name != IGNORED))
    guid = F.nullif(F.lower(F.regexp_extract(name, r"^[\[{]*\{?([0-9a-fA-F-]{36})\}?[\]}]*", 1)), F.lit(""))
    return rows.select("path", F.regexp_replace(name, r"^[\[{]+[0-9a-fA-F-]{36}[\]}]+", "").alias("display_name"), guid.alias("guid"), "bytes").orderBy("path")
