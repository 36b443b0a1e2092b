"""Packages as files: a Python data source that writes them task by task, and one that reads entries by ranges.

A package is written beside its place and renamed to it, so no reader sees half of one, and a task that runs again writes
the same bytes to the same place.  What a task has written it lists in a file of its own; the driver's commit names the
lists of the tasks that count, in _manifest/{number}.json, which appears whole.  What no commit names isn't there for readers.

Entries are read from the committed lists: one partition for each, packages opened at their central directory, and of an
entry that is asked for only its own bytes.  Paths are opened with pyarrow's file systems (file:, hdfs:, s3: ...).
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from folioscope.sources.packages import make_package, sanitize_entry
from folioscope.sources.store import shuffles_removed

WRITTEN = "path string, guid string, md5 string, size long, entries array<string>, number long"
ENTRIES = "path string, guid string, name string, bytes long, packed long, crc long, file_bytes long, read_bytes long, data binary, number long"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, base = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    return fs, base.rstrip("/")


def below(path: str | None) -> str | None:
    """A path as it is, if it stays below its folder; None otherwise."""
    parts = (path or "").split("/")
    return path if path and not ({"", ".", ".."} & set(parts)) and "\\" not in path and "\0" not in path and parts[0] != "_manifest" else None


def _replace(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """The file at path has these bytes or, if this is stopped, what it had before."""
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{posixpath.dirname(path)}/.{posixpath.basename(path)[:80]}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(part) as out:
            out.write(data)
        if fs.type_name == "hdfs" and fs.get_file_info(path).type != pafs.FileType.NotFound:
            fs.delete_file(path)  # a rename doesn't replace there
        fs.move(part, path)
    except BaseException:
        if fs.get_file_info(part).type != pafs.FileType.NotFound:
            fs.delete_file(part)
        raise


@dataclass
class Listed(WriterCommitMessage):
    """What a task has written: the name of its list."""

    name: str
    packages: int


class PackageWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Listed:
        fs, base = _open(self.folder)
        context = TaskContext.get()
        name = f"{self.job}/{context.partitionId():06d}-{context.taskAttemptId()}.jsonl"
        lines = []
        for batch in iterator:
            for path, guid, entries in zip(batch["path"].to_pylist(), batch["guid"].to_pylist(), batch["entries"].to_pylist()):
                safe = below(path)
                if safe is None:
                    raise ValueError(f"not a path below the folder: {path!r}")
                data = make_package({e["name"]: e["data"] or b"" for e in entries or []})
                _replace(fs, f"{base}/{safe}", data)
                lines.append(json.dumps({"path": safe, "guid": guid, "md5": hashlib.md5(data).hexdigest(), "size": len(data), "entries": [e["name"] for e in entries or []]}, ensure_ascii=False))
        if lines:
            _replace(fs, f"{base}/_manifest/{name}", ("\n".join(lines) + "\n").encode())
        return Listed(name if lines else "", len(lines))

    def commit(self, messages: list[Listed | None]) -> None:
        fs, base = _open(self.folder)
        number = max(commits(fs, base), default=0) + 1
        lists = sorted(m.name for m in messages if m is not None and m.name)
        _replace(fs, f"{base}/_manifest/{number:010d}.json", json.dumps({"lists": lists, "packages": sum(m.packages for m in messages if m is not None)}).encode())

    def abort(self, messages: list[Listed | None]) -> None:
        """No commit names this job, so its lists go; whole packages may stay, and the next run replaces them."""
        fs, base = _open(self.folder)
        if fs.get_file_info(f"{base}/_manifest/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/_manifest/{self.job}")


def commits(fs: pafs.FileSystem, base: str) -> dict[int, str]:
    """Number and path of every commit of a folder of packages."""
    found = fs.get_file_info(pafs.FileSelector(f"{base}/_manifest", allow_not_found=True))
    return {int(i.base_name[:-5]): i.path for i in found if i.base_name.endswith(".json") and i.base_name[:-5].isdigit()}


@dataclass
class OfList(InputPartition):
    path: str
    number: int


class PackageReader(DataSourceReader):
    """what=packages: the committed lists; what=entries: the central directories, with the data of entries named in `data` (separated by |)."""

    def __init__(self, folder: str, what: str, names: str):
        self.folder, self.what, self.names = folder, what, set(names.split("|")) if names else set()

    def partitions(self) -> list[OfList]:
        fs, base = _open(self.folder)
        return [OfList(f"{base}/_manifest/{name}", number) for number, path in sorted(commits(fs, base).items()) for name in json.loads(fs.open_input_file(path).read())["lists"]] or [OfList("", 0)]

    def read(self, partition: OfList) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, base = _open(self.folder)
        with fs.open_input_stream(partition.path) as lines:
            rows = [json.loads(line) for line in lines.read().decode().splitlines()]
        for row in rows:
            if self.what == "packages":
                yield row["path"], row["guid"], row["md5"], row["size"], row["entries"], partition.number
            else:
                for entry in entries_of(fs, f"{base}/{row['path']}", lambda n: n in self.names):
                    yield row["path"], row["guid"], *entry, partition.number


class Packages(DataSource):
    """spark.read.format("packages"), and .write.format("packages").mode("append"), with a folder."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return WRITTEN if self.options.get("what", "packages") == "packages" else ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackageReader(self.options["path"], self.options.get("what", "packages"), self.options.get("data", ""))

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        if overwrite:
            raise ValueError("packages are added to a folder or replace those of the same path: use append")
        return PackageWriter(self.options["path"])


class Counted(io.RawIOBase):
    """A seekable file that counts the bytes it has given."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.given = file, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        self.given += len(data)
        return len(data)


def entries_of(fs: pafs.FileSystem, path: str, wanted) -> list[tuple]:
    """(name, bytes, packed, crc, file's bytes, bytes read, data) of a package's entries; wanted(name): its data is read.  No package: none."""
    out = []
    try:
        with fs.open_input_file(path) as file:
            ranged = Counted(file)
            with zipfile.ZipFile(ranged) as z:
                for e in z.infolist():
                    if not e.is_dir():
                        data = z.read(e) if wanted(e.filename) else None
                        out.append((e.filename, e.file_size, e.compress_size, e.CRC, file.size(), ranged.given, data))
    except (zipfile.BadZipFile, FileNotFoundError, RuntimeError):
        return []
    return [(*row[:5], out[-1][5], row[6]) for row in out]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Packages)


def write_packages(packages: DataFrame, folder: str) -> None:
    """packages(path, guid, entries: array of name, data) as files below a folder that all executors share, and the commit that lists them."""
    register(packages.sparkSession)
    with shuffles_removed(packages.sparkSession):
        packages.select("path", "guid", "entries").write.format("packages").mode("append").save(folder)


def written(spark: SparkSession, folder: str) -> DataFrame:
    """path, guid, md5, size, entries, number of the packages that commits name; of several of one path the last."""
    register(spark)
    rows = spark.read.format("packages").option("what", "packages").load(folder)
    return rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "number").alias("last")).select("path", "last.*")


def list_entries(spark: SparkSession, folder: str, data: tuple[str, ...] = ()) -> DataFrame:
    """path, guid, name, bytes, packed, crc, file_bytes, read_bytes of every entry of committed packages, and data of entries of the given names.

    Packages are as they are on disk now; one that several commits name is read for its last.
    """
    register(spark)
    rows = spark.read.format("packages").option("what", "entries").option("data", "|".join(data)).load(folder)
    last = written(spark, folder).select("path", "number")
    return rows.join(last, ["path", "number"]).drop("number")


def read_ranges(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """path, entry, data, read_bytes of wanted(path, entry): by exact name, else by the sanitized one; a package's other entries aren't read.

    data is null where the path isn't safe or there is no such package or entry.
    """
    kinds = "path string, entry string, data binary, read_bytes long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for path, entries in zip(batch["path"].to_pylist(), batch["entries"].to_pylist()):
                safe, found, given = below(path), dict.fromkeys(entries), 0
                try:
                    if safe is not None:
                        with fs.open_input_file(f"{base}/{safe}") as file:
                            ranged = Counted(file)
                            with zipfile.ZipFile(ranged) as z:
                                names = set(z.namelist())
                                for entry in entries:
                                    clean = sanitize_entry(entry)
                                    name = entry if clean is not None and entry in names else clean
                                    if name in names:
                                        found[entry] = z.read(name)
                            given = ranged.given
                except (zipfile.BadZipFile, FileNotFoundError, RuntimeError):
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary()), pa.array([given] * len(found), pa.int64())], ["path", "entry", "data", "read_bytes"])

    return wanted.groupBy("path").agg(F.collect_set("entry").alias("entries")).mapInArrow(read, kinds)
