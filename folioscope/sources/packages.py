"""Note packages: zip files read by Spark's binaryFile source, their entries and bodies; and packages written by tasks."""

from __future__ import annotations

import io
import urllib.parse
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKDOWN_BODY, HTML_BODY = "note.md", "index.html"
#: Rounds of percent-decoding of an entry path, and levels of folders that are walked.
DECODINGS, LEVELS = 3, 16


def sanitize_entry(raw: str) -> str | None:
    """A relative entry path, percent-decoded at most three times and looked at before each; None where it isn't safe.

    It names an entry of a package and is never a path on disk.
    """
    path = raw
    for _ in range(DECODINGS):
        if not path or "\\" in path or path.startswith("/") or ":" in path or "\0" in path or ".." in path.split("/"):
            return None
        decoded = urllib.parse.unquote(path)
        if decoded == path:
            break
        path = decoded
    return "/".join(p for p in path.split("/") if p not in ("", ".")) or None


def decode_body(data: bytes) -> str:
    """UTF-8 with or without a mark at the start; bad bytes become replacement characters."""
    return data.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


def list_packages(spark: SparkSession, folder: str) -> DataFrame:
    """path, guid, length of packages named {guid}, read from the listing alone."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("guid", F.lower(F.regexp_extract(F.url_decode(name), r"^\{([0-9a-fA-F-]+)\}", 1))).where("guid <> ''")


def list_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """file_path, file_guid (null without one), display_name, length; the guid may stand in braces before the name."""
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    files = spark.read.format("binaryFile").load(folder).select("path", "length").withColumn("name", name).where("name <> '.DS_Store'")
    guid = F.nullif(F.lower(F.regexp_extract("name", r"^\{([0-9a-fA-F-]{36})\}", 1)), F.lit(""))
    return files.select(F.col("path").alias("file_path"), guid.alias("file_guid"), F.regexp_replace("name", r"^\{[0-9a-fA-F-]{36}\}", "").alias("display_name"), "length")


def bodies(packages: DataFrame) -> DataFrame:
    """guid, format (markdown, html or null), body, entries of packages(guid, content).

    A package that can't be read gives null format and an empty body, never another note's text.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for guid, content in zip(batch["guid"].to_pylist(), batch["content"]):
                kind, body, names = None, "", []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                        kind = "markdown" if MARKDOWN_BODY in names else "html" if HTML_BODY in names else None
                        if kind:
                            body = decode_body(z.read(MARKDOWN_BODY if kind == "markdown" else HTML_BODY))
                except (zipfile.BadZipFile, OSError, KeyError, RuntimeError):
                    kind, body = None, ""
                yield pa.RecordBatch.from_arrays([pa.array([guid], pa.string()), pa.array([kind], pa.string()), pa.array([body], pa.string()), pa.array([names], pa.list_(pa.string()))], ["guid", "format", "body", "entries"])

    return packages.select(F.col("guid").cast("string").alias("guid"), "content").mapInArrow(read, "guid string, format string, body string, entries array<string>")


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(folder)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return bodies(files.withColumn("guid", F.lower(F.regexp_extract(name, r"^\{([0-9a-fA-F-]+)\}", 1))).where("guid <> ''"))


def make_package(entries: dict[str, bytes], base: bytes | None = None, must_exist: bool = False) -> bytes:
    """A package with these entries, the others of base byte for byte; a replaced entry has to exist if must_exist."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = set()
        if base is not None:
            with zipfile.ZipFile(io.BytesIO(base)) as old:
                names = set(old.namelist())
                for item in old.infolist():
                    if item.filename not in entries:
                        z.writestr(item, old.read(item.filename))
        if must_exist and (missing := set(entries) - names):
            raise KeyError(f"not in the package: {sorted(missing)}")
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def folder_positions(meta: DataFrame) -> DataFrame:
    """path, pos from the one JSON row of meta(group, key, value); absent: none; malformed: an error."""
    row = meta.where("`group` = 'SYNC_INFO' and `key` = 'FOLDERS_POS'")
    return row.select(F.explode(F.from_json("value", "map<string, bigint>", {"mode": "FAILFAST"})).alias("path", "pos"))


def read_entries(packages: DataFrame, wanted: DataFrame) -> DataFrame:
    """guid, entry, data of wanted(guid, entry) in packages(guid, content): by the entry's exact name, else by its sanitized one.

    data is null where the path isn't safe, the package has no such entry or can't be opened.  Only the wanted entries of a
    package are decompressed; packages that nothing is wanted of aren't opened.
    """
    asked = wanted.groupBy("guid").agg(F.collect_set("entry").alias("entries"))
    both = packages.select("guid", "content").join(asked, "guid")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for guid, content, entries in zip(batch["guid"].to_pylist(), batch["content"], batch["entries"].to_pylist()):
                found = dict.fromkeys(entries)
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        names = set(z.namelist())
                        for entry in entries:
                            safe = sanitize_entry(entry)
                            name = entry if safe is not None and entry in names else safe
                            if name in names:
                                found[entry] = z.read(name)
                except zipfile.BadZipFile:
                    pass
                yield pa.RecordBatch.from_arrays([pa.array([guid] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["guid", "entry", "data"])

    return both.mapInArrow(read, "guid string, entry string, data binary")


def disk_dirs(files: DataFrame) -> DataFrame:
    """path (/a/b/) of every directory above files(path, relative), LEVELS deep at most, none of whose names begins with _ or a dot."""
    parts = F.split(F.regexp_replace("path", r"/[^/]*$|^[^/]*$", ""), "/")
    own = files.select(F.filter(parts, lambda s: s != "").alias("parts")).where(F.size("parts") > 0).distinct()
    some = F.transform(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(LEVELS))), lambda i: F.slice("parts", 1, i))
    seen = own.select(F.explode(some).alias("p")).distinct().where(~F.exists("p", lambda s: s.rlike("^[_.]")))
    return seen.select(F.concat(F.lit("/"), F.array_join("p", "/"), F.lit("/")).alias("path"))


def snapshot(spark: SparkSession, folder: str, whitelist: list[str]) -> DataFrame:
    """path (relative to folder), bytes, mtime (seconds) of the files whose first segment is in whitelist, from the listing alone.

    Spark lists no folder below the given one whose name begins with _ or a dot.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    below = folder.split("://")[-1].strip("/") + "/"
    whole = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    path = F.substring(whole, F.instr(whole, below) + len(below), F.length(whole))
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.unix_seconds("modificationTime").alias("mtime")).where(F.split_part("path", F.lit("/"), F.lit(1)).isin(*whitelist))


def file_md5(spark: SparkSession, folder: str) -> DataFrame:
    """path, md5, size of every file below folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.md5("content").alias("md5"), F.col("length").alias("size"))


def settings(lines: DataFrame, defaults: dict[str, tuple[str, object]], renamed: dict[str, str] | None = None) -> DataFrame:
    """The settings of lines(value: a JSON object each), a column for each of defaults {name: (type, value)}.

    renamed {old: new}: an older name counts where the present one is missing.  Text that is no JSON gives the defaults.
    """
    renamed = renamed or {}
    shape = ", ".join(f"`{n}` {kind}" for n, kind in {**{old: defaults[new][0] for old, new in renamed.items()}, **{n: d[0] for n, d in defaults.items()}}.items())
    own = lines.select(F.from_json("value", shape).alias("s"))
    olds = lambda name: [F.col(f"s.{old}") for old, new in renamed.items() if new == name]
    return own.select(*[F.coalesce(F.col(f"s.{n}"), *olds(n), F.lit(value).cast(kind)).alias(n) for n, (kind, value) in defaults.items()])
