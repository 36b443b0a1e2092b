"""Audits as rows of checks: exports as written, whole corpora, settings; imports of attachments and their report."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from folioscope.functions import markdown, render, text
from folioscope.operators.library import SHOWN, smallest
from folioscope.operators.lifecycle import NEAR_EMPTY, WARNINGS, probe_length
from folioscope.sources.package_files import _open, _replace, below
from folioscope.sources.packages import HTML_BODY
from folioscope.sources.store import in_bounded_batches

# ---- checks


def check(id_: str, rows: DataFrame, bad: Column, sample: str) -> DataFrame:
    """id, total, failed, passed, samples: how many of rows there are and are bad, and the first SHOWN of column `sample` among the bad."""
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.coalesce(bad, F.lit(False))).alias("failed"))
    shown = smallest(rows.where(bad), sample, SHOWN)
    return counts.join(F.broadcast(shown)).select(F.lit(id_).alias("id"), "total", "failed", (F.col("failed") == 0).alias("passed"), F.col("samples").cast("array<string>").alias("samples"))


def export_checks(notes: DataFrame, entries: DataFrame, attachments: DataFrame, pages: DataFrame, host_scheme: str) -> DataFrame:
    """The checks E1 to E6 of an export that has been written, one row each.

    notes(guid): what was to be exported.  entries(path, guid, name, data: of bodies at least): what is there.  attachments(guid, name):
    those that have a file.  pages(guid, html): the notes as self-contained pages.
    E1 a body and every attachment in each package, E2 no script or host reference in bodies, E3 no reference into the package left in
    pages, E4 a package for each note, E5 no character in names that file systems refuse, E6 links of the closing block lead to entries.
    """
    has = entries.groupBy("guid").agg(F.bool_or(F.col("name") == HTML_BODY).alias("body"))
    lacking = attachments.select("guid", F.concat(F.lit("attachments/"), "name").alias("name")).join(entries.select("guid", "name"), ["guid", "name"], "left_anti").select("guid").distinct()
    packages = has.join(lacking.withColumn("lacks", F.lit(True)), "guid", "left")
    bodies = entries.where(F.col("name") == HTML_BODY).select("guid", F.make_valid_utf8(F.col("data").cast("string")).alias("html"))
    pure = (F.regexp_count("html", F.lit(host_scheme)) == 0) & (F.regexp_count("html", F.lit("(?i)<script")) == 0)
    left = pages.where(F.col("html").rlike(r'(?i)(?:src|href)="index_files/'))
    told = notes.select("guid").distinct().join(has.select("guid", F.lit(True).alias("there")), "guid", "left")
    parts = entries.select("path").distinct().select("path", F.explode(F.split("path", "/")).alias("part"))
    links = bodies.select("guid", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="(attachments/[^"]+)"'), 1))).alias("href")).select("guid", text.decode_entities(F.col("href")).alias("name"))
    links = links.join(entries.select("guid", "name", F.lit(True).alias("there")).distinct(), ["guid", "name"], "left")
    rows = [
        check("E1", packages, ~F.col("body") | F.col("lacks"), "guid"), check("E2", bodies, ~pure, "guid"),
        check("E3", pages.join(left.select("guid", F.lit(True).alias("leaks")), "guid", "left"), F.col("leaks"), "guid"), check("E4", told, F.col("there").isNull(), "guid"),
        check("E5", parts, text.illegal_name(F.col("part")), "path"), check("E6", links, F.col("there").isNull(), "name"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def report_rows(checks: DataFrame) -> DataFrame:
    """line, json of checks: each as a line of text and as JSON, in order of ids, and a last line for them all."""
    mark = F.when(F.col("passed"), "ok  ").otherwise("FAIL")
    line = F.concat(mark, F.lit(" "), "id", F.lit(": "), F.col("failed").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.when(F.size("samples") > 0, F.concat(F.lit(" ("), F.array_join("samples", ", "), F.lit(")"))).otherwise(""))
    own = checks.select("id", line.alias("line"), F.to_json(F.struct(*checks.columns)).alias("json"))
    passed, all_ = F.count_if("passed").cast("string"), F.count("*").cast("string")
    whole = checks.agg(F.lit("~").alias("id"), F.concat(passed, F.lit(" of "), all_, F.lit(" checks passed")).alias("line"), F.to_json(F.struct(F.bool_and("passed").alias("passed"), F.count("*").alias("checks"))).alias("json"))
    return own.unionByName(whole).orderBy("id").select("line", "json")


def write_report(checks: DataFrame, folder: str) -> None:
    """report.txt's lines and report.json's objects, as folders of one text file each."""
    rows = report_rows(checks).coalesce(1)
    rows.select("line").write.mode("overwrite").text(f"{folder}/text")
    rows.select("json").write.mode("overwrite").text(f"{folder}/json")


# ---- whole corpora

_CODE = StructType([StructField(n, IntegerType()) for n in ("blocks", "blank", "same", "width", "diff", "made", "unlike")])


def _code(mirror: str):
    """What a page's hidden code blocks are like: all, not rendered, rendered as the source, but for the width of white space, otherwise; made visible; made unlike the source."""

    def of(html: str | None) -> tuple[int, ...]:
        blocks = markdown.find_blocks(html or "", mirror) if html and "<textarea" in html.lower() else []
        blank = [b for b in blocks if not b["rendered"]]
        kinds = [0, 0, 0]
        for b in blocks:
            if b["rendered"]:
                shown = "\n".join(markdown.rendered_lines(html[b["end"] :].split(f"</{mirror}")[0]))
                kinds[_compared(b["source"], shown)] += 1
        return len(blocks), len(blank), *kinds, len(blank), 0

    @in_bounded_batches
    @F.pandas_udf(_CODE)
    def features(html):
        import pandas as pd

        return pd.DataFrame([of(h) for h in html], columns=_CODE.names)

    return features


def _compared(source: str, shown: str) -> int:
    """0: the same (tabs as four spaces, line feeds at the end apart), 1: but for the width of white space in lines, 2: otherwise."""
    a, b = (s.replace("\r", "").replace("​", "").replace(" ", " ").expandtabs(4).rstrip("\n") for s in (source, shown))
    if [x.rstrip() for x in a.split("\n")] == [x.rstrip() for x in b.split("\n")]:
        return 0
    fold = lambda s: [" ".join(x.split()) for x in s.split("\n")]
    return 1 if fold(a) == fold(b) else 2


def inspection(bodies: DataFrame, entries: DataFrame, mirror: str = "code-mirror") -> DataFrame:
    """One row of counters over bodies(guid, data, body_len) and their packages' entries(guid, name), bodies read once.

    data: a body's bytes, null where it can't be opened; body_len: what the index has.  Counted are bodies, those that can't be opened or aren't
    UTF-8, with replacement characters, code blocks (hidden, not rendered, rendered alike, but for width, unlike), references that have no entry and
    their notes, lengths that differ from the index, nearly empty ones by two measures, remote sources and their notes, and notes with scripts.
    """
    raw = F.when(F.hex(F.substring("data", 1, 3)) == "EFBBBF", F.substring(F.col("data"), F.lit(4), F.length("data"))).otherwise(F.col("data"))
    own = bodies.select("guid", "body_len", raw.alias("raw"), F.make_valid_utf8(raw.cast("string")).alias("html"))
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"index_files/([^\"'()\s<>?#]+)"), 1))
    names = entries.where(F.col("name").startswith("index_files/")).groupBy("guid").agg(F.collect_set(F.substring(F.col("name"), F.lit(13), F.length("name"))).alias("names"))
    sources = F.regexp_extract_all("html", F.lit(r"""(?i)src\s*=\s*["']([^"']+)["']"""), 1)
    missing = F.size(F.filter("refs", lambda r: ~F.array_contains(F.coalesce("names", F.array().cast("array<string>")), F.regexp_extract(r, r"([^/]*)$", 1))))
    told = own.withColumn("refs", refs).join(names, "guid", "left").select(
        F.col("raw").isNull().alias("closed"), (~F.is_valid_utf8(F.col("raw").cast("string"))).alias("broken"), F.col("html").contains("�").alias("mojibake"), F.coalesce(missing, F.lit(0)).alias("missing"),
        (F.length(text.extract_text(F.col("html"))) != F.col("body_len")).alias("differs"), (F.col("raw").isNotNull() & (F.col("body_len") < NEAR_EMPTY)).alias("empty"), (probe_length(F.col("html")) < NEAR_EMPTY).alias("probe"),
        F.coalesce(F.size(F.filter(sources, lambda u: u.rlike("^(https?:)?//"))), F.lit(0)).alias("remote"), F.col("html").rlike("(?i)<script").alias("script"), _code(mirror)(F.col("html")).alias("code"),
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return told.agg(
        F.count("*").alias("notes"), F.count_if("closed").alias("open_fail"), F.count_if("broken").alias("decode_fail"), F.count_if("mojibake").alias("mojibake_notes"),
        total("code.blocks", "code_blocks"), F.count_if(F.col("code.blocks") > 0).alias("code_notes"), total("code.blank", "code_blank"), total("code.same", "code_same"), total("code.width", "code_width"), total("code.diff", "code_diff"),
        total("missing", "refs_missing"), F.count_if(F.col("missing") > 0).alias("refs_missing_notes"), F.count_if("differs").alias("length_differs"), F.count_if("empty").alias("near_empty_index"), F.count_if("probe").alias("near_empty_probe"),
        total("remote", "remote_sources"), F.count_if(F.col("remote") > 0).alias("remote_source_notes"), F.count_if("script").alias("script_notes"),
    )


# ---- imports

#: What an import does with an attachment, and in which order these are counted.
ACTIONS = ("copied", "skipped", "missing", "unsafe")


def import_plan(attachments: DataFrame, source: DataFrame, library: DataFrame) -> DataFrame:
    """file_path, dest, action of attachments(file_path, size, tier): what an import copies from source(path, bytes) into library(path, bytes).

    Rows without a file (tier 0 and those called db-missing:) have no part.  skipped: the library has it, in its size where that is known;
    missing: the source hasn't; unsafe: the path would leave its folder.  Files lie in the library under their folder's name with _ before it.
    """
    own = attachments.where((F.col("tier") != 0) & ~F.col("file_path").startswith("db-missing:")).select("file_path", "size", text.disk_path(F.col("file_path")).alias("dest"))
    there = own.join(library.select(F.col("path").alias("dest"), F.col("bytes").alias("held")), "dest", "left").join(source.select(F.col("path").alias("file_path"), F.lit(True).alias("source")), "file_path", "left")
    same = F.col("held").isNotNull() & ((F.coalesce("size", F.lit(0)) <= 0) | (F.col("held") == F.col("size")))
    action = F.when(text.unsafe_path(F.col("file_path")), "unsafe").when(same, "skipped").when(F.col("source").isNull(), "missing").otherwise("copied")
    return there.select("file_path", "dest", action.alias("action"))


def import_files(plan: DataFrame, source: str, library: str) -> DataFrame:
    """file_path, bytes (null: it couldn't be read) of the plan's copies, which tasks make beside their places and rename; a task that runs again makes the same."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (from_, base), (to, root) = _open(source), _open(library)
        for batch in batches:
            sizes = []
            for path, dest in zip(batch["file_path"].to_pylist(), batch["dest"].to_pylist()):
                size = None
                if below(path) is not None and below(dest) is not None and from_.get_file_info(posixpath.join(base, path)).type == pafs.FileType.File:
                    with from_.open_input_stream(posixpath.join(base, path)) as data:
                        content = data.read()
                    _replace(to, posixpath.join(root, dest), content)
                    size = len(content)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch["file_path"], pa.array(sizes, pa.int64())], ["file_path", "bytes"])

    return plan.where("action = 'copied'").select("file_path", "dest").mapInArrow(copy, "file_path string, bytes long")


def import_report(plan: DataFrame) -> DataFrame:
    """One row: how many files were copied, skipped, missing and unsafe, and the first WARNINGS of the last two by path."""
    counts = plan.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])
    warned = plan.where(F.col("action").isin("missing", "unsafe")).select(F.concat("action", F.lit(": "), "file_path").alias("w"))
    return counts.join(F.broadcast(smallest(warned, "w", WARNINGS).withColumnRenamed("samples", "warnings")))


# ---- settings


def settings_problem(s: Column) -> Column:
    """What is wrong with replication settings (a struct of endpoint, bucket, prefix, concurrency, role), null if nothing is; the first of several.

    Plain http is for this machine and private IPv4 networks only.
    """
    endpoint = F.regexp_replace(F.trim(s["endpoint"]), "/+$", "")
    host = F.regexp_extract(endpoint, "^http://([^/:]*)", 1)
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    private = host.isin("localhost", "::1") | host.rlike(rf"^(127\.{octet}|10\.{octet}|192\.168|172\.(1[6-9]|2[0-9]|3[01]))(\.{octet}){{2}}$")
    role = text.canonical_role(s["role"])
    return (
        F.when(endpoint == "", "endpoint is empty").when(~endpoint.rlike("^https?://"), "endpoint has no scheme").when(endpoint.startswith("http://") & ~private, "endpoint is public and not https")
        .when(~s["bucket"].rlike(r"^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$"), "bucket").when(s["prefix"].rlike(r"(^|/)\.\.(/|$)"), "prefix").when(~s["concurrency"].between(1, 16), "concurrency").when((role != "") & ~role.isin("writer", "reader"), "role")
    )
