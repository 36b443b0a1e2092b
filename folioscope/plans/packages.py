"""Queries that write packages of the whole library and read them back, and pages made self-contained; the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import export
from folioscope.operators.library import snapshot_diff
from folioscope.plans.registry import WITH, _title_sql, query
from folioscope.sources import package_files, walk
from folioscope.sources.store import shared_folder
from folioscope.sources.views import notes, table

_NAMED = f"""x AS (SELECT guid, body, doc_id, location, regexp_replace(trim(location, '/'), '/+', '/', 'g') AS directory, title, {_title_sql("title")} AS base FROM note),
n AS (SELECT *, ltrim(directory || '/' || CASE WHEN row_number() OVER (PARTITION BY directory, base ORDER BY title, guid) = 1 THEN base ELSE substring(base, 1, 110) || '_' || substring(guid, 1, 8) END || '.zip', '/') AS path FROM x)"""


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/folioscope-packages/{name}-{uuid.uuid4().hex}"


def _with_resources(s: SparkSession, d: str) -> DataFrame:
    """Every third note has a resource that holds its location, and every seventh one that would leave its package."""
    one = lambda cond, name, data: F.when(cond, F.array(F.struct(name.alias("name"), F.encode(data, "utf-8").alias("data")))).otherwise(F.array().cast(export.ENTRIES))
    safe = one(F.col("doc_id") % 3 == 0, F.concat(F.lit("index_files/"), "guid", F.lit(" é.txt")), F.col("location"))
    return notes(s, d).withColumn("resources", F.concat(safe, one(F.col("doc_id") % 7 == 0, F.lit("%2e%2e/x.txt"), F.col("guid"))))


@query(
    "q_export_packages",
    f"""{WITH}, {_NAMED} SELECT path, guid, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS entries, strlen(body)::BIGINT AS body_bytes, md5(body) AS body_md5, doc_id % 3 = 0 AS resource, CASE WHEN doc_id % 3 = 0 THEN md5(location) END AS resource_md5 FROM n""",
)
def _export_packages(s: SparkSession, d: str) -> DataFrame:
    """Markdown packages of all notes, written by tasks, listed by the commit, and read back by ranges."""
    folder = _folder(s, "markdown")
    package_files.write_packages(export.packages(_with_resources(s, d)), folder)
    rows = package_files.written(s, folder)
    own = rows.where("array_contains(entries, 'note.md')").select("path", "guid", F.size("entries").cast("long").alias("entries"), F.get(F.filter("entries", lambda e: e != "note.md"), F.lit(0)).alias("other"))
    wanted = own.select("path", F.explode(F.array_compact(F.array(F.lit("note.md"), "other"))).alias("entry"))
    read = package_files.read_ranges(s, folder, wanted)
    body = read.where("entry = 'note.md'").select("path", F.octet_length("data").cast("long").alias("body_bytes"), F.md5("data").alias("body_md5"))
    other = read.where("entry <> 'note.md'").select("path", F.md5("data").alias("resource_md5"))
    return own.join(body, "path").join(other, "path", "left").select("path", "guid", "entries", "body_bytes", "body_md5", F.col("resource_md5").isNotNull().alias("resource"), "resource_md5")


@query(
    "q_package_entries",
    f"""{WITH}, {_NAMED}, e AS (SELECT guid, 'index.html' AS name, -1::BIGINT AS bytes FROM n UNION ALL SELECT guid, 'index_files/' || guid || ' é.txt', strlen(location)::BIGINT FROM n WHERE doc_id % 3 = 0
 UNION ALL SELECT guid, CASE WHEN k = 1 THEN 'attachments/report.txt' ELSE 'attachments/report_2.txt' END, strlen(location)::BIGINT + k FROM n, (SELECT unnest([1, 2]) AS k) WHERE doc_id % 5 = 0)
SELECT guid, name, bytes, true AS ranged FROM e""",
)
def _package_entries(s: SparkSession, d: str) -> DataFrame:
    """HTML packages with attachments of one name, written; their entries from the central directories, without the entries' bytes."""
    folder, n = _folder(s, "html"), _with_resources(s, d)
    five = n.where("doc_id % 5 = 0").select("guid", F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), "location")
    files = five.select("guid", "at", F.lit("report.txt").alias("display_name"), F.encode(F.concat("location", F.repeat(F.lit("x"), F.col("at"))), "utf-8").alias("data"), F.lit(0).alias("size"))
    package_files.write_packages(export.packages(n, "html", files.unionByName(five.where("at = 2").select("guid", F.lit(3).alias("at"), F.lit("gone.txt").alias("display_name"), F.lit(None).cast("binary").alias("data"), F.lit(7).alias("size")))), folder)
    rows = package_files.list_entries(s, folder)
    # a directory is read with its end record and, where zipfile looks for a comment, up to 64 KiB: never more than that besides
    return rows.select("guid", "name", F.when(F.col("name") != "index.html", F.col("bytes")).otherwise(-1).alias("bytes"), (F.col("read_bytes") < F.least(F.col("file_bytes") + 1024, F.lit(80_000))).alias("ranged"))


_PNG, _CSS = "page_id || ' png'", "'b{background:url(../i' || page_id || '.gif)} i{x:url(data:abc)} u{y:url(\"n.png\")}'"


@query(
    "q_self_contained",
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), u AS (SELECT page_id, h,
 CASE WHEN page_id % 2 = 0 THEN 'data:image/png;base64,' || base64(encode({_PNG})) ELSE 'index_files/a%20b.png' END AS img,
 CASE WHEN page_id % 3 = 0 THEN '<style>' || replace({_CSS}, 'url("n.png")', 'url(data:image/png;base64,' || base64(encode('n')) || ')') || '</style>' ELSE '<link rel="x" href="index_files/s/m.css"/>' END AS css FROM p)
SELECT page_id::VARCHAR AS guid, md5(h || '<img class="c" src="' || img || '">' || h || css || '<img src="http://x/y.png">') AS html_md5, (page_id % 2 = 0)::BIGINT + (page_id % 3 = 0)::BIGINT AS inlined, 2 - (page_id % 2 = 0)::BIGINT - (page_id % 3 = 0)::BIGINT AS left_out FROM u""",
)
def _self_contained(s: SparkSession, d: str) -> DataFrame:
    """Whole pages with an image and a style sheet in them; half of the images and a third of the sheets are there."""
    p = table(s, d, "pages")
    h = F.coalesce("html", F.lit(""))
    page = p.select(F.col("page_id").cast("string").alias("guid"), F.concat(h, F.lit('<img class="c" src="index_files/a%20b.png">'), h, F.lit('<link rel="x" href="index_files/s/m.css"/><img src="http://x/y.png">')).alias("html"))
    number = F.col("page_id").cast("string")
    css = F.concat(F.lit("b{background:url(../i"), number, F.lit('.gif)} i{x:url(data:abc)} u{y:url("n.png")}'))
    entries = p.where("page_id % 2 = 0").select(number.alias("guid"), F.lit("index_files/a b.png").alias("name"), F.encode(F.concat(number, F.lit(" png")), "utf-8").alias("data"))
    sheets = p.where("page_id % 3 = 0").select(number.alias("guid"), F.explode(F.array(F.struct(F.lit("index_files/s/m.css").alias("name"), css.alias("data")), F.struct(F.lit("index_files/s/n.png").alias("name"), F.lit("n").alias("data")))).alias("e")).select("guid", "e.name", F.encode("e.data", "utf-8").alias("data"))
    made = export.self_contained(page, entries.unionByName(sheets))
    return made.select("guid", F.md5("html").alias("html_md5"), F.col("inlined").cast("long").alias("inlined"), F.col("left").cast("long").alias("left_out"))


_TREE = """t AS (SELECT ltrim(location, '/') || guid || '.zip' AS path, location, doc_id FROM note),
 b AS (SELECT path, location, doc_id FROM t WHERE doc_id % 9 <> 0), a AS (SELECT path, location, doc_id FROM t WHERE doc_id % 12 <> 0),
 d AS (SELECT 'b' AS side, location FROM b UNION SELECT 'a', location FROM a),
 f AS (SELECT DISTINCT side, unnest([split_part(location, '/', 2), split_part(location, '/', 2) || '/' || split_part(location, '/', 3)]) AS path FROM d)"""


@query(
    "q_walk_diff",
    f"""{WITH}, {_TREE}, l AS (SELECT path, doc_id % 15 = 1 AS changed FROM b UNION ALL SELECT path, false FROM f WHERE side = 'b'), r AS (SELECT path FROM a UNION ALL SELECT path FROM f WHERE side = 'a')
SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'removed' WHEN l.path IS NULL THEN 'added' ELSE 'modified' END AS change FROM l FULL JOIN r ON l.path = r.path WHERE l.path IS NULL OR r.path IS NULL OR changed""",
)
def _walk_diff(s: SparkSession, d: str) -> DataFrame:
    """Two folder trees of packages, walked in parallel, and what changed from one to the other; times are left out."""
    shape = lambda side: notes(s, d).where(f"doc_id % {9 if side == 'before' else 12} <> 0").select(F.ltrim(F.concat("location", "guid", F.lit(".zip")), F.lit("/")).alias("path"), "guid", F.array(F.struct(F.lit("note.md").alias("name"), F.encode(F.when((F.col("doc_id") % 15 == 1) & F.lit(side == "after"), "other").otherwise("") if side == "after" else F.lit(""), "utf-8").alias("data"))).alias("entries"))
    snaps = []
    for side in ("before", "after"):
        folder = _folder(s, side)
        package_files.write_packages(shape(side), folder)
        langs = [r[0] for r in notes(s, d).select(F.split_part("location", F.lit("/"), F.lit(2))).distinct().collect()]
        snaps.append(walk.snapshot(s, folder, langs).withColumn("mtime", F.lit(0)))
    return snapshot_diff(*snaps)
