"""Queries of rules for names, paths, code and settings, of row-level changes, and of whole conversions; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import keys, markdown, render, text
from folioscope.operators import checks, writes
from folioscope.operators import library as lib
from folioscope.plans.registry import WITH, query
from folioscope.sources.packages import folder_positions, settings
from folioscope.sources.store import in_bounded_batches
from folioscope.sources.views import notes, table

# ---- names and paths

_PATHS = "CASE page_id % 6 WHEN 0 THEN '../' || url WHEN 1 THEN replace(url, 'https://', '') WHEN 2 THEN '_' || replace(url, 'https://', '') WHEN 3 THEN 'C:' || url WHEN 4 THEN 'a/..' ELSE url || '?' END"


def _paths(s: SparkSession, d: str) -> DataFrame:
    """URLs turned into paths of six kinds by page_id."""
    bare, kind = F.replace("url", F.lit("https://"), F.lit("")), F.col("page_id") % 6
    path = F.when(kind == 0, F.concat(F.lit("../"), "url")).when(kind == 1, bare).when(kind == 2, F.concat(F.lit("_"), bare)).when(kind == 3, F.concat(F.lit("C:"), "url")).when(kind == 4, "a/..").otherwise(F.concat("url", F.lit("?")))
    return table(s, d, "pages").where("url is not null").select("page_id", "url", path.alias("path"))


query("q_path_rules", rf"""WITH p AS (SELECT page_id, url, {_PATHS} AS path FROM pages WHERE url IS NOT NULL)
SELECT page_id, regexp_matches(path, '^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)') AS unsafe, regexp_matches(path, '(^|/)[_.]') AS reserved, regexp_matches(url, '(?i)^(https?:)?//') AS remote, regexp_matches(path, '[:*?"<>|]') OR length(path) > {text.LONGEST_NAME} AS illegal FROM p""")(
    lambda s, d: _paths(s, d).select("page_id", text.unsafe_path(F.col("path")).alias("unsafe"), text.reserved_path(F.col("path")).alias("reserved"), text.remote_url(F.col("url")).alias("remote"), text.illegal_name(F.col("path")).alias("illegal"))
)
query("q_system_folders", f"SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN '{text.SYSTEM_FOLDERS[0]}' ELSE '/' || lang || '/' END = '{text.SYSTEM_FOLDERS[0]}', false) AS system FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(text.system_folder(F.when(F.col("doc_id") % 3 == 0, text.SYSTEM_FOLDERS[0]).otherwise(F.concat(F.lit("/"), "lang", F.lit("/")))), F.lit(False)).alias("system"))
)
query("q_origin_labels", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '{text.ORIGINS[0]}' ELSE '' END WHEN 1 THEN '{text.ORIGINS[1]}' WHEN 2 THEN '{text.ORIGINS[2]}' WHEN 3 THEN '{text.ORIGINS[3]}' ELSE '' END AS label FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", text.origin_label(F.col("doc_id") % 5, F.when(F.col("doc_id") % 2 == 0, "db-missing").otherwise("unlinked")).alias("label"))
)
query("q_normal_names", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(md5(text)) END AS guid, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '/' || lang || '/' || source || '/' ELSE '/' END AS location,
 replace(replace(replace(text, chr(9), '    '), chr(8203), ''), chr(160), ' ') || '    x y' AS code, to_base64(unhex(md5(text))) AS content_md5, '"' || md5(text) || '"' AS etag, CASE WHEN doc_id % 2 = 0 THEN 'writer' ELSE 'reader' END AS role, CASE WHEN doc_id % 2 = 0 THEN 'on_demand' ELSE 'full' END AS policy,
 round(strlen(text) / 1048576.0, 1) AS megabytes, CASE WHEN doc_id % 2 = 0 THEN 'NO_SPACE' ELSE '' END AS code_of_error FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL""")(
    lambda s, d: table(s, d, "documents").where("text is not null and lang is not null and source is not null").select(
        "doc_id",
        text.normalize_guid(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("{"), F.upper(F.md5("text")), F.lit("}"))).otherwise("no guid")).alias("guid"),
        text.normalize_location(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/a/../"), "lang")).when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit("//  "), "source", F.lit(" "))).otherwise(" / ")).alias("location"),
        text.normalize_code(F.concat("text", F.lit("\tx​ y"))).alias("code"), text.content_md5(F.md5("text")).alias("content_md5"), keys.etag(F.encode("text", "utf-8")).alias("etag"),
        text.canonical_role(F.when(F.col("doc_id") % 2 == 0, "export").otherwise("reader")).alias("role"), text.canonical_policy(F.when(F.col("doc_id") % 2 == 0, " on_demand ").otherwise("on demand")).alias("policy"),
        keys.megabytes(F.octet_length("text")).alias("megabytes"), keys.error_code(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("NO_SPACE: "), "text")).otherwise(F.concat(F.lit("no: "), "lang"))).alias("code_of_error"),
    )
)
query("q_image_kinds", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'bmp' WHEN 5 THEN 'svg' END AS kind FROM documents WHERE NOT contains(lower(substring(coalesce(text, ''), 1, 256)), '<svg')")(
    lambda s, d: table(s, d, "documents").where(~F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 256)).contains("<svg")).select(
        "doc_id",
        text.image_kind(F.concat(F.unhex(F.element_at(F.array(*[F.lit(h) for h in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "52494646FF00FF0057454250", "424D", "FEFF3C53564720", "50")]), (F.col("doc_id") % 7 + 1).cast("int"))), F.encode(F.coalesce("text", F.lit("")), "utf-8"))).alias("kind"),
    )
)

# ---- bodies

query("q_injected", "WITH p AS (SELECT page_id, coalesce(html, '') || CASE WHEN page_id % 2 = 0 THEN '</BODY></html>' ELSE '' END AS h FROM pages), q AS (SELECT *, strpos(reverse(translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), '>ydob/<') AS place FROM p) SELECT page_id, md5(CASE WHEN place = 0 THEN h || chr(10) || '<i>x</i>' ELSE substring(h, 1, length(h) - place - 6) || '<i>x</i>' || chr(10) || substring(h, length(h) - place - 5) END) AS html FROM q")(
    lambda s, d: table(s, d, "pages").select("page_id", F.md5(text.inject_before_body_end(F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 2 == 0, "</BODY></html>").otherwise("")), F.lit("<i>x</i>"))).alias("html"))
)
query("q_validated_html", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'host reference' END AS rejected, CASE page_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 2 + len(regexp_extract_all(html, '(?i)<script')) END::BIGINT AS scripts, page_id % 4 IN (0, 3) AS no_text FROM pages WHERE html IS NOT NULL")(
    lambda s, d: table(s, d, "pages").where("html is not null").select("page_id", text.validate_html(F.when(F.col("page_id") % 4 == 0, " \n ").when(F.col("page_id") % 4 == 3, "<script></script><SCRIPT></SCRIPT>").otherwise(F.concat("html", F.lit("<p>w</p><script></script><SCRIPT></SCRIPT>"), F.when(F.col("page_id") % 4 == 1, "noteapp://x").otherwise(""))), "noteapp://").alias("v"))
    .select("page_id", "v.rejected", F.col("v.scripts").cast("long").alias("scripts"), "v.no_text")
)


@query(
    "q_code_blocks",
    "SELECT page_id, (page_id % 4)::BIGINT AS blocks, (page_id % 4)::BIGINT * (page_id % 2)::BIGINT AS rendered, array_to_string(list_transform(range(page_id % 4), lambda i: 'm' || page_id || ':a < ' || page_id || chr(10) || 'b'), ';') AS sources, CASE WHEN page_id % 2 = 1 THEN 0 ELSE page_id % 4 END::BIGINT AS made FROM pages",
)
def _code_blocks(s: SparkSession, d: str) -> DataFrame:
    """Pages with hidden code by rule, in every second page with its rendered mirror: blocks, and what making the others visible makes."""
    number = F.col("page_id").cast("string")
    mirror = F.when(F.col("page_id") % 2 == 1, F.lit('<cm><pre class="CodeMirror-line">a</pre></cm>')).otherwise("")
    one = F.concat(F.lit('<div data-mode="m'), number, F.lit('"></div><textarea style="display:none">a &lt; '), number, F.lit("\nb</textarea>"), mirror, F.lit("<p>between</p>"))
    html = F.concat(F.coalesce("html", F.lit("")), F.repeat(one, (F.col("page_id") % 4).cast("int")))
    own = table(s, d, "pages").select("page_id", html.alias("html"))
    made = render.materialize_code(F.col("html"), "cm")
    found = own.select("page_id", code_blocks_of("cm")(F.col("html")).alias("b"), made.alias("m"))
    return found.select(
        "page_id", F.size("b").cast("long").alias("blocks"), F.size(F.filter("b", lambda x: x["rendered"])).cast("long").alias("rendered"),
        F.array_join(F.transform("b", lambda x: F.concat(x["mode"], F.lit(":"), x["source"])), ";").alias("sources"), F.col("m.n").cast("long").alias("made"),
    )


def code_blocks_of(mirror: str):
    """markdown.find_blocks of a column, with the tag that rendered lines are in."""

    @in_bounded_batches
    @F.pandas_udf(markdown._BLOCKS)
    def blocks(html):
        return html.map(lambda t: markdown.find_blocks(t or "", mirror))

    return blocks


@query(
    "q_converted_parts",
    """WITH p AS (SELECT page_id, 'w' || page_id AS w, page_id % 5 AS n FROM pages)
SELECT page_id, CASE page_id % 6
 WHEN 0 THEN array_to_string(list_transform(range(n + 1), lambda i: (i + 1) || '. ' || w), chr(10))
 WHEN 1 THEN '```py' || chr(10) || w || repeat(chr(10) || 'x', n) || chr(10) || '```'
 WHEN 2 THEN '| ' || w || ' | b |' || chr(10) || '| --- | --- |' || repeat(chr(10) || '| 1<br>2 | \\| |', n)
 WHEN 3 THEN w || repeat(' a**b**', n)
 WHEN 4 THEN '```' || chr(10) || w || repeat(chr(10) || 'y = ' || w, n) || chr(10) || '```'
 ELSE w || ' | ' || w || chr(10) || 'c' END AS md FROM p""",
)
def _converted_parts(s: SparkSession, d: str) -> DataFrame:
    """Lists, code with parts that are none, tables, empty marks, code tables and merged cells, by rule; their Markdown to the letter."""
    w, n, kind = F.concat(F.lit("w"), F.col("page_id").cast("string")), (F.col("page_id") % 5).cast("int"), F.col("page_id") % 6
    cat = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    html = (
        F.when(kind == 0, cat("<canvas>no</canvas><ol>", F.repeat(cat("<li>", w, "</li>"), n + 1), "</ol>"))
        .when(kind == 1, cat('<pre class="language-py"><button>Copy</button><code>', w, F.repeat(F.lit("\nx"), n), '</code><div class="btn-copy">no</div><ul class="pre-numbering"><li>1</li></ul></pre>'))
        .when(kind == 2, cat("<table><tr><th>", w, "</th><th>b</th></tr>", F.repeat(F.lit("<tr><td>1<br>2</td><td>|</td></tr>"), n), "</table>"))
        .when(kind == 3, cat("<title>no</title><p>", w, F.repeat(F.lit("<i> </i>a<b>b</b><b></b>"), n), "</p>"))
        .when(kind == 4, cat('<table class="crayon-table"><tr><td class="crayon-nums">1</td><td>', w, "</td></tr>", F.repeat(cat('<tr><td class="nums">2</td><td>y = ', w, "</td></tr>"), n), "</table>"))
        .otherwise(cat("<table><tr><td>", w, "</td><td>", w, '</td></tr><tr><td colspan="2">c</td></tr></table>'))
    )
    return table(s, d, "pages").select("page_id", markdown.html_to_md(html).alias("md"))


# ---- changes of rows

_EVENTS = """m AS (SELECT guid, title, location || guid || '.zip' AS path, md5(body) AS md5, data_modified, doc_id % 5 AS revision, doc_id % 7 = 0 AS info, doc_id % 13 = 0 AS data, doc_id, doc_id % 9 AS k FROM note WHERE doc_id % 11 <> 0),
 x AS (SELECT guid, title, location || guid || '.zip' AS path, md5(body) AS md5, data_modified, doc_id % 5 AS revision, doc_id, doc_id % 9 AS k FROM note WHERE doc_id % 22 = 0)"""


@query(
    "q_rows_changed",
    f"""{WITH}, {_EVENTS}
SELECT 'row' AS kind, guid, CASE WHEN k = 2 THEN 'new ' || guid ELSE title END AS title, CASE WHEN k IN (2, 3) THEN 'moved/' || guid ELSE path END AS path, CASE WHEN k = 1 THEN 'other' ELSE md5 END AS md5, CASE WHEN k IN (0, 1) THEN '2025-01-01' ELSE data_modified END AS at,
 revision + CASE WHEN k IN (0, 1, 2, 3) THEN 1 ELSE 0 END AS revision, info OR k IN (2, 3) AS dirty_info, data OR k = 1 AS dirty_data FROM m WHERE k <> 4
UNION ALL SELECT 'row', guid, 'new ' || guid, 'moved/' || guid, 'other', '2025-01-01', 0, true, true FROM note WHERE doc_id % 11 = 0 AND doc_id % 9 = 6
UNION ALL SELECT 'row', guid, title, path, md5, data_modified, revision + 1, false, true FROM x WHERE k = 5
UNION ALL SELECT 'tombstone', guid, title, path, md5, '2025-01-01', revision, info, data FROM m WHERE k = 4
UNION ALL SELECT 'tombstone', guid, title, path, md5, '2024-12-31', revision, false, false FROM x WHERE k <> 5""",
)
def _rows_changed(s: SparkSession, d: str) -> DataFrame:
    """Saves (of the same and of other bytes), renames, moves, deletes, restores and creations of notes by rule; the manifest and the tombstones after them."""
    i = F.col("doc_id")
    n = notes(s, d)
    row = ["guid", "title", F.concat("location", "guid", F.lit(".zip")).alias("path"), F.md5("body").alias("md5"), "data_modified", (i % 5).alias("revision"), F.lit(0).cast("long").alias("synced_revision")]
    manifest = n.where("doc_id % 11 <> 0").select(*row, (i % 7 == 0).alias("dirty_info"), (i % 13 == 0).alias("dirty_data"))
    gone = n.where("doc_id % 22 = 0").select(*row, F.lit(False).alias("dirty_info"), F.lit(False).alias("dirty_data"))
    gone = gone.select("guid", F.lit("2024-12-31").alias("removed_at"), F.to_json(F.struct(*manifest.columns)).alias("payload"), F.lit(0).cast("long").alias("synced_revision"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("save", "save", "rename", "move", "delete", "restore", "create")]), (i % 9 + 1).cast("int"))
    events = n.where("doc_id % 9 < 7").select("guid", kind.alias("kind"), F.concat(F.lit("new "), "guid").alias("title"), F.concat(F.lit("moved/"), "guid").alias("path"), F.when(i % 9 == 0, F.md5("body")).otherwise("other").alias("md5"), F.lit("2025-01-01").alias("at"))
    rows, tombs = writes.apply_events(manifest, gone, events)
    told = tombs.select("guid", "removed_at", F.from_json("payload", writes.COLUMNS).alias("r"))
    columns = ["guid", "title", "path", "md5", "at", "revision", "dirty_info", "dirty_data"]
    return rows.withColumnRenamed("data_modified", "at").select(F.lit("row").alias("kind"), *columns).unionByName(told.select(F.lit("tombstone").alias("kind"), "guid", "r.title", "r.path", "r.md5", F.col("removed_at").alias("at"), "r.revision", "r.dirty_info", "r.dirty_data"))


query("q_upserted", f"{WITH} SELECT guid, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE title END AS title, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 ELSE true END AS dirty_info, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 = 0 ELSE true END AS dirty_data FROM note WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0")(
    lambda s, d: lib.upsert(notes(s, d).where("doc_id % 3 <> 0").select("guid", "title", (F.col("doc_id") % 2 == 0).alias("dirty_info"), (F.col("doc_id") % 5 == 0).alias("dirty_data")), notes(s, d).where("doc_id % 4 = 0").select("guid", F.lit("new").alias("title")))
)

# ---- settings

@query("q_settings_read", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'full' ELSE coalesce(lang, 'full') END AS policy, CASE doc_id % 4 WHEN 2 THEN doc_id ELSE 4 END AS workers FROM documents")
def _settings_read(s: SparkSession, d: str) -> DataFrame:
    """A line of settings for each document: with none of the keys, with a key's older name, whole, or with both names of a key."""
    i, lang = F.col("doc_id"), F.col("lang")
    own = [("older", F.struct(lang.alias("mode"), i.alias("doc_id")), 1), ("whole", F.struct(lang.alias("policy"), i.alias("workers"), i.alias("doc_id")), 2), ("both", F.struct(F.lit("older").alias("mode"), lang.alias("policy"), i.alias("doc_id")), 3)]
    value = F.when(i % 4 == 0, F.concat(F.lit('{"doc_id": '), i.cast("string"), F.lit("}")))
    for _, row, kind in own:
        value = value.when(i % 4 == kind, F.to_json(row))
    return settings(table(s, d, "documents").select(value.alias("value")), {"doc_id": ("long", -1), "policy": ("string", "full"), "workers": ("long", 4)}, {"mode": "policy"})


query("q_folder_positions", f"{WITH}, f AS (SELECT DISTINCT location FROM note) SELECT location AS path, length(location)::BIGINT AS pos FROM f")(
    lambda s, d: folder_positions(notes(s, d).select("location").distinct().groupBy().agg(F.to_json(F.map_from_entries(F.collect_set(F.struct("location", F.length("location").cast("long"))))).alias("value")).select(F.lit("SYNC_INFO").alias("group"), F.lit("FOLDERS_POS").alias("key"), "value"))
)
query("q_settings_problems", """SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'endpoint is empty' WHEN 1 THEN 'endpoint has no scheme' WHEN 2 THEN 'endpoint is public and not https' WHEN 3 THEN 'bucket' WHEN 4 THEN 'prefix' WHEN 5 THEN 'concurrency' WHEN 6 THEN 'role' ELSE '' END AS problem FROM customer""")(
    lambda s, d: table(s, d, "customer").select("c_custkey", F.coalesce(checks.settings_problem(_settings_of(F.col("c_custkey"))), F.lit("")).alias("problem"))
)


def _settings_of(i):
    """Replication settings by rule, of nine kinds."""
    kind, name = i % 9, i.cast("string")
    endpoint = F.when(kind == 0, " / ").when(kind == 1, F.concat(F.lit("host"), name)).when(kind == 2, F.concat(F.lit("http://8.8.8."), (i % 256).cast("string"))).when(kind == 7, F.concat(F.lit("http://10.0.0."), (i % 256).cast("string"), F.lit(":9000/"))).otherwise(F.concat(F.lit("https://s3.example/"), name))
    return F.struct(
        endpoint.alias("endpoint"), F.when(kind == 3, F.concat(F.lit("Bucket"), name)).otherwise(F.concat(F.lit("bucket-"), name)).alias("bucket"), F.when(kind == 4, F.concat(F.lit("a/../"), name)).otherwise(F.concat(F.lit("a/"), name)).alias("prefix"),
        F.when(kind == 5, F.lit(17)).otherwise(i % 16 + 1).alias("concurrency"), F.when(kind == 6, "owner").when(kind == 7, "export").otherwise("reader").alias("role"),
    )
