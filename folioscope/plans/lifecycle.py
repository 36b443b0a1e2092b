"""Queries of the library over time, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import checks
from folioscope.operators import library as lib
from folioscope.operators import lifecycle as life
from folioscope.operators import search
from folioscope.plans.registry import _ATT, _EXTRACT, _FOLD, FP, LOCAL, REMOTE, TOMBS, WITH, _bm25_sql, _names, _records, query
from folioscope.sources.index import Index
from folioscope.sources.packages import disk_dirs
from folioscope.sources.store import shared_folder
from folioscope.sources.views import manifest, notes, table, tombstones
from folioscope.streaming import keyed

# ---- search response


def _response_sql(kw: str, folder: str | None = None) -> str:
    inner = _bm25_sql(kw, folder).replace("SELECT guid, title, location, round(score, 6) AS score,", "SELECT guid, title, location, body, round(score, 6) AS score,")
    at = f"instr(lower(body), '{kw}')"
    cut = f"substring(body, greatest(1, {at} - {(22 - len(kw)) // 2}), 22)"
    mark = lambda c: f"regexp_replace({c}, '(?i)({kw})', '<mark>\\1</mark>', 'g')"
    return f"""SELECT 'note' AS kind, guid AS id, {mark('title')} AS title, location AS place, CASE WHEN {at} = 0 THEN substring(body, 1, 22) ELSE {mark(cut)} END AS snippet, hit_in, score, dup_count FROM ({inner})
UNION ALL SELECT 'attachment', item_id::VARCHAR, text, '', '', 'name', 0.0, 1 FROM benchmark WHERE {_FOLD.format('text')} LIKE '%{kw}%'"""


_files = lambda s, d: table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("file_path"), F.col("text").alias("display_name"), F.lit(None).cast("string").alias("db_name"), F.lit(4).alias("tier"))
query("q_search_response", _response_sql("wher"))(lambda s, d: search.respond(notes(s, d), _files(s, d), " wher "))
query("q_search_response_folder", _response_sql("thin", "/en/src1"))(lambda s, d: search.respond(notes(s, d), _files(s, d), "thin", "/en/src1"))

query("q_search_response_short", f"""SELECT 'note' AS kind, guid AS id, title, location AS place, replace(substring(body, greatest(1, instr(body, 'zt') - 40)::BIGINT, 120), 'zt', '<mark>zt</mark>') AS snippet,
 CASE WHEN contains({_FOLD.format('title')}, 'zt') THEN 'title' ELSE 'body' END AS hit_in, 0.0::DOUBLE AS score, dup_count FROM (
 {WITH}, t AS (SELECT * FROM note WHERE {' OR '.join(_FOLD.format(c) + " LIKE '%zt%'" for c in ('title', 'body', 'location'))} ORDER BY guid LIMIT 200),
 f AS (SELECT *, CASE WHEN body = '' THEN guid ELSE {FP} END AS fp FROM t), w AS (SELECT *, CASE WHEN body = '' THEN 1 ELSE count(*) OVER (PARTITION BY fp) END AS dup_count, row_number() OVER (PARTITION BY fp ORDER BY guid) AS n FROM f) SELECT * FROM w WHERE n = 1)
UNION ALL SELECT 'attachment', item_id::VARCHAR, text, '', '', 'name', 0.0, 1 FROM benchmark WHERE {_FOLD.format('text')} LIKE '%zt%'""")(lambda s, d: search.respond(notes(s, d), _files(s, d), "zt"))

# ---- admission

_PATH = "location || guid || '.zip'"
_UNSAFE = "CASE WHEN doc_id % 31 = 0 THEN '/../' ELSE '' END"
_rows = lambda s, d: notes(s, d).select("guid", "doc_id", F.concat(F.when(F.col("doc_id") % 31 == 0, "../").otherwise(""), F.ltrim(F.concat("location", "guid", F.lit(".zip")), F.lit("/"))).alias("path"))
_there = lambda s, d: _rows(s, d).where("doc_id % 23 <> 0").select("path")
_ROWS = "r AS (SELECT guid, doc_id, CASE WHEN doc_id % 31 = 0 THEN '../' ELSE '' END || ltrim(location || guid || '.zip', '/') AS path FROM note)"


@query(
    "q_admission",
    f"""{WITH}, {_ROWS}, p AS (SELECT guid, CASE WHEN doc_id % 31 = 0 THEN 'unsafe: ' || path WHEN doc_id % 23 = 0 THEN 'missing: ' || guid || ' ' || path END AS problem FROM r)
SELECT 'ready' AS status, '' AS reason, count(*) AS note_count, count(problem) AS missing_files, array_to_string(list_concat(list(problem ORDER BY guid) FILTER (problem IS NOT NULL)[1:10], CASE WHEN count(problem) BETWEEN 1 AND 9 THEN ['in all: ' || count(problem)] ELSE [] END), chr(10)) AS warnings FROM p
UNION ALL SELECT 'rejected', 'export_mode', 0, 0, '' UNION ALL SELECT 'rejected', 'schema_version', 0, 0, '' UNION ALL SELECT 'rejected', 'directory', 0, 0, '' UNION ALL SELECT 'no_manifest', '', 0, 0, '' UNION ALL SELECT 'empty', '', 0, 0, ''""",
)
def _admission(s: SparkSession, d: str) -> DataFrame:
    rows, files = _rows(s, d), _there(s, d)
    meta = lambda **kv: s.createDataFrame(list(kv.items()), "key string, value string")
    cases = [
        life.admission(rows, files, meta(schema_version="6", export_mode="md")), life.admission(rows, files, meta(export_mode="other")), life.admission(rows, files, meta(schema_version="7")),
        life.admission(rows, files, exists=False), life.admission(rows, files, has_manifest=False), life.admission(rows, files.where("path like '%.txt'"), has_manifest=False),
    ]
    out = cases[0]
    for c in cases[1:]:
        out = out.unionByName(c)
    return out.withColumn("warnings", F.array_join("warnings", "\n"))


query("q_resolved", f"{WITH}, {_ROWS} SELECT note.guid, 'lib/' || path AS path FROM note JOIN r USING (guid) WHERE r.doc_id % 31 <> 0 AND r.doc_id % 5 <> 0 UNION ALL SELECT guid, 'notes/{{' || guid || '}}' FROM note")(
    lambda s, d: life.resolved(n := notes(s, d).select("guid"), _rows(s, d).where("doc_id % 5 <> 0"), "lib/").unionByName(life.resolved(n, None))
)

# ---- the derived index

_INDEX = f"ix AS (SELECT guid, title, location, coalesce(text, '') AS body, length(coalesce(text, ''))::BIGINT AS body_len, CASE WHEN coalesce(text, '') = '' THEN '' ELSE {FP} END AS fingerprint, text IS NOT NULL AS downloaded, note.doc_id FROM note JOIN documents USING (doc_id))"
_IX = "guid, title, location, body, body_len, fingerprint, downloaded"


def _with_bodies(s: SparkSession, d: str) -> DataFrame:
    """Notes whose bodies are null where the documents' texts are; where doc_id is a key, each row has its text at hand and none is shuffled."""
    own = notes(s, d, nulls=True).where("doc_id is not null")
    if own.groupBy("doc_id").count().where("count > 1").isEmpty():
        return own
    return own.drop("body").join(own.select("doc_id", "body"), "doc_id")


query("q_index_rows", f"{WITH}, {_INDEX} SELECT {_IX} FROM ix")(lambda s, d: life.index_rows(_with_bodies(s, d)))


@query(
    "q_index_refreshed",
    f"{WITH}, {_INDEX} SELECT guid, CASE WHEN doc_id % 3 <> 0 THEN 'old' ELSE title END AS title, location, body, body_len, fingerprint, downloaded FROM ix WHERE doc_id % 6 <> 0",
)
def _refreshed(s: SparkSession, d: str) -> DataFrame:
    """An index with old titles; of the keys, every third note, half exist still and half are gone."""
    n = _with_bodies(s, d)
    old = life.index_rows(n.withColumn("title", F.lit("old")))
    keys = n.where("doc_id % 3 = 0").select("guid")
    return life.refreshed(old, n.where("doc_id % 6 <> 0"), keys)


@query("q_index_kept_up", f"{WITH}, {_INDEX} SELECT {_IX} FROM ix")
def _kept_up(s: SparkSession, d: str) -> DataFrame:
    """An index that lacks rows which no change names: the check of its size finds it, and it is made anew."""
    n = _with_bodies(s, d)
    return life.kept_up(life.index_rows(n.where("doc_id % 5 <> 0")), n, n.where("doc_id = 5").select("guid"))


def _own_index(s: SparkSession, name: str) -> Index:
    return Index(s, f"{shared_folder(s)}/folioscope-index/{name}-{uuid.uuid4().hex}")


@query(
    "q_index_stored",
    f"{WITH}, {_INDEX} SELECT {_IX} FROM ix WHERE doc_id % 6 <> 0 UNION ALL SELECT 'keyword ' || k, '', '', '', k, '', false FROM (SELECT unnest([1, 2]) AS k)",
)
def _stored(s: SparkSession, d: str) -> DataFrame:
    """A stored index of old titles, made again after a user's history was put, then two merges: some rows made anew, some gone.  Read back with the history."""
    n, own = _with_bodies(s, d), _own_index(s, "stored")
    own.build(n.withColumn("title", F.lit("old")))
    own.put("search_history", s.createDataFrame([("keyword 1", 1), ("keyword 2", 2)], "keyword string, ts long"))
    own.build(n.withColumn("title", F.when(F.col("doc_id") % 4 < 2, F.lit("old")).otherwise(F.col("title"))))
    own.sweep(keep=1)
    own.merge(n.where("doc_id % 6 = 0").select("guid"), n.where("doc_id % 6 <> 0"))
    own.merge(n.where("doc_id % 4 < 2").select("guid"), n.where("doc_id % 6 <> 0"))
    users = own.table("search_history").select(F.col("keyword").alias("guid"), F.lit("").alias("title"), F.lit("").alias("location"), F.lit("").alias("body"), F.col("ts").alias("body_len"), F.lit("").alias("fingerprint"), F.lit(False).alias("downloaded"))
    return own.table("note").select(*users.columns).unionByName(users)


@query("q_search_merged", _bm25_sql("ent").replace("doc_id FROM documents)", "doc_id FROM documents WHERE doc_id % 6 <> 1)"))
def _search_merged(s: SparkSession, d: str) -> DataFrame:
    """A stored index that a merge has brought up to date (rows added, rows made anew, rows gone), searched by its postings."""
    n, own = notes(s, d), _own_index(s, "merged")
    own.build(n.where("doc_id % 5 <> 0").withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.concat("body", F.lit(" ent ent ent"))).otherwise(F.col("body"))))
    own.merge(n.where("doc_id % 5 = 0 or doc_id % 7 = 0 or doc_id % 6 = 1").select("guid"), n.where("doc_id % 6 <> 1"))
    return search.search_index(own, "ent")


_FOLDERS = """f AS (SELECT DISTINCT unnest(list_transform(range(1, len(p) + 1), lambda i: '/' || array_to_string(p[1:i], '/') || '/')) AS path FROM (SELECT string_split(trim(location, '/'), '/') AS p FROM note WHERE location <> '//')
 UNION SELECT '/old/' || (doc_id % 40) || '/' FROM note)"""
_folders = lambda s, d: lib.folder_rows(notes(s, d)).select("path").unionByName(notes(s, d).select(F.concat(F.lit("/old/"), (F.col("doc_id") % 40).cast("string"), F.lit("/")).alias("path")).distinct())
_dirs = lambda s, d: notes(s, d).where("doc_id % 40 < 10").select(F.concat(F.lit("old/"), (F.col("doc_id") % 40).cast("string")).alias("path")).distinct()
query("q_folders_pruned", f"{WITH}, {_FOLDERS} SELECT path FROM f WHERE path IN (SELECT location FROM note) OR path IN (SELECT '/old/' || (doc_id % 40) || '/' FROM note WHERE doc_id % 40 < 10)")(
    lambda s, d: life.pruned(_folders(s, d), notes(s, d), _dirs(s, d))
)
query("q_folders_rebuilt", f"""{WITH}, {_FOLDERS} SELECT path, CASE WHEN path IN (SELECT location FROM note) THEN length(path) ELSE -1 END::BIGINT AS pos FROM f WHERE path NOT LIKE '/old/%' OR path IN (SELECT '/old/' || (doc_id % 40) || '/' FROM note WHERE doc_id % 40 < 10)""")(
    lambda s, d: life.rebuilt(
        n := notes(s, d), n.select(F.col("location").alias("path")).distinct().select("path", F.length("path").alias("pos")).unionByName(s.createDataFrame([("/never/", 3)], "path string, pos int")), n.where("false"),
        _dirs(s, d).select(F.concat(F.lit("/"), "path", F.lit("/")).alias("path")),
    )["folder"].where("path <> '//'").select("path", F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"))
)
query("q_folder_siblings", f"""{WITH}, {_FOLDERS}, p AS (SELECT path, regexp_replace(path, '[^/]+/$', '') AS parent, CASE WHEN length(path) % 2 = 0 THEN -length(path) END AS pos FROM f)
SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY coalesce(pos, 9223372036854775807), path)::INTEGER AS place, path, coalesce(pos, 0)::BIGINT AS pos FROM p""")(
    lambda s, d: life.siblings(_folders(s, d).withColumn("pos", F.when(F.length("path") % 2 == 0, -F.length("path")).cast("long"))).withColumn("pos", F.coalesce("pos", F.lit(0)).cast("long"))
)
query("q_folder_children", f"{WITH}, {_FOLDERS} SELECT a.path, b.path AS child FROM f a JOIN f b ON starts_with(b.path, a.path) AND a.path <> b.path AND NOT contains(trim(substring(b.path, length(a.path) + 1), '/'), '/')")(lambda s, d: life.children(_folders(s, d)))
query("q_disk_dirs", """WITH x AS (SELECT DISTINCT string_split(ltrim(replace(url, 'https:/', ''), '/'), '/') AS p FROM pages WHERE url IS NOT NULL), y AS (SELECT DISTINCT unnest(list_transform(range(1, least(len(p) - 1, 16) + 1), lambda i: list_filter(p[1:i], lambda e: e <> ''))) AS p FROM x)
SELECT DISTINCT '/' || array_to_string(p, '/') || '/' AS path FROM y WHERE len(p) > 0 AND len(list_filter(p, lambda e: starts_with(e, '_') OR starts_with(e, '.'))) = 0""")(
    lambda s, d: disk_dirs(table(s, d, "pages").where("url is not null").select(F.ltrim(F.replace("url", F.lit("https:/"), F.lit("")), F.lit("/")).alias("path")))
)

# ---- rows of interest

query("q_under_folder", f"{WITH} SELECT guid FROM note WHERE starts_with({_FOLD.format('location')}, '/en/src1')")(lambda s, d: life.under(notes(s, d), "/EN/src1").select("guid"))
query("q_ever_edited", f"{WITH} SELECT guid FROM note WHERE doc_id % 4 > 0")(lambda s, d: life.ever_edited(notes(s, d).withColumn("revision", F.col("doc_id") % 4)).select("guid"))
query("q_unpublished", f"{WITH}, {TOMBS} SELECT guid, removed_at FROM lt WHERE synced_revision = 0 ORDER BY guid")(lambda s, d: life.unpublished(tombstones(s, d, "local")).select("guid", "removed_at"))
query("q_unlinked", f"{_ATT} SELECT file_path, display_name FROM a WHERE tier = 4 AND source = 'unlinked'")(lambda s, d: life.unlinked(lib.attribute(_names(s, d), notes(s, d), _records(s, d))[0]).select("file_path", "display_name"))
query("q_unsynced_attachments", "SELECT item_id::VARCHAR AS file_path FROM benchmark WHERE item_id % 3 <> 0")(lambda s, d: life.unsynced_attachments(_files(s, d).withColumn("dirty", F.col("file_path").cast("long") % 3)).select("file_path"))
query("q_missing_attachments", f"{_ATT} SELECT file_path FROM a WHERE starts_with(file_path, 'db-missing:')")(lambda s, d: lib.attribute(_names(s, d), notes(s, d), _records(s, d))[0].where(life.missing_attachment(F.col("file_path"))).select("file_path"))
query("q_warnings_by_kind", f"""{WITH} SELECT CASE WHEN doc_id % 2 = 0 THEN 'no file: ' ELSE 'size: ' END || guid AS warning, CASE WHEN doc_id % 2 = 0 THEN 'absent' ELSE 'problem' END AS kind FROM note""")(
    lambda s, d: life.warnings_by_kind(notes(s, d).select(F.concat(F.when(F.col("doc_id") % 2 == 0, "no file: ").otherwise("size: "), "guid").alias("warning")), "no file", True)
)
query("q_attachment_audit", """WITH x AS (SELECT item_id, item_id % 5 AS tier FROM benchmark), k AS (SELECT '_attachments/' || item_id AS path FROM x WHERE item_id % 3 <> 0), l AS (SELECT '_attachments/' || item_id AS path FROM x WHERE tier <> 0 AND item_id % 4 <> 0)
SELECT path, 'no row' AS problem FROM k WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT path, 'no file' FROM l WHERE path NOT IN (SELECT path FROM k)""")(
    lambda s, d: life.attachment_audit(
        table(s, d, "benchmark").where("item_id % 4 <> 0").select(F.concat(F.lit("attachments/"), F.col("item_id").cast("string")).alias("file_path"), (F.col("item_id") % 5).alias("tier")),
        table(s, d, "benchmark").where("item_id % 3 <> 0").select(F.concat(F.lit("_attachments/"), F.col("item_id").cast("string")).alias("path")).unionByName(s.createDataFrame([("_attachments/.DS_Store",), ("en/1.zip",)], "path string")),
    )
)
_WS = r"[\s\x0b\x85\pZ]"
_PROBE = "CASE WHEN regexp_matches(html, '(?is)<body[^>]*>.*</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) ELSE html END"
for _p in ("(?is)<style.*?</style>", "(?is)<script.*?</script>", "(?s)<[^>]+>"):
    _PROBE = f"regexp_replace({_PROBE}, '{_p}', ' ', 'g')"
for _n, _b in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
    _PROBE = f"replace({_PROBE}, '&{_n};', '{_b}')"
_PROBE = f"length(trim(regexp_replace({_PROBE}, '{_WS}+', ' ', 'g')))::BIGINT"
query("q_probe_length", f"SELECT page_id, {_PROBE} AS n FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", life.probe_length(F.col("html")).alias("n")))



@query(
    "q_corpus_counters",
    f"""WITH x AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL ELSE html || CASE WHEN page_id % 5 = 0 THEN '<textarea style="display: none">c</textarea><img src="https://r/x"><img src=''//r/y''>' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN '<body>tiny' || chr(65533) || '</body>' ELSE '' END END AS html FROM pages),
y AS (SELECT html, CASE WHEN page_id % 3 = 0 THEN length({_EXTRACT}) ELSE page_id % 20 END AS body_len, length({_EXTRACT}) AS n, {_PROBE} AS p,
 len(regexp_extract_all(html, '(?is)<textarea[^>]*display\\s*:\\s*none')) AS h, len(list_filter(regexp_extract_all(html, '(?i)src\\s*=\\s*["'']([^"'']+)["'']', 1), lambda u: starts_with(u, 'http://') OR starts_with(u, 'https://') OR starts_with(u, '//'))) AS r FROM x)
SELECT count(*) AS notes, count(*) FILTER (html IS NULL) AS open_fail, count(*) FILTER (contains(html, chr(65533))) AS mojibake, coalesce(sum(h), 0)::BIGINT AS hidden_code, count(*) FILTER (h > 0) AS hidden_code_notes, count(*) FILTER (n <> body_len) AS length_differs,
 count(*) FILTER (html IS NOT NULL AND body_len < 10) AS near_empty_index, count(*) FILTER (p < 10) AS near_empty_probe, coalesce(sum(r), 0)::BIGINT AS remote_sources, count(*) FILTER (r > 0) AS remote_source_notes, count(*) FILTER (regexp_matches(html, '(?i)<script')) AS script_notes FROM y""",
)
def _counters(s: SparkSession, d: str) -> DataFrame:
    """Pages with what the counters look for added by rule."""
    i = F.col("page_id")
    hidden = F.when(i % 5 == 0, """<textarea style="display: none">c</textarea><img src="https://r/x"><img src='//r/y'>""").otherwise("")
    html = F.when(i % 11 != 0, F.concat("html", hidden, F.when(i % 7 == 0, "<body>tiny\ufffd</body>").otherwise("")))
    own = table(s, d, "pages").select(i.cast("string").alias("guid"), i, html.alias("html"))
    return life.corpus_counters(own.withColumn("body_len", F.when(i % 3 == 0, F.length(text.extract_text(F.col("html")))).otherwise(i % 20)))


# ---- attachments


@query(
    "q_attachments_from_index",
    """WITH x AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN '/elsewhere/' ELSE '/data/' END || item_id AS p, item_id % 3 AS docs FROM benchmark)
SELECT 'row' AS kind, item_id::VARCHAR AS file_path, CASE WHEN docs = 1 THEN 'd' || item_id WHEN docs = 2 THEN NULL ELSE 'own' END AS document_guid FROM x WHERE item_id % 7 <> 0
UNION ALL SELECT 'bridge', item_id::VARCHAR, 'd' || (item_id + k) FROM x, (SELECT unnest([0, 1]) AS k) WHERE docs = 2 AND item_id % 7 <> 0
UNION ALL SELECT 'outside', p, NULL FROM x WHERE item_id % 7 = 0""",
)
def _from_index(s: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    path = F.concat(F.when(i % 7 == 0, "/elsewhere/").otherwise("/data/"), i.cast("string"))
    own = table(s, d, "benchmark").select(path.alias("file_path"), F.col("text").alias("display_name"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("int").alias("tier"), F.when(i % 3 == 0, "own").alias("document_guid"), F.lit("x").alias("source"))
    docs = table(s, d, "benchmark").where("item_id % 3 > 0").select(path.alias("file_path"), F.explode(F.sequence(i, i + i % 3 - 1)).alias("k")).select("file_path", F.concat(F.lit("d"), F.col("k").cast("string")).alias("document_guid"))
    rows, bridge, outside = life.attachments_from_index(own, docs.unionAll(docs), "/data/")
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "file_path", "document_guid")
    return kind(rows, "row").unionAll(kind(bridge, "bridge")).unionAll(kind(outside.withColumn("document_guid", F.lit(None).cast("string")), "outside"))


@query(
    "q_added_files",
    f"""{WITH}, x AS (SELECT guid || '.PNG' AS name, md5(body) AS md5, package_size AS size, doc_id FROM note), h AS (SELECT md5, min('img/' || name) AS held FROM x WHERE doc_id % 9 = 0 GROUP BY 1), f AS (SELECT md5, min(name) AS first FROM x WHERE size <= 4000 GROUP BY 1)
SELECT name, CASE WHEN size <= 4000 THEN coalesce(held, replace(first, '.PNG', '') || '_' || substring(md5, 1, 8) || '.png') END AS path, CASE WHEN size > 4000 THEN 'too large' WHEN held IS NOT NULL OR name <> first THEN 'reuse' ELSE 'write' END AS action FROM x LEFT JOIN h USING (md5) LEFT JOIN f USING (md5)""",
)
def _added(s: SparkSession, d: str) -> DataFrame:
    x = notes(s, d).select(F.concat("guid", F.lit(".PNG")).alias("name"), F.md5("body").alias("md5"), F.col("package_size").alias("size"), "doc_id")
    return life.added_files(x.where("doc_id % 9 = 0").select(F.concat(F.lit("img/"), "name").alias("path"), "md5"), x.drop("doc_id"), 4000)


query("q_unique_names", f"""{WITH}, x AS (SELECT location AS scope, doc_id AS "at", 'n' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END AS name FROM note), y AS (SELECT *, row_number() OVER (PARTITION BY scope, name ORDER BY "at") AS n FROM x)
SELECT scope, "at", name, CASE WHEN n = 1 THEN name ELSE replace(name, '.txt', '') || '_' || n || CASE WHEN contains(name, '.') THEN '.txt' ELSE '' END END AS "unique" FROM y""")(
    lambda s, d: life.unique_names(notes(s, d).select(F.col("location").alias("scope"), F.col("doc_id").alias("at"), F.concat(F.lit("n"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise("")).alias("name")))
)

# ---- replicas

_two = lambda s, d: (manifest(s, d, "local"), manifest(s, d, "remote"))
query("q_sync_down", f"""{WITH}, {LOCAL}, {REMOTE}, k AS (SELECT l.guid, l.md5, l.path, l.synced_revision, true AS dirty_info, true AS dirty_data FROM l JOIN r USING (guid) WHERE (l.dirty_info OR l.dirty_data) AND l.md5 <> r.md5)
SELECT * FROM k UNION ALL SELECT guid, md5, path, synced_revision, false, false FROM r WHERE guid NOT IN (SELECT guid FROM k)""")(lambda s, d: life.sync_down(*_two(s, d), 3, 9))
query("q_sync_down_reader", f"{WITH}, {REMOTE} SELECT guid, md5, path, synced_revision, false AS dirty_info, false AS dirty_data FROM r")(lambda s, d: life.sync_down(*_two(s, d), 3, 9, "reader"))
query("q_sync_down_not_behind", f"{WITH}, {LOCAL} SELECT * FROM l")(lambda s, d: life.sync_down(*_two(s, d), 9, 9))
query("q_buried", f"""{WITH}, {LOCAL}, {TOMBS}, g AS (SELECT guid FROM l WHERE guid::BIGINT % 4 = 0) SELECT 'note' AS kind, guid, '' AS removed_at FROM l WHERE guid NOT IN (SELECT guid FROM g)
UNION ALL SELECT 'deleted', guid, '2024-03-15' FROM g UNION ALL SELECT 'deleted', guid, removed_at FROM lt WHERE guid NOT IN (SELECT guid FROM g)""")(
    lambda s, d: (lambda kept, gone: kept.select(F.lit("note").alias("kind"), "guid", F.lit("").alias("removed_at")).unionByName(gone.select(F.lit("deleted").alias("kind"), "guid", "removed_at")))(
        *life.buried(manifest(s, d, "local"), notes(s, d).where("doc_id % 4 <> 0"), tombstones(s, d, "local"), "2024-03-15")
    )
)


@query(
    "q_manifest_rebuilt",
    f"""{WITH}, x AS (SELECT guid, doc_id, trim(location, '/') || '/n' || guid || '.zip' AS path, body FROM note) SELECT guid, path, md5(body) AS md5, doc_id % 6 <> 5 AS found, 0::BIGINT AS synced_revision, true AS dirty FROM x WHERE doc_id % 6 <> 5
UNION ALL SELECT guid, '', '', false, -1, false FROM x WHERE doc_id % 6 = 5""",
)
def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    n = notes(s, d).withColumn("title", F.concat(F.lit("n"), "guid"))
    path = F.concat(F.btrim("location", F.lit("/")), F.lit("/n"), "guid", F.lit(".zip"))
    files = n.where("doc_id % 6 <> 5").select(path.alias("path"), F.md5("body").alias("md5"), F.col("package_size").alias("size"))
    rows, missing = life.rebuilt_manifest(n, lib.export_names(n), files)
    gone = missing.select("guid", F.lit("").alias("path"), F.lit("").alias("md5"), F.lit(False).alias("found"), F.lit(-1).cast("long").alias("synced_revision"), F.lit(False).alias("dirty"))
    return rows.select("guid", "path", "md5", F.lit(True).alias("found"), "synced_revision", (F.col("dirty_info") & F.col("dirty_data")).alias("dirty")).unionByName(gone)


@query(
    "q_keyed_state",
    """WITH e AS (SELECT user_id::VARCHAR AS guid, epoch_us(ts) AS ts, CASE event_type WHEN 'signup' THEN 'sync' WHEN 'error' THEN 'delete' ELSE event_type END AS event FROM events WHERE user_id IS NOT NULL)
SELECT guid, max(ts) AS ts, arg_max(event, printf('%020d', ts) || event) AS event, count(*) AS writes, coalesce(max(ts) FILTER (event = 'click') > coalesce(max(ts) FILTER (event = 'sync'), -1), false) AS dirty_info,
 coalesce(max(ts) FILTER (event IN ('view', 'delete')) > coalesce(max(ts) FILTER (event = 'sync'), -1), false) AS dirty_data, arg_max(event, printf('%020d', ts) || event) = 'delete' AS deleted FROM e GROUP BY 1""",
)
def _keyed_state(s: SparkSession, d: str) -> DataFrame:
    """All events as a stream in two runs over one checkpoint: the second goes on from the state that the first has left."""
    base = f"{shared_folder(s)}/folioscope-state/{uuid.uuid4().hex}"
    event = F.when(F.col("event_type") == "signup", "sync").when(F.col("event_type") == "error", "delete").otherwise(F.col("event_type"))
    rows = table(s, d, "events").select(F.col("user_id").cast("string").alias("guid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), event.alias("event"), (event == "click").alias("dirty_info"), event.isin("view", "delete").alias("dirty_data"), "event_id")
    for turn in (0, 1):
        rows.where(F.pmod("event_id", F.lit(2)) == turn).drop("event_id").write.mode("append").parquet(f"{base}/changes")
        done = keyed.run(s.readStream.schema(rows.drop("event_id").schema).parquet(f"{base}/changes"), f"{base}/out", f"{base}/check")
        done.awaitTermination()
    return keyed.state(s, f"{base}/out")


# ---- audits of exports and corpora, imports

_LINKED = f"""{WITH}, e AS (SELECT guid, doc_id, doc_id % 9 <> 0 AS there, doc_id % 6 = 0 AS linked, doc_id % 12 <> 0 AS held, doc_id % 10 = 0 AS scripted, doc_id % 15 = 0 AS leaks, doc_id % 21 = 0 AS odd FROM note)"""


def _checks_sql(id_: str, total: str, bad: str, sample: str = "guid") -> str:
    return f"""SELECT '{id_}' AS id, count(*) FILTER ({total}) AS total, count(*) FILTER ({total} AND {bad}) AS failed, count(*) FILTER ({total} AND {bad}) = 0 AS passed, array_to_string((list_sort(list({sample}) FILTER ({total} AND {bad})))[1:8], ',') AS samples FROM e"""


@query("q_export_checks", f"""{_LINKED} {' UNION ALL '.join([
    _checks_sql('E1', 'there', 'linked AND NOT held'), _checks_sql('E2', 'there', 'scripted'), _checks_sql('E3', 'true', 'leaks'), _checks_sql('E4', 'true', 'NOT there'),
    _checks_sql('E6', 'there AND linked', 'NOT held', "'attachments/a' || guid || ' & b.txt'")])}
 UNION ALL SELECT 'E5', 2 * count(*) FILTER (there), count(*) FILTER (there AND odd), count(*) FILTER (there AND odd) = 0, array_to_string((list_sort(list('d/' || guid || '?.zip') FILTER (there AND odd)))[1:8], ',') FROM e""")
def _export_checks(s: SparkSession, d: str) -> DataFrame:
    """Exports with faults by rule: packages and attachments that lack, scripts, references left in pages, names with a question mark."""
    i = F.col("doc_id")
    n = notes(s, d).select("guid", "doc_id", "body")
    name = F.concat(F.lit("a"), "guid", F.lit(" & b.txt"))
    path = F.concat(F.lit("d/"), "guid", F.when(i % 21 == 0, "?").otherwise(""), F.lit(".zip"))
    link = F.when(i % 6 == 0, F.concat(F.lit('<a href="attachments/'), text.html_escape(name), F.lit('">x</a>'))).otherwise("")
    html = F.concat(F.lit("<body>"), text.html_escape(F.col("body")), F.when(i % 10 == 0, "<script></script>").otherwise(""), link, F.lit("</body>"))
    there = n.where("doc_id % 9 <> 0")
    entries = there.select(path.alias("path"), "guid", F.lit("index.html").alias("name"), F.encode(html, "utf-8").alias("data")).unionByName(there.where("doc_id % 6 = 0 and doc_id % 12 <> 0").select(path.alias("path"), "guid", F.concat(F.lit("attachments/"), name).alias("name"), F.lit(None).cast("binary").alias("data")))
    pages = n.select("guid", F.concat(html, F.when(i % 15 == 0, '<img src="index_files/x.png">').otherwise("")).alias("html"))
    made = checks.export_checks(n, entries, there.where("doc_id % 6 = 0").select("guid", name.alias("name")), pages, "noteapp://")
    return made.withColumn("samples", F.array_join("samples", ","))


@query(
    "q_import_report",
    f"""{WITH}, p AS (SELECT 'attachments/' || guid AS path, CASE WHEN doc_id % 41 = 0 THEN 'unsafe' WHEN doc_id % 3 = 0 AND doc_id % 4 <> 1 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'copied' END AS action FROM note WHERE doc_id % 5 <> 0)
SELECT count(*) FILTER (action = 'copied') AS copied, count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action = 'missing') AS missing, count(*) FILTER (action = 'unsafe') AS unsafe,
 array_to_string((list_sort(list(action || ': ' || CASE WHEN action = 'unsafe' THEN '../' ELSE '' END || path) FILTER (action IN ('missing', 'unsafe'))))[1:10], ',') AS warnings FROM p""",
)
def _import_report(s: SparkSession, d: str) -> DataFrame:
    """Attachments of notes by rule: some in the library already, some there in another size, some gone from the source, some with paths that leave it."""
    i = F.col("doc_id")
    n = notes(s, d).select("doc_id", F.concat(F.when(i % 41 == 0, "../").otherwise(""), F.lit("attachments/"), "guid").alias("file_path"), F.col("package_size").alias("size"), F.when(i % 5 == 0, 0).otherwise(2).alias("tier"))
    source = n.where("doc_id % 7 <> 0").select(F.col("file_path").alias("path"), F.col("size").alias("bytes"))
    held = n.where("doc_id % 3 = 0").select(text.disk_path(F.col("file_path")).alias("path"), (F.col("size") + F.when(i % 4 == 1, 1).otherwise(0)).alias("bytes"))
    plan = checks.import_plan(n.withColumn("size", F.when(i % 2 == 0, F.col("size")).otherwise(F.when(i % 4 == 3, F.lit(None)).otherwise(F.col("size")))), source, held)
    return checks.import_report(plan).withColumn("warnings", F.array_join("warnings", ","))


@query(
    "q_inspection",
    rf"""WITH p AS (SELECT page_id, html, page_id % 2 AS a, page_id % 3 AS b, page_id % 5 = 0 AS m FROM pages WHERE html IS NOT NULL)
SELECT count(*) AS notes, count(*) FILTER (page_id % 17 = 0) AS open_fail, count(*) FILTER (page_id % 17 <> 0 AND page_id % 19 = 0) AS decode_fail, sum((page_id % 17 <> 0)::BIGINT * (a + b))::BIGINT AS code_blocks, sum((page_id % 17 <> 0)::BIGINT * b)::BIGINT AS code_blank, sum((page_id % 17 <> 0)::BIGINT * a)::BIGINT AS code_same,
 count(*) FILTER (page_id % 17 <> 0 AND m) AS refs_missing, count(*) FILTER (page_id % 17 <> 0 AND m) AS refs_missing_notes, count(*) FILTER (page_id % 17 <> 0 AND regexp_matches(html, '(?i)<script')) AS script_notes FROM p""",
)
def _inspection(s: SparkSession, d: str) -> DataFrame:
    """Pages with hidden code (rendered and not), references with and without an entry, bytes that are no UTF-8, and packages that don't open."""
    i = F.col("page_id")
    many = lambda html, n: F.repeat(F.lit(html), n.cast("int"))
    shown = '<textarea style="display:none">a &lt; b</textarea><code-mirror><pre class="CodeMirror-line">a &lt; b</pre></code-mirror>'
    html = F.concat("html", many(shown, i % 2), many('<textarea style="display:none">x</textarea><p>y</p>', i % 3), F.lit('<img src="index_files/there.png">'), F.when(i % 5 == 0, '<img src="index_files/gone.png">').otherwise(""))
    data = F.when(i % 17 != 0, F.concat(F.encode(html, "utf-8"), F.when(i % 19 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))))
    rows = table(s, d, "pages").where("html is not null").select(i.cast("string").alias("guid"), data.alias("data"), F.lit(50).alias("body_len"))
    found = checks.inspection(rows, rows.select("guid", F.lit("index_files/there.png").alias("name")))
    return found.select("notes", "open_fail", "decode_fail", "code_blocks", "code_blank", "code_same", "refs_missing", "refs_missing_notes", "script_notes")
