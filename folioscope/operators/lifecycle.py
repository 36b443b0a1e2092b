"""The library over time: admission, the derived index and its upkeep, folders, attachments' rows, replicas brought together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators.chains import chained
from folioscope.operators.library import folder_rows, unsynced
from folioscope.sources.views import SCHEMA_VERSION

#: Modes of a library that can be opened, warnings that a report shows, sizes of files that are taken in.
MODES = ["md", "native"]
WARNINGS = 10
IMAGE_MOST, ATTACHMENT_MOST = 20 << 20, 50 << 20
#: A note with fewer characters is nearly empty.
NEAR_EMPTY = 10


# ---- admission


def admission(manifest: DataFrame, files: DataFrame, meta: DataFrame | None = None, exists: bool = True, has_manifest: bool = True) -> DataFrame:
    """One row: status, reason, note_count, missing_files, warnings of a library directory.

    rejected: no directory, a schema_version in meta(key, value) that is newer or no number, or an export_mode that isn't
    MODES; without a manifest no_manifest if a zip lies at most four levels deep, else empty; otherwise ready, however many
    of manifest(guid, path) are unsafe or missing among files(path).  Warnings: the first WARNINGS by guid, and
    how many there are in all, if that is still within WARNINGS.
    """
    spark = manifest.sparkSession
    shape = "status string, reason string, note_count long, missing_files long, warnings array<string>"
    if not exists:
        return spark.createDataFrame([("rejected", "directory", 0, 0, [])], shape)
    if not has_manifest:
        zips = files.where(F.col("path").endswith(".zip") & (F.size(F.split(F.ltrim("path", F.lit("/")), "/")) <= 4))
        return zips.agg(F.when(F.count("*") > 0, "no_manifest").otherwise("empty").alias("status"), F.lit("").alias("reason"), F.lit(0).cast("long").alias("note_count"), F.lit(0).cast("long").alias("missing_files"), F.array().cast("array<string>").alias("warnings"))
    known = dict(meta.where(F.col("key").isin("schema_version", "export_mode") & F.col("value").isNotNull()).collect()) if meta is not None else {}
    version, mode = known.get("schema_version"), known.get("export_mode")
    if version is not None and not (version.isdigit() and int(version) <= SCHEMA_VERSION):
        return spark.createDataFrame([("rejected", "schema_version", 0, 0, [])], shape)
    if mode is not None and mode not in MODES:
        return spark.createDataFrame([("rejected", "export_mode", 0, 0, [])], shape)
    there = files.select("path", F.lit(True).alias("there")).distinct()
    problem = F.when(text.unsafe_path(F.col("path")), F.concat(F.lit("unsafe: "), "path")).when(F.col("there").isNull(), F.concat(F.lit("missing: "), "guid", F.lit(" "), "path"))
    found = manifest.select("guid", "path").join(there, "path", "left").select("guid", problem.alias("problem"))
    counts = found.agg(F.count("*").alias("note_count"), F.count("problem").alias("missing_files"))
    first = found.where("problem is not null").orderBy("guid").limit(WARNINGS).agg(F.transform(F.array_sort(F.collect_list(F.struct("guid", "problem"))), lambda x: x["problem"]).alias("warnings"))
    closing = F.concat(F.lit("in all: "), F.col("missing_files").cast("string"))
    told = F.when((F.col("missing_files") > 0) & (F.size("warnings") < WARNINGS), F.concat("warnings", F.array(closing))).otherwise(F.col("warnings"))
    return counts.crossJoin(first).select(F.lit("ready").alias("status"), F.lit("").alias("reason"), "note_count", "missing_files", told.alias("warnings"))


def resolved(guids: DataFrame, manifest: DataFrame | None, root: str = "") -> DataFrame:
    """guid, path: by the manifest's rows, unsafe paths apart; without a manifest by convention, notes/{guid}."""
    if manifest is None:
        return guids.select("guid", F.concat(F.lit(root), F.lit("notes/{"), "guid", F.lit("}")).alias("path"))
    return guids.join(manifest.where(~text.unsafe_path(F.col("path"))).select("guid", F.concat(F.lit(root), "path").alias("path")), "guid")


# ---- the derived index


def index_rows(notes: DataFrame, html: str | None = None) -> DataFrame:
    """guid, title, location, body, body_len, fingerprint, downloaded: the index's note table.

    html: a column of markup that the text is taken from; without one body is text already.  A note without a body is in
    the index with an empty one, not downloaded.
    """
    source = F.col(html) if html else F.col("body")
    body = F.coalesce(text.extract_text(source) if html else source, F.lit(""))
    own = notes.select("guid", "title", "location", body.alias("body"), source.isNotNull().alias("downloaded"))
    return own.select("guid", "title", "location", "body", F.length("body").cast("long").alias("body_len"), F.when(F.col("body") == "", F.lit("")).otherwise(text.fingerprint(F.col("body"))).alias("fingerprint"), "downloaded")


def rebuilt(notes: DataFrame, folder_state: DataFrame, history: DataFrame, disk_dirs: DataFrame | None = None, html: str | None = None) -> dict[str, DataFrame]:
    """A whole new index: note, folder and history tables.

    folder holds the folders of all notes and directories on disk (path); what users left (folder_state(path, pos), history)
    carries over, for paths that still are folders.
    """
    index = index_rows(notes, html)
    paths = folder_rows(index).select("path")
    if disk_dirs is not None:
        paths = paths.unionByName(disk_dirs.select("path"))
    return {"note": index, "folder": paths.distinct().join(folder_state.select("path", "pos"), "path", "left"), "history": history}


def refreshed(index: DataFrame, notes: DataFrame, keys: DataFrame, html: str | None = None) -> DataFrame:
    """index with the rows of keys(guid) made anew: from the note where there is one, gone where there is none."""
    keys = keys.select("guid").distinct()
    fresh = index_rows(notes.join(keys, "guid", "left_semi"), html)
    return index.join(keys, "guid", "left_anti").select(*fresh.columns).unionByName(fresh)


def kept_up(index: DataFrame, notes: DataFrame, keys: DataFrame, html: str | None = None) -> DataFrame:
    """refreshed, if that leaves as many rows as there are notes; otherwise the whole index anew."""
    made = refreshed(index, notes, keys, html)
    return made if made.count() == notes.count() else index_rows(notes, html)


def pruned(folders: DataFrame, index: DataFrame, disk_dirs: DataFrame) -> DataFrame:
    """folders(path, ..) that a note of the index is in, or that are on disk; the root always stays.  A parent with nothing of its own goes."""
    alive = index.select(F.col("location").alias("path")).unionByName(disk_dirs.select(F.concat(F.lit("/"), F.btrim("path", F.lit("/")), F.lit("/")).alias("path")))
    root = F.btrim("path", F.lit("/")) == ""
    return folders.where(root).unionByName(folders.where(~root).join(alive.distinct(), "path", "left_semi"))


def siblings(folders: DataFrame) -> DataFrame:
    """parent, place (from 1), path, pos of folders(path, pos): siblings by pos, those without one last, ties by path."""
    own = folders.withColumn("parent", text.parent_of(F.col("path")))
    order = Window.partitionBy("parent").orderBy(F.coalesce("pos", F.lit((1 << 63) - 1)), "path")
    return own.select("parent", F.row_number().over(order).alias("place"), "path", "pos")


def children(folders: DataFrame) -> DataFrame:
    """path, child: every folder under its parent, where that is a folder too."""
    return folders.select("path").join(folders.select(text.parent_of(F.col("path")).alias("path"), F.col("path").alias("child")), "path")


# ---- rows of interest


def under(notes: DataFrame, folder: str) -> DataFrame:
    """Notes whose location begins with folder, A-Z folded as LIKE does; %, _ and ! stand for themselves."""
    return notes.where(text.ascii_lower(F.col("location")).startswith(folder.translate({c: c + 32 for c in range(65, 91)})))


def unsynced_attachments(attachments: DataFrame) -> DataFrame:
    return attachments.where(F.col("dirty") != 0).orderBy("file_path")


def unpublished(tombs: DataFrame) -> DataFrame:
    """Tombstones that no replica has seen, by guid."""
    return tombs.where("synced_revision = 0").orderBy("guid")


def ever_edited(manifest: DataFrame) -> DataFrame:
    """Notes written in the library at any time (revision > 0), synced since or not; unlike unsynced."""
    return manifest.where("revision > 0")


def unlinked(attachments: DataFrame) -> DataFrame:
    return attachments.where("tier = 4 and source = 'unlinked'").orderBy("display_name", "file_path")


def missing_attachment(path: Column) -> Column:
    return path.startswith("db-missing:")


def warnings_by_kind(warnings: DataFrame, absent_prefix: str, on_demand: bool) -> DataFrame:
    """warning, kind: with on-demand bodies a missing file is absent, otherwise every warning is a problem."""
    absent = F.col("warning").startswith(absent_prefix) & F.lit(on_demand)
    return warnings.select("warning", F.when(absent, "absent").otherwise("problem").alias("kind"))


def attachment_audit(rows: DataFrame, disk: DataFrame) -> DataFrame:
    """path, problem: files on disk that no row names (no row), and rows whose file isn't there (no file).

    rows(file_path, tier): those of tier 0 have no file.  attachments/x of the source lies at _attachments/x.  Of the disk
    only the two folders of attachments count, and not .DS_Store.
    """
    there = disk.where(F.col("path").rlike(r"^(_attachments|_unlinked_attachments)/[^/]+$") & ~F.col("path").endswith("/.DS_Store")).select("path").distinct()
    listed = rows.where("tier <> 0").select(text.disk_path(F.col("file_path")).alias("path")).distinct()
    return there.join(listed, "path", "left_anti").select("path", F.lit("no row").alias("problem")).unionByName(listed.join(there, "path", "left_anti").select("path", F.lit("no file").alias("problem")))


def probe_length(html: Column) -> Column:
    """Characters of the plain text by rules of its own: inside body, no style, script or tags, five entities, single spaces."""
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>([\s\S]*)</body>", 1)
    c = F.when(html.rlike(r"(?is)<body[^>]*>[\s\S]*</body>"), inner).otherwise(html)
    for pattern in (r"(?is)<style[\s\S]*?</style>", r"(?is)<script[\s\S]*?</script>", r"(?s)<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    for name, by in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(by))
    return F.length(text.trim(F.regexp_replace(c, r"(?U)\s+", " "))).cast("long")


def corpus_counters(bodies: DataFrame) -> DataFrame:
    """One row of counters over bodies(guid, html, body_len), in one pass; null html can't be opened.

    body_len is what the index has; near_empty_index goes by it, near_empty_probe by probe_length.
    """
    html = F.col("html")
    extracted = F.length(text.extract_text(html))
    sources = F.regexp_extract_all(html, F.lit(r"""(?i)src\s*=\s*["']([^"']+)["']"""), 1)
    remote = F.size(F.filter(sources, lambda u: u.startswith("http://") | u.startswith("https://") | u.startswith("//")))
    hidden = F.regexp_count(html, F.lit(r"(?is)<textarea[^>]*display\s*:\s*none"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return bodies.agg(
        F.count("*").alias("notes"), F.count_if(html.isNull()).alias("open_fail"), F.count_if(html.contains("�")).alias("mojibake"),
        total(hidden, "hidden_code"), F.count_if(hidden > 0).alias("hidden_code_notes"), F.count_if(extracted != F.col("body_len")).alias("length_differs"),
        F.count_if(html.isNotNull() & (F.col("body_len") < NEAR_EMPTY)).alias("near_empty_index"), F.count_if(probe_length(html) < NEAR_EMPTY).alias("near_empty_probe"),
        total(remote, "remote_sources"), F.count_if(remote > 0).alias("remote_source_notes"), F.count_if(html.rlike("(?i)<script")).alias("script_notes"),
    )


# ---- attachments


def attachments_from_index(attachments: DataFrame, docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manifest's attachment rows, its bridge (file_path, document_guid), and the paths that lie outside root and are left out.

    attachments(file_path, display_name, size, tier, document_guid, source), docs(file_path, document_guid).  Paths become
    relative to root.  A file of one document in docs is that document's; one of several keeps what it has, with one
    bridge row each.  Null sizes and tiers are 0, a null source is empty.
    """
    base = root.rstrip("/") + "/"
    relative = lambda c: F.when(c.startswith(base), F.substring(c, F.lit(len(base) + 1), F.length(c))).when(~c.startswith("/"), c)
    owners = docs.distinct().groupBy("file_path").agg(F.count("*").alias("owners"), F.min("document_guid").alias("owner"))
    own = attachments.join(owners, "file_path", "left").withColumn("rel", relative(F.col("file_path")))
    rows = own.where("rel is not null").select(
        F.col("rel").alias("file_path"), "display_name", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("tier", F.lit(0)).alias("tier"),
        F.when(F.col("owners") == 1, F.col("owner")).otherwise(F.col("document_guid")).alias("document_guid"), F.coalesce("source", F.lit("")).alias("source"),
    )
    shared = own.where("owners > 1 and rel is not null").select("file_path", "rel").join(docs.distinct(), "file_path").select(F.col("rel").alias("file_path"), "document_guid")
    return rows, shared, own.where("rel is null").select("file_path")


def added_files(existing: DataFrame, incoming: DataFrame, most: int = ATTACHMENT_MOST) -> DataFrame:
    """name, path, action of incoming(name, md5, size): write, reuse (equal content is there or comes before it by name), or too large.

    A file is called {stem}_{first 8 of md5}.{extension}; existing(path, md5).
    """
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    path = F.concat(stem, F.lit("_"), F.substring("md5", 1, 8), F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext)))
    fits = F.col("size") <= most
    firsts = incoming.where(fits).groupBy("md5").agg(F.min(F.struct("name", path.alias("path"))).alias("first"))
    there = existing.groupBy("md5").agg(F.min("path").alias("held"))
    own = incoming.join(firsts, "md5", "left").join(there, "md5", "left")
    action = F.when(~fits, "too large").when(F.col("held").isNotNull() | (F.col("name") != F.col("first.name")), "reuse").otherwise("write")
    return own.select("name", F.when(fits, F.coalesce("held", "first.path")).alias("path"), action.alias("action"))


def unique_names(files: DataFrame) -> DataFrame:
    """scope, at, name, unique of files(scope, at, name): in order of `at` each scope's names, later ones as stem_2.ext, stem_3.ext ...

    A name without a dot, or that begins with one, has no extension.  Scopes in which every name is there once stand as
    they are; the others go through the chain, one scope at a time.
    """
    contested = files.groupBy("scope", "name").count().where("count > 1").select("scope", F.lit(True).alias("contested")).distinct()
    told = files.select("scope", "at", "name").join(contested, "scope", "left")

    def start() -> Callable[[str], str]:
        used, tried = set(), {}

        def say(name: str) -> str:
            got, (stem, dot, ext) = name, name.rpartition(".")
            if not dot or name.startswith("."):
                stem, dot, ext = name, "", ""
            n = tried.get(name, 1)
            while got in used:
                n += 1
                got = f"{stem}_{n}{dot}{ext}"
            tried[name] = n
            used.add(got)
            return got

        return say

    made = chained(told.where("contested"), ["scope"], ["at", "name"], ["name"], ["scope", "at", "name"], "unique", start)
    return told.where("contested is null").select("scope", "at", "name", F.col("name").alias("unique")).unionByName(made)


# ---- replicas


def put(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """delta's rows in place of base's by key."""
    return base.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta.select(*base.columns))


def sync_down(local: DataFrame, remote: DataFrame, local_revision: int, remote_revision: int, role: str = "writer") -> DataFrame:
    """The manifest after a download: the remote's rows as they are, but for the writer's own changes.

    Nothing changes where the remote isn't ahead.  A note that the writer has changed and whose bytes are unlike the
    remote's keeps the local row with both latches set and its own synced_revision, on which the next upload judges.
    """
    if remote_revision <= local_revision:
        return local
    columns = local.columns
    if role != "writer":
        return remote.select(*columns)
    own = unsynced(local).join(remote.select("guid", F.col("md5").alias("_r")), "guid").where("md5 <> _r").drop("_r")
    own = own.withColumn("dirty_info", F.lit(True)).withColumn("dirty_data", F.lit(True))
    return put(remote.select(*columns), own.select(*columns), "guid")


def sync_up(send: Callable[[], str], down: Callable[[], None], tries: int = 3) -> int:
    """Try to upload; where the remote is ahead or a condition fails (STALE, CONFLICT), download and try again.  The number of tries that it took.

    After the last failed try an error, and nothing has changed on the remote.
    """
    for n in range(1, tries + 1):
        if (answer := send()) not in ("STALE", "CONFLICT"):
            return n
        if n < tries:
            down()
    raise RuntimeError(f"upload given up after {tries} tries: {answer}")


def rebuilt_manifest(notes: DataFrame, names: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest, and the guids whose file is missing, from notes(guid, title) and files on disk(path, md5, size).

    names(guid, directory, name) plans the paths.  Every row has never been synced and has both latches set.  Tombstones are
    for buried().
    """
    planned = notes.select("guid", "title").join(names.select("guid", F.concat(F.when(F.col("directory") == "", "").otherwise(F.concat("directory", F.lit("/"))), "name", F.lit(".zip")).alias("path")), "guid")
    both = planned.join(files.select("path", "md5", "size"), "path", "left")
    rows = both.where("md5 is not null").select("guid", "title", "path", "md5", "size", F.lit(0).cast("long").alias("revision"), F.lit(0).cast("long").alias("synced_revision"), F.lit(True).alias("dirty_info"), F.lit(True).alias("dirty_data"))
    return rows, both.where("md5 is null").select("guid")


def buried(manifest: DataFrame, source: DataFrame, tombs: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """Manifest and tombstones(guid, removed_at, synced_revision) after rows that the whole source set lacks are buried, unpublished."""
    gone = manifest.join(source.select("guid"), "guid", "left_anti").select("guid", F.lit(at).alias("removed_at"), F.lit(0).cast("long").alias("synced_revision"))
    return manifest.join(source.select("guid").distinct(), "guid", "left_semi"), put(tombs.select("guid", "removed_at", F.col("synced_revision").cast("long").alias("synced_revision")), gone, "guid")
