"""Browsing, attachments, manifests, export and replication plans, audits: declarative plans over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import ancestors, ascii_lower, name_of, parent_of, sanitize_location, sanitize_title, system_folder
from folioscope.operators.chains import chained
from folioscope.sources.store import bounded_batches

LIST_LIMIT = 5000
KEEP_DAYS = 30


# ---- folder tree and lists


def folder_rows(notes: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """path, name, parent of every folder that a note is in or below, and of positioned ones."""
    found = notes.select(F.explode(ancestors(F.col("location"))).alias("path"))
    if positions is not None:
        found = found.unionByName(positions.select(F.explode(ancestors(F.col("path"))).alias("path")))
    return found.distinct().select("path", name_of(F.col("path")).alias("name"), parent_of(F.col("path")).alias("parent"))


def direct_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy(F.col("location").alias("path")).agg(F.count("*").alias("direct_count"), F.max("has_attachment").alias("has_attachment"))


def rollup(notes: DataFrame) -> DataFrame:
    """path, depth, total_count, has_attachment over whole subtrees.

    Locations are counted first, so the explosion into ancestors works on folders, not on notes.
    """
    own = direct_counts(notes)
    up = own.select(F.explode(ancestors(F.col("path"))).alias("path"), "direct_count", "has_attachment")
    return up.groupBy("path").agg(F.sum("direct_count").alias("total_count"), F.max("has_attachment").alias("has_attachment")).withColumn("depth", F.size(F.split("path", "/")) - 2)


def listing(notes: DataFrame, folder: str | None = None, contains: str | None = None, sort: str = "modified", limit: int = LIST_LIMIT) -> DataFrame:
    """Notes of a folder (itself alone), by title LIKE (wildcards as they are), in one of the sorts; ties by guid."""
    if folder is not None:
        notes = notes.where(F.col("location") == folder)
    if contains and contains.strip():
        notes = notes.where(ascii_lower(F.col("title")).like("%" + contains.strip().lower() + "%"))
    order = {"modified": F.desc("data_modified"), "created": F.desc("created") if "created" in notes.columns else F.desc("data_modified"), "title": ascii_lower(F.col("title")).asc(), "size": F.desc("package_size")}
    return notes.orderBy(order[sort], "guid").limit(limit)


def load_attachments(attachments: DataFrame) -> DataFrame:
    """The manifest's attachment rows by path; null sizes and tiers are 0, a null source is empty."""
    return attachments.fillna({"size": 0, "tier": 0, "source": ""}).orderBy("file_path")


def flags(notes: DataFrame) -> DataFrame:
    """is_webclip, is_empty, system of each note."""
    return notes.withColumn("is_webclip", F.coalesce(F.length("url") > 0, F.lit(False)) if "url" in notes.columns else F.lit(False)).withColumn("is_empty", (F.col("package_size") > 0) & (F.length("body") < 10)).withColumn("system", system_folder(F.col("location")))


# ---- attachments


def _grams(c: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


#: Different names that automata look for at most; more are found by joins.  Names, and characters, of one automaton.
AUTOMATON_NAMES, CHUNK_NAMES, CHUNK_CHARACTERS = 200_000, 20_000, 1 << 20


def containment(names: DataFrame, notes: DataFrame) -> DataFrame:
    """(file_path, guid) for every name(file_path, display_name) that a note's body contains.

    Up to AUTOMATON_NAMES different names are looked for by automata over many names at once, in one scan of the bodies for each chunk of names;
    more of them, or without the ahocorasick package, by joins.  Names that are null, empty or white space are in no body.
    """
    own = names.select("file_path", "display_name").where(F.col("display_name").rlike(r"\S"))
    chunks, size, count = [[]], 0, 0
    if AUTOMATON_NAMES and _automata():
        for row in own.select("display_name").distinct().limit(AUTOMATON_NAMES + 1).toLocalIterator():
            if len(chunks[-1]) == CHUNK_NAMES or size > CHUNK_CHARACTERS:
                chunks.append([])
                size = 0
            chunks[-1].append(row["display_name"])
            size += len(row["display_name"])
            count += 1
    if not count or count > AUTOMATON_NAMES:
        return _contained_by_joins(own, notes)
    found = None
    for chunk in chunks:
        part = _scanned(notes, names.sparkSession.sparkContext.broadcast(chunk))
        found = part if found is None else found.unionByName(part)
    return own.join(found, "display_name").select("file_path", "guid").distinct()


def _automata() -> bool:
    try:
        import ahocorasick  # noqa: F401
    except ImportError:
        return False
    return True


def _scanned(notes: DataFrame, chunk) -> DataFrame:
    """(guid, display_name) of the names of a broadcast chunk that bodies contain; a task makes the automaton once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, name in enumerate(chunk.value):
            machine.add_word(name, i)
        machine.make_automaton()
        for batch in batches:
            guids, found = [], []
            for guid, body in zip(batch["guid"].to_pylist(), batch["body"].to_pylist()):
                for i in {i for _, i in machine.iter(body)} if body else ():
                    guids.append(guid)
                    found.append(chunk.value[i])
            yield pa.RecordBatch.from_arrays([pa.array(guids, pa.string()), pa.array(found, pa.string())], ["guid", "display_name"])

    bounded_batches(notes.sparkSession)
    return notes.select(F.col("guid").cast("string").alias("guid"), "body").mapInArrow(scan, "guid string, display_name string")


def _contained_by_joins(names: DataFrame, notes: DataFrame) -> DataFrame:
    """containment() without automata.

    A name's inner word (neither first nor last) must stand whole in any text that contains the name, so the pairs to
    test come from an equi-join on the longest of these.  A name of one or two words needs a body's word that contains
    the name's longest word: such words are found among the distinct words of all bodies, by the first three
    characters (all, if fewer) of the name's word.
    """
    words = F.filter(F.split("display_name", r"\s+"), lambda w: w != "")
    longest = lambda ws: F.array_sort(ws, lambda a, b: F.length(b) - F.length(a))[0]
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    anchored = names.select("file_path", "display_name", (F.size(words) > 2).alias("whole"), F.when(F.size(words) > 2, longest(inner)).when(F.size(words) > 0, longest(words)).alias("anchor")).where("anchor is not null")
    held = notes.select("guid", F.explode(F.array_distinct(F.split("body", r"\s+"))).alias("anchor"))
    pairs = held.join(anchored.where("whole").select("anchor", "file_path", "display_name"), "anchor").select("guid", "file_path", "display_name")
    loose = anchored.where("not whole").withColumn("n", F.least(F.lit(3), F.length("anchor"))).withColumn("gram", F.substring(F.col("anchor"), F.lit(1), F.col("n")))
    if not loose.isEmpty():  # one look at the names spares a pass over all bodies
        vocabulary = held.where("anchor <> ''").select(F.col("anchor").alias("word")).distinct()
        grams = F.array_distinct(F.concat(*[_grams(F.col("word"), n) for n in (1, 2, 3)]))
        near = vocabulary.select("word", F.explode(grams).alias("gram")).join(loose, "gram").where(F.col("word").contains(F.col("anchor"))).select(F.col("word").alias("anchor"), "file_path", "display_name")
        pairs = pairs.unionByName(held.join(near, "anchor").select("guid", "file_path", "display_name").distinct())
    return pairs.join(notes.select("guid", "body"), "guid").where(F.col("body").contains(F.col("display_name"))).select("file_path", "guid").distinct()


def attribute(names: DataFrame, notes: DataFrame, records: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Attachments (file_path, display_name, tier, source, document_guid, hits) and the bridge (file_path, document_guid).

    1: its file's guid is a record's; 2: one body names it; 3: several do, one bridge row each; 4: none; and records
    without a file are 0.
    """
    known = records if records is not None else names.sparkSession.createDataFrame([], "record_guid string, document_guid string, db_name string")
    if "file_guid" not in names.columns:
        names = names.withColumn("file_guid", F.lit(None).cast("string"))
    joined = names.join(known.select(F.col("record_guid").alias("file_guid"), F.col("document_guid").alias("owner")), "file_guid", "left")
    first = joined.where("owner is not null").select("file_path", "display_name", F.lit(1).alias("tier"), F.lit("db-record").alias("source"), F.col("owner").alias("document_guid"), F.lit(0).cast("long").alias("hits"))
    rest = joined.where("owner is null").select("file_path", "display_name")
    pairs = containment(rest, notes)
    counted = pairs.groupBy("file_path").agg(F.count("*").alias("hits"), F.min("guid").alias("one"))
    tier = F.when(F.col("hits") == 1, 2).when(F.col("hits") > 1, 3).otherwise(4)
    other = rest.join(counted, "file_path", "left").select("file_path", "display_name", tier.alias("tier"), F.when(tier == 4, "unlinked").otherwise("filename-in-body").alias("source"), F.when(tier == 2, F.col("one")).alias("document_guid"), F.coalesce("hits", F.lit(0)).alias("hits"))
    missing = known.join(names.select(F.col("file_guid").alias("record_guid")), "record_guid", "left_anti").select(F.concat(F.lit("db-missing:"), "record_guid").alias("file_path"), F.col("db_name").alias("display_name"), F.lit(0).alias("tier"), F.lit("db-missing").alias("source"), "document_guid", F.lit(0).cast("long").alias("hits"))
    bridge = pairs.join(counted.where("hits > 1").select("file_path"), "file_path").select("file_path", F.col("guid").alias("document_guid"))
    return first.unionByName(other).unionByName(missing), bridge


def note_attachments(attachments: DataFrame, bridge: DataFrame) -> DataFrame:
    """document_guid, files: direct owners and bridge owners together, sorted by name and path."""
    direct = attachments.where("document_guid is not null").select("document_guid", "display_name", "file_path")
    shared = bridge.join(attachments.select("file_path", "display_name"), "file_path").select("document_guid", "display_name", "file_path")
    return direct.unionByName(shared).groupBy("document_guid").agg(F.array_sort(F.collect_list(F.struct("display_name", "file_path"))).alias("files"))


# ---- manifest


def latest(changes: DataFrame, key: str = "guid", order: str = "ts") -> DataFrame:
    """The newest change of each key (ties: the larger row) with the OR of the latches of all its changes.

    Changes are writes, which only set dirty_info and dirty_data (null: not set); commit clears them.
    """
    kinds = dict(changes.dtypes)
    latches = [c for c in ("dirty_info", "dirty_data") if c in kinds]
    rest = [c for c in changes.columns if c not in (key, order)]
    either = [(F.bool_or(c) if kinds[c] == "boolean" else F.bit_or(c)).alias(c) for c in latches]
    top = changes.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c not in latches])).alias("_v"), *either)
    return top.select(key, f"_v.{order}", *[c if c in latches else f"_v.{c}" for c in rest])


def upsert(base: DataFrame, delta: DataFrame, key: str = "guid") -> DataFrame:
    """delta's rows in place of base's by key; new rows have both latches set, known ones keep theirs."""
    old = base.select(key, F.col("dirty_info").alias("_i"), F.col("dirty_data").alias("_d"))
    plain = [c for c in base.columns if c not in ("dirty_info", "dirty_data")]
    fresh = delta.join(old, key, "left").select(*plain, F.coalesce("_i", F.lit(True)).alias("dirty_info"), F.coalesce("_d", F.lit(True)).alias("dirty_data"))
    return base.join(delta.select(key).distinct(), key, "left_anti").select(*fresh.columns).unionByName(fresh)


def unsynced(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("dirty_info").cast("boolean") | F.col("dirty_data").cast("boolean"))


def watermarks(**classes: DataFrame) -> DataFrame:
    """kind, watermark: the largest synced_revision of each class, 0 where there is none."""
    out = None
    for kind, df in classes.items():
        own = df.agg(F.coalesce(F.max("synced_revision"), F.lit(0)).cast("long").alias("watermark")).select(F.lit(kind).alias("kind"), "watermark")
        out = own if out is None else out.unionAll(own)
    return out


def commit(manifest: DataFrame, done: DataFrame, revision: int) -> DataFrame:
    """manifest with the latches of done(guid) cleared at the minted revision."""
    hit = F.col("_done").isNotNull()
    own = manifest.join(done.select("guid", F.lit(1).alias("_done")).distinct(), "guid", "left")
    return own.withColumn("synced_revision", F.when(hit, F.lit(revision)).otherwise(F.col("synced_revision"))).withColumn("dirty_info", ~hit & F.col("dirty_info")).withColumn("dirty_data", ~hit & F.col("dirty_data")).drop("_done")


def invariants(manifest: DataFrame, disk: DataFrame, deep: bool = True) -> DataFrame:
    """guid, problem: missing, size or md5 (if deep) of each manifest row whose file(path, md5, size) isn't as it says.

    A manifest row without an md5 has none to compare.  Where either side lacks size, deep goes by md5 alone and
    light has nothing to go by and is refused.
    """
    sized = "size" in manifest.columns and "size" in disk.columns
    if not (sized or deep):
        raise ValueError("without deep, both sides need size")
    at = disk.select("path", F.lit(True).alias("_there"), *([F.col("size").alias("_size")] if sized else []), *([F.col("md5").alias("_md5")] if deep else []))
    problem = F.when(F.col("_there").isNull(), "missing")
    if sized:
        problem = problem.when(~F.col("size").eqNullSafe(F.col("_size")), "size")
    if deep:
        problem = problem.when((F.col("md5") != "") & ~F.col("md5").eqNullSafe(F.col("_md5")), "md5")
    return manifest.join(at, "path", "left").select("guid", problem.alias("problem")).where("problem is not null")


def orphans(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """Packages on disk that no row names, folders that begin with _ at the top apart."""
    return disk.where(~F.col("path").rlike("^/?_")).join(manifest.select("path"), "path", "left_anti").select("path")


def reconcile(manifest: DataFrame, source: DataFrame) -> DataFrame:
    """Rows to bury: in the manifest, not in the whole source set."""
    return manifest.join(source.select("guid"), "guid", "left_anti")


# ---- export


def converter_stale(meta: DataFrame, form: str, version: str) -> bool:
    """Whether packages of Markdown on disk come from another converter than this one, by meta(key, value): then none of them is reused."""
    known = meta.where("key = 'md_converter'").first() if form == "md" else None
    return form == "md" and (known is None or known["value"] != version)


def export_plan(source: DataFrame, previous: DataFrame, edited: DataFrame | None = None, stale: bool = False) -> DataFrame:
    """guid, status, dirty_info, dirty_data: added, reused, reexported, kept or tombstoned.

    source and previous(guid, title, path, data_modified, package_size, mode); edited(guid) were changed in the library.
    """
    p = previous.select("guid", *[F.col(c).alias(f"p_{c}") for c in ("title", "path", "data_modified", "package_size", "mode")], F.lit(True).alias("had"))
    both = source.withColumn("has", F.lit(True)).join(p, "guid", "full_outer")
    both = both.join((edited if edited is not None else source.where("false")).select("guid", F.lit(True).alias("edited")).distinct(), "guid", "left")
    same = ~F.lit(stale) & F.col("had") & F.expr("data_modified = p_data_modified and package_size = p_package_size and mode = p_mode and path = p_path")
    info = F.col("had") & ((F.col("title") != F.col("p_title")) | (F.col("path") != F.col("p_path")))
    status = F.when(F.col("has").isNull(), "tombstoned").when(F.col("edited"), "kept").when(same, "reused").when(F.col("had"), "reexported").otherwise("added")
    return both.withColumn("status", status).select("guid", "status", F.coalesce(F.when(F.col("status") == "added", True).when(F.col("status").isin("reused", "reexported"), info), F.lit(False)).alias("dirty_info"), F.col("status").isin("added", "reexported").alias("dirty_data"))


def export_names(notes: DataFrame) -> DataFrame:
    """guid, directory, name: names free of collisions in each directory, in order of title and guid.

    The first note of a base name has it; each later one has the first 110 characters with _ and the first 8 of its
    guid, and where that is taken, _2, _3 and on.  A name also takes name.zip.  Null titles count as empty.

    All names that a note could get begin alike up to the first _ or . (or 100 characters), so notes whose base begins
    otherwise can't collide with it: a family.  In families where every name is wanted once, which SQL finds by
    counting, the names stand as they are; only the others go through the chain, one family at a time.
    """
    bare = F.substring(F.regexp_replace("guid", r"^[{}]+|[{}]+$", ""), 1, 8)
    own = notes.select("guid", F.regexp_replace(F.btrim(sanitize_location(F.col("location")), F.lit("/")), "/+", "/").alias("directory"), F.coalesce("title", F.lit("")).alias("title"))
    own = own.withColumn("base", sanitize_title(F.col("title"))).withColumn("family", F.regexp_extract("base", r"(?s)^[^_.]{0,100}", 0)).withColumn("other", F.concat(F.substring("base", 1, 110), F.lit("_"), bare))
    first = own.groupBy("directory", "base").agg(F.min(F.struct("title", "guid")).alias("first")).select(F.col("first.guid").alias("guid"), "directory", F.lit(True).alias("first")).distinct()
    wanted = own.join(first, ["guid", "directory"], "left").withColumn("name", F.when(F.col("first"), F.col("base")).otherwise(F.col("other")))
    taken = wanted.select("directory", "family", F.explode(F.array("name", F.concat("name", F.lit(".zip")))).alias("name"))
    contested = taken.groupBy("directory", "family", "name").count().where("count > 1").select("directory", "family", F.lit(True).alias("contested")).distinct()
    told = wanted.join(contested, ["directory", "family"], "left")

    def start() -> Callable[[str, str], str]:
        used, tried = set(), {}

        def say(base: str, other: str) -> str:
            got, n = base, 1
            if got in used:
                got, head = other, base[:110]
                n = tried.get(head, 1)
                while got in used:
                    n += 1
                    got = f"{head}_{n}"
                tried[head] = n
            used.update((got, f"{got}.zip"))
            return got

        return say

    made = chained(told.where("contested"), ["directory", "family"], ["title", "guid"], ["base", "other"], ["guid", "directory"], "name", start)
    return told.where("contested is null").select("guid", "directory", "name").unionByName(made)


# ---- replication


def upload_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """guid, action, risky of every note with a latch set: skip (the remote has its bytes), conditional put, or put."""
    r = remote.select("guid", F.col("md5").alias("r_md5"), F.col("synced_revision").alias("r_rev"))
    both = unsynced(local).join(r, "guid", "left")
    risky = F.coalesce((F.col("r_rev") > F.col("synced_revision")) & (F.col("r_md5") != F.col("md5")), F.lit(False))
    return both.select("guid", F.when(F.col("r_md5") == F.col("md5"), "skip").when(risky, "conditional_put").otherwise("put").alias("action"), risky.alias("risky"))


def download_plan(local: DataFrame, remote: DataFrame, role: str = "writer", on_demand: bool = False) -> DataFrame:
    """guid, action, side_copy, trash_old_path: keep_local, download, pending, vanished or none, by the decision ladder."""
    mine = local.select("guid", F.col("md5").alias("l_md5"), F.col("path").alias("l_path"), F.col("synced_revision").alias("l_rev"), (F.col("dirty_info") | F.col("dirty_data")).alias("dirty"), F.lit(True).alias("l"))
    other = remote.select("guid", F.col("md5").alias("r_md5"), F.col("path").alias("r_path"), F.col("synced_revision").alias("r_rev"), F.lit(True).alias("r"))
    both = mine.join(other, "guid", "full_outer")
    conflict = F.coalesce(F.col("l") & F.col("r") & F.col("dirty") & (F.col("l_md5") != F.col("r_md5")), F.lit(False))
    keep = conflict if role == "writer" else F.lit(False)
    side = F.when(conflict & F.lit(role == "writer") & (F.col("r_rev") > F.col("l_rev")), "remote").when(conflict & F.lit(role != "writer"), "local").otherwise("none")
    same = F.coalesce(F.col("l_md5") == F.col("r_md5"), F.lit(False))
    action = F.when(keep, "keep_local").when(F.col("r").isNull(), "vanished").when(~same, "pending" if on_demand else "download").otherwise("none")
    moved = F.coalesce(F.col("l") & F.col("r") & (F.col("l_path") != F.col("r_path")) & ~keep, F.lit(False))
    return both.select("guid", action.alias("action"), side.alias("side_copy"), moved.alias("trash_old_path"))


def diverged(local: DataFrame, local_tombs: DataFrame, remote: DataFrame, remote_tombs: DataFrame) -> DataFrame:
    """Sorted distinct guids that a replica must look at."""
    r = remote.select("guid", F.col("md5").alias("r_md5"), F.col("path").alias("r_path"))
    unlike = local.join(r, "guid").where("md5 <> r_md5 or path <> r_path").select("guid")
    alone = local.join(remote, "guid", "left_anti").join(remote_tombs, "guid", "left_anti").select("guid")
    revived = local_tombs.join(remote, "guid", "left_semi").select("guid")
    return unlike.union(alone).union(revived).distinct().orderBy("guid")


def attachment_plan(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """file_path, action of each cloud attachment (tier 0 apart): get, keep or none."""
    l = local.select("file_path", F.col("md5").alias("l_md5"), F.lit(True).alias("there"))  # noqa: E741
    action = F.when(F.col("there").isNull(), "get").when(F.col("md5").isNull(), "keep").when(F.col("md5") != F.col("l_md5"), "get").otherwise("none")
    return cloud.where("tier <> 0").join(l, "file_path", "left").select("file_path", action.alias("action"))


def expired(trash: DataFrame, today: Column, days: int = KEEP_DAYS) -> DataFrame:
    """trash(guid, removed_at) with days_left and whether it goes; dates that don't parse stay for good."""
    age = F.datediff(today, F.to_date(F.substring("removed_at", 1, 10)))
    return trash.withColumn("days_left", F.lit(days) - age).withColumn("expired", F.coalesce(age >= days, F.lit(False)))


def stale_gate(local_revision: int, remote_revision: int) -> bool:
    """Whether an upload must stop: the remote is ahead of a manifest that has been synced."""
    return local_revision > 0 and remote_revision > local_revision


# ---- audits


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change between two snapshots (path, bytes, mtime)."""
    b = before.select("path", F.struct("bytes", "mtime").alias("b"))
    a = after.select("path", F.struct("bytes", "mtime").alias("a"))
    change = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.col("a") != F.col("b"), "modified")
    return b.join(a, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


#: Bins of one round of nearest_rank, and rows of a bin that need no further round.
RANK_BINS, RANK_ROWS = 4096, 200_000


def nearest_rank(values: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """q, value at index round((n - 1) q) of the sorted values; nulls don't count, NaN is the largest.

    A round counts values in equal bins between known ends and keeps, for each quantile, the bin that its index falls in with
    that bin's own ends, until those bins hold few rows or one value; the driver gets one row for each bin.  Ends are literals
    of the plan, so a value's bin is the same however often a task runs.  What is left is sorted by a window for each bin.
    """
    spark = values.sparkSession
    kind = dict(values.dtypes)[column]
    # halves, so that no difference of two is beyond a double's range
    place = F.least(F.greatest(F.when(F.isnan(F.col("v").cast("double")), F.lit(float("inf"))).otherwise(F.col("v").cast("double")), F.lit(-1.7e308)), F.lit(1.7e308)) / 2
    own = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).withColumn("p", place)
    total, low, high = own.agg(F.count("*"), F.min("p"), F.max("p")).first()
    if not total:
        return spark.createDataFrame([], f"q double, value {kind}")
    wanted = {float(q): int((total - 1) * q + 0.5) for q in quantiles}
    cells = {(low, high, 0, total)}  # ends, rows before, rows
    inside = lambda c: (F.col("p") >= F.lit(c[0])) & (F.col("p") <= F.lit(c[1]))
    while large := sorted(c for c in cells if c[3] > RANK_ROWS and c[0] < c[1]):
        number, at = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, c in reversed(list(enumerate(large))):
            number = F.when(inside(c), i).otherwise(number)
            at = F.when(inside(c), F.least(F.floor((F.col("p") - F.lit(c[0])) / F.lit((c[1] - c[0]) or 1.0) * RANK_BINS), F.lit(RANK_BINS - 1)).cast("int")).otherwise(at)
        rows = own.withColumn("cell", number).where("cell is not null").groupBy("cell", at.alias("bin")).agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).collect()
        cells -= set(large)
        for i, c in enumerate(large):
            before = c[2]
            for r in sorted((r for r in rows if r["cell"] == i), key=lambda r: r["bin"]):
                if any(before <= k < before + r["n"] for k in wanted.values()):
                    cells.add((r["low"], r["high"], before, r["n"]))
                before += r["n"]
    rows = [(q, k, c[0], c[2]) for q, k in wanted.items() for c in cells if c[2] <= k < c[2] + c[3]]
    asked = spark.createDataFrame(rows, "q double, i long, cell double, base long")
    cell = F.lit(None).cast("double")
    for c in cells:
        cell = F.when(inside(c), F.lit(c[0])).otherwise(cell)
    counts = own.withColumn("cell", cell).where("cell is not null").groupBy("cell", "v").agg(F.count("*").alias("n"))
    needed = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("cell").orderBy("v")))
    at = F.col("i") - F.col("base")
    return needed.join(F.broadcast(asked), "cell").where((at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))).select("q", F.col("v").alias("value"))


def inspect(notes: DataFrame) -> DataFrame:
    """One row of counters over the whole corpus, in one pass."""
    of = lambda cond: F.count_if(cond).alias
    body = F.col("body")
    return notes.agg(
        F.count("*").alias("notes"), of(F.length(body) < 10)("near_empty"), of(F.col("package_size") == 0)("empty_packages"), F.coalesce(F.sum("package_size"), F.lit(0)).alias("bytes"),
        of(body.rlike(r"(?i)https?://"))("with_links"), of(body.contains("\n"))("multi_line"), F.max(F.length(body)).alias("longest"), F.count_distinct("location").alias("folders"),
    )


#: Failed ids that a report shows.
SHOWN = 8


def smallest(rows: DataFrame, value: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, samples: the k smallest different values of each group in order; nulls don't count.

    Ranks are cut to k in every task before rows are shuffled, so no group is brought together whole.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).distinct()
    if not by:
        own = own.orderBy("_v").limit(k)
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_v"))).where(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.array_compact(F.array(*[F.max(F.when(F.col("_r") == i + 1, F.col("_v"))) for i in range(k)])).alias("samples"))


def report(checks: DataFrame) -> DataFrame:
    """ok, failed, samples (the first SHOWN failed ids) of checks(id, passed, skipped)."""
    bad = ~F.col("passed") & ~F.col("skipped")
    counts = checks.agg(F.coalesce(F.bool_and(~bad), F.lit(True)).alias("ok"), F.count_if(bad).alias("failed"))
    return counts.join(F.broadcast(smallest(checks.where(bad), "id", SHOWN)))
