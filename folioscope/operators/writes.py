"""Row-level changes of the library as pure functions from events to manifests: save, rename, move, delete, restore, create."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = "guid string, title string, path string, md5 string, data_modified string, revision long, synced_revision long, dirty_info boolean, dirty_data boolean"


def apply_events(manifest: DataFrame, deleted: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest and tombstones (guid, removed_at, payload, synced_revision) after one event at most for each note.

    events(guid, kind, title, path, md5, at).  Save latches data where the bytes changed; rename and move latch info; all
    raise the revision.  Delete moves the row, as JSON, to the tombstones, unpublished.  Restore brings it back with
    its own data_modified and the data latch set, unless the note exists or its path is taken.  Create sets both latches.
    """
    e = events.select("guid", "kind", F.col("title").alias("e_title"), F.col("path").alias("e_path"), F.col("md5").alias("e_md5"), "at")
    own = manifest.join(e, "guid", "left")
    is_ = lambda *kinds: F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    save, info = is_("save") & (F.col("e_md5") != F.col("md5")), is_("rename", "move")
    changed = own.where(~is_("delete")).select(
        "guid", F.when(is_("rename"), F.col("e_title")).otherwise(F.col("title")).alias("title"), F.when(info, F.coalesce("e_path", "path")).otherwise(F.col("path")).alias("path"),
        F.when(save, F.col("e_md5")).otherwise(F.col("md5")).alias("md5"), F.when(is_("save"), F.col("at")).otherwise(F.col("data_modified")).alias("data_modified"),
        (F.col("revision") + F.when(is_("save") | info, 1).otherwise(0)).alias("revision"), "synced_revision", (F.col("dirty_info") | info).alias("dirty_info"), (F.col("dirty_data") | save).alias("dirty_data"),
    )
    created = e.where("kind = 'create'").join(manifest, "guid", "left_anti").select("guid", F.col("e_title").alias("title"), F.col("e_path").alias("path"), F.col("e_md5").alias("md5"), F.col("at").alias("data_modified"), F.lit(0).cast("long").alias("revision"), F.lit(0).cast("long").alias("synced_revision"), F.lit(True).alias("dirty_info"), F.lit(True).alias("dirty_data"))
    back = deleted.join(e.where("kind = 'restore'").select("guid"), "guid").join(manifest.select("guid"), "guid", "left_anti").withColumn("r", F.from_json("payload", COLUMNS))
    back = back.join(manifest.select(F.col("path").alias("_taken")), F.col("r.path") == F.col("_taken"), "left_anti")
    restored = back.select("guid", "r.title", "r.path", "r.md5", "r.data_modified", (F.col("r.revision") + 1).alias("revision"), "r.synced_revision", "r.dirty_info", F.lit(True).alias("dirty_data"))
    buried = own.where(is_("delete")).select("guid", F.col("at").alias("removed_at"), F.to_json(F.struct(*[c.split(" ")[0] for c in COLUMNS.split(", ")])).alias("payload"), F.lit(0).cast("long").alias("synced_revision"))
    gone = deleted.join(restored.select("guid"), "guid", "left_anti").join(buried.select("guid"), "guid", "left_anti").unionByName(buried)
    return changed.unionByName(created).unionByName(restored), gone
