"""The derived index as stored tables: versions that one small file commits, and readers that stay with theirs.

root/versions/0000000007.json names what version 7 consists of: for each table layers of files, newest last, and totals of
the corpus.  It is written last and appears whole, under a name that only one writer can get; a writer that dies before
leaves files that no version names (swept later).  A layer made by merge() holds rows and the keys it has touched;
a row counts if no later layer has touched its key.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.operators import grams
from folioscope.operators.lifecycle import index_rows
from folioscope.sources.store import delete, listed, read_text, shuffles_removed, write_new

FIELDS = ("title", "body", "location")
#: Tables that users fill; a rebuild leaves them as they are.
KEPT = ("search_history", "folder_state")
#: A merge on top of so many layers makes the table anew.
LAYERS = 8
#: Numbers of candidates that are broadcast at most.
BROADCAST_NUMBERS = 1_000_000
#: Touched keys of a layer that are broadcast at most; of more, Spark decides.
BROADCAST_KEYS = 2_000_000
#: Bytes of a note table's row groups, about; a table of no more for each core is dealt out to all cores.
FILE_BYTES = 16 << 20


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


class Index:
    """An index at a root folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- versions

    def version(self) -> int:
        """The newest committed version; 0: none."""
        return max((int(n[:-5]) for n, _, _ in listed(self.spark, f"{self.root}/versions") if n.endswith(".json")), default=0)

    def describe(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(read_text(self.spark, f"{self.root}/versions/{version:010d}.json")) if version else {"tables": {}, "totals": {}}

    def _commit(self, after: int, state: dict) -> int:
        if not write_new(self.spark, f"{self.root}/versions/{after + 1:010d}.json", json.dumps(state, indent=1)):
            raise Conflict(f"version {after + 1} is there already")
        return after + 1

    def sweep(self, keep: int = 2) -> int:
        """Delete what none of the newest `keep` versions names, older versions first; how many folders went.  No writer may be at work."""
        newest = self.version()
        old = [v for v in (int(n[:-5]) for n, _, _ in listed(self.spark, f"{self.root}/versions") if n.endswith(".json")) if v <= newest - keep]
        for v in old:
            delete(self.spark, f"{self.root}/versions/{v:010d}.json")
        named = {layer[k] for v in range(max(1, newest - keep + 1), newest + 1) for t in self.describe(v)["tables"].values() for layer in t for k in layer if not k.endswith(("_schema", "_count"))}
        gone = [n for n, _, _ in listed(self.spark, f"{self.root}/data") if n not in {x.partition("/")[0] for x in named}]
        for n in gone:
            delete(self.spark, f"{self.root}/data/{n}")
        return len(gone)

    # ---- reading

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table at a version (the newest): layers with the rows that later layers have touched taken out."""
        return self._rows(name, self.describe(version)["tables"][name])

    def _rows(self, name: str, layers: list[dict]) -> DataFrame:
        rows = None
        for i, layer in enumerate(layers):
            own = self._read(layer, "rows")
            for later in layers[i + 1 :]:
                own = own.join(self._touched(later), self._key(name), "left_anti").select(*own.columns)
            rows = own if rows is None else rows.unionByName(own)
        return rows

    @staticmethod
    def _key(name: str) -> str:
        return {"note": "guid", "folder": "path", "folder_state": "path", "search_history": "keyword"}.get(name, "guid")

    # ---- writing

    def _data(self) -> str:
        return uuid.uuid4().hex

    def _write(self, df: DataFrame, folder: str, name: str, as_: str = "rows") -> dict:
        with shuffles_removed(self.spark):
            df.write.option("parquet.block.size", str(FILE_BYTES)).option("compression", "zstd").parquet(f"{self.root}/data/{folder}/{name}")
        return {as_: f"{folder}/{name}", f"{as_}_schema": df.schema.json()}

    def _read(self, layer: dict, what: str = "rows") -> DataFrame:
        """Files of a layer; their schema is known, so no file is opened for it."""
        return self.spark.read.schema(StructType.fromJson(json.loads(layer[f"{what}_schema"]))).parquet(f"{self.root}/data/{layer[what]}")

    def _touched(self, layer: dict) -> DataFrame:
        """The keys that a layer has touched, for a join with bodies: broadcast while they are few, so bodies stay where they are."""
        keys = self._read(layer, "keys")
        return F.broadcast(keys) if layer.get("keys_count", BROADCAST_KEYS + 1) <= BROADCAST_KEYS else keys

    def _notes(self, notes: DataFrame, folder: str, html: str | None, base: int) -> dict:
        """A layer of notes, numbered from base on, and its postings.

        The tasks that have made the notes write them: bodies are shuffled only in a table so small that some cores had none.
        """
        own, cores = index_rows(notes, html), self.spark.sparkContext.defaultParallelism
        size = notes.select(F.sum(F.octet_length(html or "body"))).first()[0] or 0
        if size <= cores * FILE_BYTES:
            own = own.repartition(cores, "guid")
        d = sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in FIELDS), F.lit(0)).cast("long")
        layer = self._write(own.withColumn("n", F.monotonically_increasing_id() + F.lit(base)).withColumn("d", d), folder, "note")
        with shuffles_removed(self.spark):
            grams.write(grams.postings(self._read(layer).select("n", *FIELDS), FIELDS), f"{self.root}/data/{folder}/grams", max(1, -(-int(size) // (grams.BUCKETS * grams.TASK_BYTES))))
        return {**layer, "grams": f"{folder}/grams"}

    def build(self, notes: DataFrame, html: str | None = None, **tables: DataFrame) -> int:
        """A version with the whole index of notes(guid, title, location, body) made anew, and further tables; the users' tables carry over unless given."""
        now = self.version()
        before, folder = self.describe(now)["tables"], self._data()
        layer = self._notes(notes, folder, html, 0)
        state = {n: [self._write(df, folder, n)] for n, df in tables.items()}
        state |= {n: before[n] for n in KEPT if n in before and n not in state}
        return self._commit(now, {"tables": {**state, "note": [layer]}, "totals": self._totals(self._read(layer))})

    def merge(self, keys: DataFrame, notes: DataFrame, html: str | None = None) -> int:
        """A version in which the rows of keys(guid) are made anew: from notes where they have one, gone where not.  Too many layers are made one."""
        now = self.version()
        state, folder = self.describe(now), self._data()
        touched = self._write(keys.select("guid").where(F.col("guid").isNotNull()).distinct(), folder, "keys", "keys")
        touched["keys_count"] = self._read(touched, "keys").count()
        fresh = notes.join(self._touched(touched), "guid", "left_semi")
        layers = state["tables"]["note"]
        base = max((self._read(x).agg(F.max("n")).first()[0] or 0 for x in layers), default=0) + 1
        layers = [*layers, {**self._notes(fresh, folder, html, base), **touched}]
        found = self._rows("note", layers)
        if len(layers) > LAYERS:
            whole = self._notes(found.drop("n", "d", "body_len", "fingerprint"), folder + "-whole", None, 0)
            layers, found = [whole], self._read(whole)
        return self._commit(now, {"tables": {**state["tables"], "note": layers}, "totals": self._totals(found)})

    def put(self, name: str, rows: DataFrame) -> int:
        """A version with one of the users' tables replaced."""
        now = self.version()
        state = self.describe(now)
        return self._commit(now, {**state, "tables": {**state["tables"], name: [self._write(rows, self._data(), name)]}})

    @staticmethod
    def _totals(notes: DataFrame) -> dict:
        count, total = notes.agg(F.count("*"), F.sum("d")).first()
        return {"notes": count, "d": int(total or 0)}

    # ---- search

    def matching(self, keyword: str, version: int | None = None) -> DataFrame:
        """Rows of the note table that could hold a folded keyword of three characters or more, by the postings of each layer."""
        version = self.version() if version is None else version
        notes, lists, most = self.table("note", version), None, 0
        for layer in self.describe(version)["tables"]["note"]:
            found = grams.candidates(self.spark, f"{self.root}/data/{layer['grams']}", keyword)
            if found is not None:
                lists, most = found[0] if lists is None else lists.unionByName(found[0]), most + found[1]
        if lists is None:
            return notes.where("false")
        return notes.join(F.broadcast(lists) if most <= BROADCAST_NUMBERS else lists, "n", "left_semi")

    def bytes_of_lists(self, keyword: str, version: int | None = None) -> tuple[int, int]:
        """Bytes of the postings' files that a keyword's grams are in, and of all note files."""
        size = lambda paths: sum(listed(self.spark, p)[0][1] for p in paths)
        layers = self.describe(version)["tables"]["note"]
        lists = [p for x in layers for p in grams.asked(self.spark, f"{self.root}/data/{x['grams']}", keyword).inputFiles()]
        return size(lists), size(p for x in layers for p in self._read(x).inputFiles())
