"""The document library as DataFrames over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The newest manifest schema that readers accept, and the defaults of columns that older ones lack.
SCHEMA_VERSION = 6
DEFAULTS = {"content_format": ("string", "html"), "dirty_info": ("int", 0), "dirty_data": ("int", 0), "revision": ("long", 0), "synced_revision": ("long", 0), "has_attachment": ("int", 0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """guid, location, title, body, package_size, data_modified, doc_id; nulls become empty strings, as in any scan of the library.

    nulls: bodies stay null where the texts are.
    """
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").cast("string").alias("guid"),
        F.concat(F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/")).alias("location"),
        F.substring(F.split_part(text, F.lit("\n"), F.lit(1)), 1, 120).alias("title"),
        (F.col("text") if nulls else text).alias("body"),
        F.octet_length(text).cast("long").alias("package_size"),
        F.date_format(F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, int(doc_id), 0)"), "yyyy-MM-dd HH:mm:ss").alias("data_modified"),
        "doc_id",
    )


def conform(df: DataFrame, version: int = SCHEMA_VERSION, origin: str = "imported") -> DataFrame:
    """df with every manifest column that it lacks, at its default; newer schemas are refused.

    origin: what the library calls notes that came from its source before there was such a column.
    """
    if version > SCHEMA_VERSION:
        raise ValueError(f"manifest schema {version} is newer than {SCHEMA_VERSION}")
    for name, (kind, value) in {"origin": ("string", origin), **DEFAULTS}.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast(kind))
    return df.fillna({"has_attachment": 0})


def manifest(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """guid, md5, path, synced_revision, dirty_info, dirty_data of one of two replicas, edited apart by rule."""
    n = notes(spark, sf_dir)
    path = F.concat("location", "guid", F.lit(".zip"))
    if side == "local":
        return n.where("doc_id % 11 <> 0").select("guid", F.md5("body").alias("md5"), path.alias("path"), (F.col("doc_id") % 5).alias("synced_revision"), (F.col("doc_id") % 7 == 0).alias("dirty_info"), (F.col("doc_id") % 13 == 0).alias("dirty_data"))
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body"))
    moved = F.when(F.col("doc_id") % 19 == 0, F.concat(F.lit("/moved"), path)).otherwise(path)
    return n.where("doc_id % 17 <> 0").select("guid", F.md5(changed).alias("md5"), moved.alias("path"), (F.col("doc_id") % 6).alias("synced_revision"), F.lit(False).alias("dirty_info"), F.lit(False).alias("dirty_data"))


def tombstones(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """guid, removed_at, synced_revision of deleted notes."""
    k = 11 if side == "local" else 17
    d = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int"))
    return notes(spark, sf_dir).where(f"doc_id % {k} = 0 or doc_id % 101 = 0").select("guid", F.date_format(d, "yyyy-MM-dd").alias("removed_at"), (F.col("doc_id") % 3).alias("synced_revision"))
