"""The change log as keyed state: one state value for each note, kept by Spark's state store between micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "ts long, event string, writes long, info_ts long, data_ts long, sync_ts long"
#: Before any time.
NEVER = -(1 << 62)


def _folded(changes: DataFrame) -> DataFrame:
    """Of each note the newest change (ties: the larger event name), how many there were, and when info and data were last written and last synced.

    Each is a maximum or a sum, so neither the order of arrival nor where batches end matters, and tasks fold their own rows before the shuffle.
    """
    sync = F.coalesce(F.col("event") == "sync", F.lit(False))
    last = lambda which: F.coalesce(F.max(F.when(which, F.col("ts"))), F.lit(NEVER))
    return changes.groupBy("guid").agg(
        F.max(F.struct("ts", "event")).alias("v"), F.count("*").alias("writes"), last(F.col("dirty_info") & ~sync).alias("info_ts"), last(F.col("dirty_data") & ~sync).alias("data_ts"), last(sync).alias("sync_ts")
    ).select("guid", "v.ts", "v.event", "writes", "info_ts", "data_ts", "sync_ts")


def run(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start folding stream(guid, ts, event, dirty_info, dirty_data); each batch appends the notes it has changed to folder, as Parquet.

    State lives in the state store below checkpoint, by key: a batch reads and writes the notes that its changes name, however
    many there are besides, and a restart goes on from the last committed batch.  Changes without a guid are left out.
    """
    spark = stream.sparkSession
    spark.conf.set(STORE, ROCKS)
    own = stream.where("guid is not null").select("guid", F.col("ts").cast("long").alias("ts"), "event", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("dirty_info", "dirty_data")])
    changed = _folded(own)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def state(spark: SparkSession, folder: str) -> DataFrame:
    """guid, ts, event, writes, dirty_info, dirty_data, deleted: the newest row of each note over all batches.

    A latch is set if what it stands for was written after the last sync; a note whose newest change is a delete stays, as a tombstone.
    """
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    columns = [c.split()[0] for c in STATE.split(", ")]
    own = rows.groupBy("guid").agg(F.max_by(F.struct(*columns), "batch").alias("v"))
    return own.select("guid", "v.ts", "v.event", "v.writes", F.expr("v.info_ts > v.sync_ts").alias("dirty_info"), F.expr("v.data_ts > v.sync_ts").alias("dirty_data"), F.expr("v.event = 'delete'").alias("deleted"))
