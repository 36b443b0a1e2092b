"""The change log as a stream: latest state of each note, in parts by a hash of the key; a micro-batch rewrites those it touches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources.store import delete, listed, read_text, write_new

#: Parts of the state.
PARTS = 256


def fold(changes: DataFrame) -> DataFrame:
    """guid, ts, event, writes, dirty, deleted: the newest event of each key, how many there were, and its latch.

    Ties go to the larger event name, so the order of arrival doesn't matter.
    """
    newest = F.max(F.struct("ts", "event"))
    return changes.groupBy("guid").agg(newest.alias("v"), F.count("*").alias("writes")).select("guid", "v.ts", "v.event", "writes", (F.col("v.event") != "sync").alias("dirty"), (F.col("v.event") == "delete").alias("deleted"))


def merge(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State with a batch's fold merged in: newer events win, writes add up."""
    both = state.unionByName(fold(batch))
    top = both.groupBy("guid").agg(F.max(F.struct("ts", "event")).alias("v"), F.sum("writes").alias("writes"))
    return top.select("guid", "v.ts", "v.event", "writes", (F.col("v.event") != "sync").alias("dirty"), (F.col("v.event") == "delete").alias("deleted"))


#: Batches whose versions stay, for readers that have begun and batches that run again.
KEPT_BATCHES = 10


def run(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start folding stream(guid, ts, event) into folder/v{batch}/part=..; a batch that runs again writes the same version again.

    A batch reads and writes the parts that its keys are in.  folder/index/{batch}.json, written last, says where the newest
    version of each part is after it; the one below the batch's own number is its base, so a lost driver or executor costs a retry
    and nothing else, and a batch lists nothing but the index.  Versions that no recent index names are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("guid"), F.lit(PARTS)).cast("int")
        touched = [r[0] for r in batch.select(part.alias("part")).distinct().collect()]
        newest = newest_parts(spark, folder, number)
        before = [f"{folder}/{newest[p]}" for p in touched if p in newest]
        out = merge(spark.read.parquet(*before), batch) if before else fold(batch)
        out.withColumn("part", part).write.partitionBy("part").mode("overwrite").parquet(f"{folder}/v{number}")
        newest |= {p: f"v{number}/part={p}" for p in touched}
        delete(spark, f"{folder}/index/{number:012d}.json")
        write_new(spark, f"{folder}/index/{number:012d}.json", json.dumps(newest))
        prune(spark, folder, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexes(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches that have an index."""
    return [int(n[:-5]) for n, _, _ in listed(spark, f"{folder}/index") if n.endswith(".json")]


def latest_version(spark: SparkSession, folder: str, below: int | None = None) -> int | None:
    return max((n for n in indexes(spark, folder) if below is None or n < below), default=None)


def newest_parts(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, str]:
    """Where the newest version of each part is, below folder."""
    number = latest_version(spark, folder, below)
    return {} if number is None else {int(p): at for p, at in json.loads(read_text(spark, f"{folder}/index/{number:012d}.json")).items()}


def prune(spark: SparkSession, folder: str, number: int) -> None:
    """Delete the indexes of batches before the last KEPT_BATCHES, and the parts that none of the others names."""
    old = [n for n in indexes(spark, folder) if n <= number - KEPT_BATCHES]
    if not old:
        return
    stay = {at for n in indexes(spark, folder) if n > number - KEPT_BATCHES for at in json.loads(read_text(spark, f"{folder}/index/{n:012d}.json")).values()}
    gone = {at for n in old for at in json.loads(read_text(spark, f"{folder}/index/{n:012d}.json")).values()} - stay
    for at in gone:
        delete(spark, f"{folder}/{at}")
    for n in old:
        delete(spark, f"{folder}/index/{n:012d}.json")


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The whole state; there has to be one."""
    return spark.read.parquet(*[f"{folder}/{at}" for at in newest_parts(spark, folder).values()])
