"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Newton steps at most, those of one job, and the relative miss of its target at which a source is done.
ROUNDS, STEPS, CLOSE = 30, 3, 1e-6
#: Resolution of the two histograms that round rates to copies.
BINS = 4096
#: Sources, and bytes of their names, that are broadcast at most; beyond it their rows are shuffled to the documents.
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 8 << 20


def words(text: str) -> Column:
    """Runs of other than ASCII white space in a text; null: 0.  Each, with the space around it, becomes one character, and these are counted."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")) - F.when(F.col(text).rlike(r"^[\x20\x09-\x0D]+$"), F.length(text)).otherwise(0), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, total, target of each source, from (source, total).

    Sources take the weights in turn by code point, null last.  They share `share` of all words by weight; none has
    more than `most` times its own, and what that leaves is shared again by weight.  This is one level with
    target = min(most * total, level * weight): with sources in order of most * total / weight the first ones are
    full, and the level follows from running sums.  It works on one row for each source.
    """
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("total") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    whole = Window.partitionBy()
    level = ranked.withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = level.withColumn("level", (F.sum("total").over(whole) * F.lit(share) - F.col("before")) / F.col("rest"))
    level = level.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("at"), F.col("level")))).over(whole)["level"])
    return level.select("source", "total", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def tilted(size: Column, mean: Column, dual: Column, most: float = MOST) -> Column:
    """A document's rate: exp(dual * size / (size + mean)), at most `most`; where the source is to be full, `most`.

    It is the rate that minimises the sum of (size + mean) (r log r - r) at a given sum of r * size: entropy to the
    source as it is, in which a document counts its words and one mean document.  The tilt is bounded by the
    dual, so very long documents are neither dropped nor always taken twice.
    """
    return F.when(dual.isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.lit(50.0), dual * size / (size + mean)))))


def _newton(state: DataFrame, counts: DataFrame, most: float) -> DataFrame:
    """One step for every source of state(source, target, mean, dual, low, high) by counts(s, size, n); off: it was not at its target before the step."""
    rate = tilted(F.col("size"), F.col("mean"), F.col("dual"), most)
    mass = F.col("n") * F.col("size") * rate
    slope = F.when(rate < most, mass * F.col("size") / (F.col("size") + F.col("mean"))).otherwise(0.0)
    open_ = state.where(F.col("dual").isNotNull())
    sums = counts.join(open_, F.col("s").eqNullSafe(F.col("source"))).groupBy("s").agg(F.sum(mass).alias("mass"), F.sum(slope).alias("slope"))
    miss = F.col("mass") - F.col("target")
    low = F.when(miss < 0, F.greatest("low", "dual")).otherwise(F.col("low"))
    high = F.when(miss >= 0, F.least("high", "dual")).otherwise(F.col("high"))
    step = F.col("dual") - miss / F.col("slope")
    inside = (F.col("slope") > 0) & (step > F.col("low_")) & (step < F.col("high_"))
    moved = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("low_", low).withColumn("high_", high)
    off = F.abs(miss) > CLOSE * F.col("target")
    following = F.when(~off | F.col("mass").isNull(), F.col("dual")).when(inside, step).otherwise((F.col("low_") + F.col("high_")) / 2)
    return moved.select("source", "target", "mean", following.alias("dual"), F.coalesce("low_", "low").alias("low"), F.coalesce("high_", "high").alias("high"), F.coalesce(off, F.lit(False)).alias("off"))


def duals(docs: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """source, mean, dual for each source of docs(source, size) and its target; dual null: every document at `most`.

    Newton's method on every source's convex dual at once, held within a bracket that each step narrows.  A step
    is one aggregation over (source, size) counts, which are far fewer than documents; the driver learns only
    whether any source is still off.
    """
    counts = docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    about = wanted.join(docs.where("size > 0").groupBy(F.col("source").alias("s")).agg(F.avg("size").alias("mean")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    full = F.col("target") >= F.col("total") * F.lit(most * (1 - 1e-12))
    state = about.select("source", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.when(full, None).otherwise(F.log(F.col("target") / F.col("total")) * 1.5).alias("dual"), F.lit(-200.0).alias("low"), F.lit(200.0).alias("high"))
    counts = staged(counts, "size-counts").select(F.col("source").alias("s"), "size", "n")
    state = staged(state, "duals")
    for _ in range(0, ROUNDS, STEPS):
        following = state
        for _ in range(STEPS):
            following = _newton(following, counts, most)
        following = staged(following, "duals")
        discard(state)
        state = following.drop("off")
        if following.where("off").isEmpty():
            break
    # sums come in any order; nine places are the same in every run
    return state.select("source", "mean", F.round("dual", 9).alias("dual"), "target")


def rated(docs: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """docs(doc_id, source, size, ..) with the columns of their source in sources, rate, floor, and key.

    key is rate's fraction less a hash of the document, in first-level bins (0 <= key < BINS), higher first; a rate without a
    fraction has none.
    """
    got = docs.join(sources, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    got = got.withColumn("rate", F.when(F.col("size") > 0, tilted(F.col("size"), F.col("mean"), F.col("dual"), most)).otherwise(0.0))
    least = F.floor("rate")
    uniform = F.pmod(F.xxhash64("doc_id", "size", F.lit(8)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return got.withColumn("floor", least.cast("long")).withColumn("key", F.when(F.col("rate") > least, (F.col("rate") - least - uniform + 1) * (BINS / 2)))


def source_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each source of docs(doc_id, source, size), staged: s, source_size, target, mean, dual, cut (the threshold, in first-level bins).

    With it a document's copies follow from its own row (see copies).
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("total"))
    wanted = staged(targets(sizes, weights, share, most), "targets")
    dual = staged(duals(docs, wanted.where("total > 0"), most), "tilts")
    about = wanted.join(dual.select(F.col("source").alias("s"), "mean", "dual"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), F.col("total").alias("source_size"), "target", "mean", "dual")
    about = staged(about, "sources")
    own = rated(docs, about, most)
    spent = own.groupBy(F.col("source").alias("s2")).agg(F.sum(F.col("floor") * F.col("size")).alias("spent"))
    need = about.join(spent, F.col("s").eqNullSafe(F.col("s2"))).select("s", (F.col("target") - F.col("spent")).alias("need"))
    need = staged(need, "needs")

    def threshold(bins: DataFrame, needed: DataFrame, name: str) -> DataFrame:
        """The last bin from the top, of each source, that begins below the need; and what remains of it there."""
        down = Window.partitionBy("b_source").orderBy(F.col(name).desc())
        above = bins.withColumn("above", F.sum("mass").over(down) - F.col("mass")).join(needed, F.col("b_source").eqNullSafe(F.col("s")))
        got = above.where(F.col("above") < F.col("need")).groupBy("s").agg(F.min(name).alias(name), F.max("above").alias("above"))
        return needed.join(got.withColumnRenamed("s", "s3"), F.col("s").eqNullSafe(F.col("s3")), "left").select("s", (F.col("need") - F.coalesce("above", F.lit(0))).alias("need"), F.coalesce(name, F.lit(2 * BINS)).alias(name))

    bin1 = F.floor("key").cast("int")
    fraction = own.where(F.col("key").isNotNull()).withColumn("bin1", bin1).withColumn("bin2", F.floor((F.col("key") - bin1) * BINS).cast("int"))
    first = staged(threshold(fraction.groupBy(F.col("source").alias("b_source"), "bin1").agg(F.sum("size").alias("mass")), need, "bin1"), "first-bins")
    edge = fraction.join(first.select("s", F.col("bin1").alias("edge")), F.col("source").eqNullSafe(F.col("s"))).where("bin1 = edge")
    second = threshold(edge.groupBy(F.col("source").alias("b_source"), "bin2").agg(F.sum("size").alias("mass")), first.select("s", "need"), "bin2")
    cut = first.select(F.col("s").alias("s4"), F.col("bin1").alias("cut1")).join(second.select(F.col("s").alias("s5"), F.col("bin2").alias("cut2")), F.col("s4").eqNullSafe(F.col("s5")), "left")
    plan = staged(about.join(cut, F.col("s").eqNullSafe(F.col("s4")), "left").select(*about.columns, (F.col("cut1") + F.least(F.coalesce("cut2", F.lit(BINS)), F.lit(BINS)) / BINS).alias("cut")), "mix")
    discard(wanted, dual, about, need, first)
    return plan


def copies(docs: DataFrame, plan: DataFrame, most: float = MOST) -> DataFrame:
    """docs(doc_id, source, size, ..) with source_size, target, rate and copies, by their sources' rows; those are broadcast while they are few."""
    n, size = plan.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("s")), F.lit(0))).first()
    got = rated(docs, F.broadcast(plan) if n <= BROADCAST_SOURCES and size <= BROADCAST_BYTES else plan, most)
    more = F.col("key") >= F.col("cut")
    return got.select(*docs.columns, "source_size", "target", "rate", (F.col("floor") + F.when(more, 1).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Every row of docs(doc_id, source, size) with source_size, target, rate and copies (0, 1, .. most).

    Copies are a rate rounded down, and one more where rate's fraction less a hash of the document (uniform in 0 to
    1) exceeds its source's threshold: 0 would make it right on average, and the threshold that makes it right in
    words is found by two histograms of BINS bins, the second within the bin that the first names.  A source then
    misses its target by what one second-level bin holds, and equal rows share their fate.
    Nulls: a null source is a source, last in order; a null doc_id hashes like any value.  Documents of size 0 have
    0 copies.  An empty table gives no rows.
    """
    docs = docs.select("doc_id", "source", "size")
    return copies(docs, source_plan(docs, weights, share, most), most)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, staged: texts are read once."""
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size")), "sizes")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs(doc_id, text, source, ..), all columns, each row as often as the mix takes it.

    Texts are read twice and never shuffled: their sizes give the sources' rows, and each document's copies follow from
    its own row and its source's.  Null and empty texts have no words and are not taken; a null source is a source; a
    null doc_id is like any other; equal rows share their fate.  Any other columns stay, whatever their names.  An
    empty table gives none.
    """
    narrow = sized(docs)
    plan = source_plan(narrow, weights, share, most)
    discard(narrow)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    taken = copies(whole, plan, most).select("whole", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("whole.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(documents(spark, sf_dir))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
