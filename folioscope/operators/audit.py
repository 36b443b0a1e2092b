"""Audits of bodies, packages and folders; totals of plans and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import markdown, render, text
from folioscope.operators.library import smallest

#: Fixed value: how many of the worst notes a report shows.
WORST = 5


def missing_refs(bodies: DataFrame, entries: DataFrame, refs: Column | None = None) -> DataFrame:
    """key, ref: names that a body refers to whose last segment is no entry of its package.

    bodies: key, html.  entries: key, name (without index_files/).  refs: array of names; those under index_files/ by
    default.  Null keys match nothing, so that their references are missing.
    """
    found = text.resource_refs(F.col("html")) if refs is None else F.array_distinct(refs)
    wanted = bodies.select("key", F.explode(found).alias("ref")).withColumn("name", F.regexp_extract("ref", r"(?s)([^/]*)$", 1))
    return wanted.join(entries.select("key", "name").distinct(), ["key", "name"], "left_anti").select("key", "ref")


def purity(html: Column, host_scheme: str) -> Column:
    """hosts, scripts, ok: references to the application and scripts in an exported text, of which there should be none."""
    hosts, scripts = F.regexp_count(html, F.lit(host_scheme)), F.regexp_count(html, F.lit("(?i)<script"))
    return F.struct(hosts.alias("hosts"), scripts.alias("scripts"), ((hosts == 0) & (scripts == 0)).alias("ok"))


def render_counts(notes: DataFrame) -> DataFrame:
    """guid, fences, rendered, extra: pairs of fence lines in Markdown bodies, code blocks when rendered, how many too many."""
    fences = F.size(F.filter(F.split("body", "\n"), lambda x: text.trim(x).startswith("```")))
    shown = F.regexp_count(render.md_to_html(F.col("body")), F.lit("<pre><code")).cast("long")
    counted = notes.select("guid", F.floor(fences / 2).cast("long").alias("fences"), shown.alias("rendered"))
    return counted.withColumn("extra", F.greatest(F.col("rendered") - F.col("fences"), F.lit(0)).cast("long"))


def worst_rendered(notes: DataFrame) -> DataFrame:
    """The five notes with the most code blocks beyond their fences; ties by guid.

    Those without any come last, so they go after the limit: a filter before it would render every body twice.
    """
    return render_counts(notes).orderBy(F.desc("extra"), "guid").limit(WORST).where("extra > 0")


def action_counts(plan: DataFrame, actions: list[str]) -> DataFrame:
    """One row: how often each action occurs in plan, 0 for an empty one."""
    return plan.agg(*[F.count_if(F.col("action") == a).alias(a.replace("-", "_")) for a in actions])


def tree_totals(files: DataFrame, whitelist: list[str]) -> DataFrame:
    """top, files, bytes of the first segments of paths that the whitelist holds, and '' for the rest."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    return files.groupBy(F.when(top.isin(*whitelist), top).otherwise("").alias("top")).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def trash_files(tombs: DataFrame, disk: DataFrame) -> DataFrame:
    """guid, file: the trashed package of each tombstone, null where there is none.

    tombs: guid, last_path, trash_path.  disk: path, below the trash.  The noted trash_path counts if it is there, else
    the last in order of the files with last_path's name, or with its stem, an underscore and more.  Every underscore
    of a file's name may end a stem, so both are joins on equal keys.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = disk.select("path", name.alias("name")).distinct()
    parts = F.split(F.regexp_replace("name", r"\.zip$", ""), "_")
    stems = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "_"), F.lit(".zip")))
    named = files.select("path", F.explode(F.array_distinct(F.concat(F.array("name"), F.when(F.col("name").endswith(".zip") & F.col("name").contains("_"), stems).otherwise(F.array().cast("array<string>"))))).alias("name"))
    last = named.groupBy("name").agg(F.max("path").alias("fallback"))
    exact = files.select(F.col("path").alias("trash_path"), F.col("path").alias("there"))
    own = tombs.select("guid", "trash_path", F.regexp_extract("last_path", r"([^/]*)$", 1).alias("name"))
    return own.join(exact, "trash_path", "left").join(last, "name", "left").select("guid", F.coalesce("there", "fallback").alias("file"))


#: Fixed value: documents that conversion statistics name for each kind.
NAMED = 5


def conversion_stats(documents: DataFrame) -> DataFrame:
    """One row: documents, what the converter made or left out over all of documents(key, html) (markdown.STATS), and how many came out empty."""
    made = documents.select(markdown.html_to_md_with_stats(F.col("html")).alias("m"))
    counts = [F.coalesce(F.sum(f"m.{n}"), F.lit(0)).cast("long").alias(n) for n in markdown.STATS]
    return made.agg(F.count("*").alias("documents"), *counts, F.count_if(F.col("m.md") == "").alias("empty"))


def conversion_samples(documents: DataFrame) -> DataFrame:
    """kind, documents, samples: for each of markdown.STATS, and for empty, how many of documents(key, html) have it, and the first NAMED keys."""
    made = documents.select("key", markdown.html_to_md_with_stats(F.col("html")).alias("m"))
    kinds = [F.when(F.col(f"m.{n}") > 0, F.lit(n)) for n in markdown.STATS] + [F.when(F.col("m.md") == "", F.lit("empty"))]
    rows = made.select("key", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("documents")).join(smallest(rows, "key", NAMED, ("kind",)), "kind")
