"""Full-text search: substring match in three columns, BM25, folder filter, duplicate collapse; short keywords; history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import ascii_lower, fingerprint

LIMIT, HISTORY = 200, 20
FIELDS = ("title", "body", "location")


def occurrences(text: Column, keyword: str) -> Column:
    """How often keyword occurs in text, overlapping ones too, without regard to case.

    Occurrences of a keyword that doesn't end as it begins can't overlap, and are counted by what replacing them takes away.
    """
    low = keyword.lower()
    if not any(low.endswith(low[:i]) for i in range(1, len(low))):
        whole = F.lower(text)
        return ((F.length(whole) - F.length(F.replace(whole, F.lit(low), F.lit("")))) / len(low)).cast("long")
    return F.regexp_count(F.lower(text), F.concat(F.lit("(?=\\Q"), F.lit(low.replace("\\E", "\\E\\\\E\\Q")), F.lit("\\E)")))


def bm25(notes: DataFrame, keyword: str, totals: tuple[int, float] | None = None) -> DataFrame:
    """Hits of notes(guid, title, body, location, ..) with score (lower is better).

    totals: notes and mean length of the whole corpus, where `notes` are only candidates that an index gave.  What is counted here is
    one row, from one aggregation without a shuffle of rows; term counts are only taken of notes that hold the keyword,
    which a plain contains decides.
    """
    length = sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in FIELDS), F.lit(0))
    low = keyword.lower()
    hit = F.lower("title").contains(low) | F.lower("body").contains(low) | F.lower("location").contains(low)
    marked = notes.withColumn("_d", length).withColumn("_hit", hit)
    count, mean = (F.count("*"), F.avg("_d")) if totals is None else (F.lit(totals[0]), F.lit(float(totals[1])))
    stats = marked.agg(count.alias("_all"), mean.alias("_avg"), F.count_if("_hit").alias("_n"))
    hits = marked.where("_hit").withColumn("_tf", sum((occurrences(F.col(c), keyword) for c in FIELDS), F.lit(0)))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("_all") - F.col("_n") + 0.5) / (F.col("_n") + 0.5)))
    score = -idf * F.col("_tf") * 2.2 / (F.col("_tf") + 1.2 * (0.25 + 0.75 * F.col("_d") / F.col("_avg")))
    return hits.crossJoin(F.broadcast(stats)).withColumn("score", score).drop("_d", "_hit", "_tf", "_all", "_avg", "_n")


def collapse(hits: DataFrame, *order) -> DataFrame:
    """The first of each fingerprint in order, with dup_count; notes of empty text are all kept."""
    own = hits.withColumn("fp", F.when(F.col("body") == "", F.lit("")).otherwise(fingerprint(F.col("body"))))
    key = F.when(F.col("fp") == "", F.col("guid")).otherwise(F.col("fp"))
    same = Window.partitionBy(key)
    ranked = own.withColumn("dup_count", F.when(F.col("fp") == "", F.lit(1)).otherwise(F.count("*").over(same))).withColumn("_r", F.row_number().over(same.orderBy(*order)))
    return ranked.where("_r = 1").drop("_r", "fp")


def found(notes: DataFrame, keyword: str, folder: str | None = None, filter_first: bool = False, totals: tuple[int, float] | None = None) -> DataFrame:
    """The notes of search() with score, hit_in, dup_count, and title and body as they are; totals as in bm25()."""
    keyword = keyword.strip()
    if not keyword:
        return notes.where("false").withColumns({"score": F.lit(0.0), "hit_in": F.lit(""), "dup_count": F.lit(0).cast("long")})
    if len(keyword) < 3:
        top = notes.where(like_any(FIELDS, keyword)).orderBy("guid").limit(LIMIT)
        where, order = ascii_lower(F.col("title")).contains(keyword.lower()), ["guid"]
        top = top.withColumn("score", F.lit(0.0))
    else:
        own = notes.where(F.col("location").startswith(folder)) if folder and filter_first else notes
        top = bm25(own, keyword, totals).orderBy("score", "guid").limit(LIMIT)
        where, order = F.lower("title").contains(keyword.lower()), ["score", "guid"]
    if folder:
        top = top.where(F.col("location").startswith(folder))
    return collapse(top, *order).withColumns({"score": F.round("score", 6), "hit_in": F.when(where, "title").otherwise("body"), "dup_count": F.col("dup_count").cast("long")})


def search(notes: DataFrame, keyword: str, folder: str | None = None, filter_first: bool = False) -> DataFrame:
    """guid, title, location, score, hit_in, dup_count: the best LIMIT by score, then the folder's, then one of each text.

    The folder filter comes after the limit unless filter_first is set.  Keywords of one or two characters go by LIKE, the
    first LIMIT by guid, with score 0.  An empty keyword has no hits.
    """
    return found(notes, keyword, folder, filter_first).select("guid", "title", "location", "score", "hit_in", "dup_count")


def search_index(index, keyword: str, folder: str | None = None) -> DataFrame:
    """search() by a stored index (sources.index.Index): only notes whose trigrams allow the keyword are read.

    It stays with the version that is the newest at the call.  Keywords of one or two characters go through the note table.
    """
    version = index.version()
    keyword = keyword.strip()
    if len(keyword) < 3:
        return search(index.table("note", version), keyword, folder)
    totals = index.describe(version)["totals"]
    own = index.matching(keyword.lower(), version)
    return found(own, keyword, folder, totals=(totals["notes"], totals["d"] / max(1, totals["notes"]))).select("guid", "title", "location", "score", "hit_in", "dup_count")


def respond(notes: DataFrame, attachments: DataFrame, keyword: str, folder: str | None = None) -> DataFrame:
    """The whole answer to a search: kind (note, attachment), id, title, place, snippet, hit_in, score, dup_count.

    Notes as search() has them, their titles marked and with a snippet; attachments(file_path, display_name, db_name, tier) whose
    names match, whatever the folder.  An empty keyword has neither.
    """
    keyword = keyword.strip()
    shown = snippet(F.col("body"), keyword) if len(keyword) < 3 else window(F.col("body"), keyword)
    title = F.col("title") if len(keyword) < 3 else highlight(F.col("title"), keyword)
    hits = found(notes, keyword, folder).select(F.lit("note").alias("kind"), F.col("guid").alias("id"), title.alias("title"), F.col("location").alias("place"), shown.alias("snippet"), "hit_in", "score", "dup_count")
    files = attachments.where(like_any(("display_name", "db_name"), keyword) if keyword else F.lit(False))
    return hits.unionByName(files.select(F.lit("attachment").alias("kind"), F.col("file_path").alias("id"), F.col("display_name").alias("title"), F.lit("").alias("place"), F.lit("").alias("snippet"), F.lit("name").alias("hit_in"), F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("dup_count")))


def like_any(columns, keyword: str) -> Column:
    """LIKE %keyword% over any column, A-Z folded; % in the keyword is dropped, _ matches any character."""
    pattern = "%" + keyword.replace("%", "").replace("\\", "\\\\") + "%"
    out = F.lit(False)
    for c in columns:
        out = out | ascii_lower(F.col(c)).like(pattern.lower() if pattern.isascii() else pattern)
    return out


def snippet(body: Column, keyword: str, before: int = 40, size: int = 120) -> Column:
    """A stretch of the body from a little before the keyword, every occurrence marked."""
    cut = F.substring(body, F.greatest(F.lit(1), F.instr(body, keyword) - before), F.lit(size))
    return F.replace(cut, F.lit(keyword), F.lit(f"<mark>{keyword}</mark>"))


def window(body: Column, keyword: str, size: int = 22) -> Column:
    """About `size` characters around the first occurrence in any case, all in it marked; the body's beginning where there is none."""
    size = max(size, len(keyword))
    at = F.instr(F.lower(body), keyword.lower())
    cut = F.substring(body, F.greatest(F.lit(1), at - (size - len(keyword)) // 2), F.lit(size))
    return F.when(at == 0, F.substring(body, 1, size)).otherwise(highlight(cut, keyword))


def highlight(title: Column, keyword: str) -> Column:
    return F.regexp_replace(title, "(?iu)(\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E)", "<mark>$1</mark>")


def attachment_search(attachments: DataFrame, keyword: str) -> DataFrame:
    return attachments.where(like_any(("display_name", "db_name"), keyword)).orderBy("tier", "display_name")


def record(history: DataFrame, keywords: DataFrame) -> DataFrame:
    """History (keyword, ts) with new ones merged in, the newest of each, HISTORY newest in all."""
    merged = history.unionByName(keywords).groupBy("keyword").agg(F.max("ts").alias("ts"))
    return merged.orderBy(F.desc("ts"), "keyword").limit(HISTORY)


def cleared(history: DataFrame) -> DataFrame:
    """History with nothing in it."""
    return history.where("false")
