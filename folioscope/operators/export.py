"""Exports: packages of notes with their resources and attachments, folders of them, and pages that need no other file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import render, text
from folioscope.functions.keys import as_data_uri
from folioscope.operators.library import export_names
from folioscope.operators.lifecycle import unique_names
from folioscope.sources.packages import HTML_BODY, MARKDOWN_BODY

ENTRIES = "array<struct<name: string, data: binary>>"
#: References of a page and of a style sheet that are put inside.
IMAGE, SHEET, STYLE_URL = r'(?i)(<img[^>]*\ssrc=")(index_files/[^"]+)(")', r'(?i)(<link[^>]*\shref=")(index_files/[^"]+)("[^>]*>)', r"""url\((['"]?)([^'")]+)(['"]?)\)"""
#: Characters of the private area that part literal text and references; where a text has the first itself, the third follows it.
_PART, _END, _OWN = "\ue0f0", "\ue0f1", "\ue0f2"


def safe_entry_name(name: Column) -> Column:
    """A resource's name with plain slashes, or null where it would leave the package: absolute, with a drive, or with .. in it, also percent-encoded."""
    plain = F.replace(name, F.lit("\\"), F.lit("/"))
    decoded = plain
    for _ in range(3):
        decoded = F.coalesce(F.try_url_decode(F.replace(decoded, F.lit("+"), F.lit("%2B"))), decoded)
    good = ~plain.startswith("/") & ~decoded.contains(":") & ~decoded.contains("\\") & ~decoded.startswith("/") & ~decoded.rlike(r"(^|/)\.\.(/|$)") & (F.length(plain) > 0) & ~decoded.contains("\u0000")
    return F.when(good, plain)


def attached(notes: DataFrame, attachments: DataFrame | None) -> DataFrame:
    """guid, items (name, href, size, for the closing block) and files (name, data) of attachments(guid, display_name, data, size, at).

    Files are called attachments/{name}, free of collisions in each note, in order of `at`; one without data is listed and not held.
    """
    if attachments is None:
        return notes.select("guid").distinct().select("guid", F.array().cast("array<struct<name: string, href: string, size: bigint>>").alias("items"), F.array().cast(ENTRIES).alias("files"))
    there = attachments.where("data is not null").select(F.col("guid").alias("scope"), "at", text.sanitize_title(F.col("display_name")).alias("name"))
    named = unique_names(there).select(F.col("scope").alias("guid"), "at", F.concat(F.lit("attachments/"), "unique").alias("href"))
    own = attachments.join(named, ["guid", "at"], "left")
    item = F.struct("at", F.struct(F.col("display_name").alias("name"), F.coalesce("href", F.lit("")).alias("href"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size")).alias("item"), F.struct(F.col("href").alias("name"), "data").alias("file"))
    all_ = own.groupBy("guid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    return all_.select("guid", F.transform("all", lambda x: x["item"]).alias("items"), F.filter(F.transform("all", lambda x: x["file"]), lambda f: f["name"].isNotNull()).cast(ENTRIES).alias("files"))


def packages(notes: DataFrame, form: str = "markdown", attachments: DataFrame | None = None, heading: str = "附件", absent: str = "文件未随导出下载") -> DataFrame:
    """path, guid, entries, skipped of notes(guid, title, location, body, resources: array of name, data): what write_packages() takes.

    form: markdown (note.md and the resources as they are), or html (index.html with the closing block of attachments, the
    resources and the attachments).  Paths are folder names and titles made safe and free of collisions; resources that would
    leave the package, and a second body, are left out and counted in skipped.  Null bodies are empty ones.
    """
    names = export_names(notes).select("guid", F.ltrim(F.concat_ws("/", "directory", F.concat("name", F.lit(".zip"))), F.lit("/")).alias("path"))
    resources = F.coalesce(F.col("resources").cast(ENTRIES) if "resources" in notes.columns else F.lit(None).cast(ENTRIES), F.array().cast(ENTRIES))
    own = notes.select("guid", F.coalesce("body", F.lit("")).alias("body"), F.filter(F.transform(resources, lambda r: F.struct(safe_entry_name(r["name"]).alias("name"), r["data"].alias("data"))), lambda r: ~F.coalesce(r["name"].isin(MARKDOWN_BODY, HTML_BODY), F.lit(False))).alias("all"))
    kept = F.filter("all", lambda r: r["name"].isNotNull())
    told = own.withColumn("skipped", F.size("all") - F.size(kept)).withColumn("kept", kept)
    if form == "markdown":
        body = F.array(F.struct(F.lit(MARKDOWN_BODY).alias("name"), F.encode("body", "utf-8").alias("data"))).cast(ENTRIES)
        made = told.select("guid", F.concat(body, "kept").alias("entries"), "skipped")
    else:
        own_files = attached(notes, attachments)
        both = told.join(own_files, "guid", "left")
        html = F.when(F.size("items") > 0, text.inject_before_body_end(F.col("body"), render.attachments_block(F.col("items"), heading, absent))).otherwise(F.col("body"))
        body = F.array(F.struct(F.lit(HTML_BODY).alias("name"), F.encode(html, "utf-8").alias("data"))).cast(ENTRIES)
        made = both.select("guid", F.concat(body, "kept", F.coalesce("files", F.array().cast(ENTRIES))).alias("entries"), "skipped")
    return made.join(names, "guid").select("path", "guid", "entries", "skipped")


def wanted_packages(packages_: DataFrame, plan: DataFrame) -> DataFrame:
    """The packages that an export plan (library.export_plan) writes anew: notes added or changed; others stay as they are on disk."""
    return packages_.join(plan.where(F.col("status").isin("added", "reexported")).select("guid"), "guid", "left_semi")


# ---- pages that need no other file


def _marked(c: Column, pattern: str, kind: str) -> Column:
    """c with each reference between marks: kind, what is before it in its tag, the name, what is after it."""
    inner = f"{_PART}{kind}{_PART}$1{_PART}$2{_PART}$3{_END}"
    return F.regexp_replace(c, pattern, inner)


def parts(pages: DataFrame, key: str = "guid", body: str = "html", patterns: tuple[tuple[str, str], ...] = (("img", IMAGE), ("css", SHEET))) -> DataFrame:
    """key, at, kind, before, name, after, literal: a text as an ordered stream; each row is a reference and the literal text that follows it.

    The first row of a text has no reference.  before + name + after + literal of all rows in order are the text itself.
    """
    own = F.replace(F.coalesce(body, F.lit("")), F.lit(_PART), F.lit(_PART + _OWN))
    for kind, pattern in patterns:
        own = _marked(own, pattern, kind)
    # a mark followed by the third character is the text's own
    pieces = F.split(own, f"{_PART}(?=(?:{'|'.join(k for k, _ in patterns)}){_PART})")
    rows = pages.select(key, F.posexplode(pieces).alias("at", "piece"))
    ref, literal = F.substring_index("piece", _END, 1), F.substring(F.col("piece"), F.instr("piece", _END) + 1, F.length("piece"))
    field = F.split(ref, f"{_PART}(?!{_OWN})")
    back = lambda c: F.replace(c, F.lit(_PART + _OWN), F.lit(_PART))
    is_ref = F.col("at") > 0
    return rows.select(
        key, "at", F.when(is_ref, field[0]).alias("kind"), F.when(is_ref, back(field[1])).alias("before"), F.when(is_ref, back(field[2])).alias("name"), F.when(is_ref, back(field[3])).alias("after"),
        back(F.when(is_ref, literal).otherwise(F.col("piece"))).alias("literal"),
    )


def _with_entry(refs: DataFrame, entries: DataFrame, name: Column) -> DataFrame:
    """refs with `data` of entries(guid, name, data): by the exact name, else by the percent-decoded one."""
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    exact = entries.select(F.col("guid").alias("_g"), F.col("name").alias("_n"), F.col("data").alias("_exact"))
    other = entries.select(F.col("guid").alias("_g2"), F.col("name").alias("_n2"), F.col("data").alias("_other"))
    found = refs.withColumn("_wanted", name).withColumn("_plain", plain)
    found = found.join(exact, (F.col("guid") == F.col("_g")) & (F.col("_wanted") == F.col("_n")), "left")
    found = found.join(other, F.col("_exact").isNull() & (F.col("guid") == F.col("_g2")) & (F.col("_plain") == F.col("_n2")), "left")
    return found.withColumn("data", F.coalesce("_exact", "_other")).drop("_wanted", "_plain", "_g", "_n", "_exact", "_g2", "_n2", "_other")


def _together(rows: DataFrame, keys: list[str], shown: Column) -> DataFrame:
    """keys, whole: the shown texts of rows in order of `at`."""
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("s")))), lambda x: x["s"]), "").alias("whole"))


def self_contained(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """guid, html, inlined, left of pages(guid, html): images and style sheets of entries(guid, name, data) put inside, images of style sheets too.

    inlined: references that were replaced; left: those whose entry isn't there, which stay as they are.  Style sheets lose
    their byte order mark; their references that begin with data: or http stay.  Names go by their folder in the sheet.
    A page is put together from its own parts only; entries are joined by (guid, name), so no package is read whole.
    """
    rows = _with_entry(parts(pages), entries, F.col("name"))
    sheets = rows.where("kind = 'css' and data is not null").select("guid", F.col("at").alias("of"), "name", F.regexp_replace(F.make_valid_utf8(F.col("data").cast("string")), "^\ufeff", "").alias("css"))
    inner = parts(sheets.withColumn("id", F.struct("guid", "of", "name")), "id", "css", (("url", STYLE_URL),)).select(F.col("id.guid").alias("guid"), F.col("id.of").alias("of"), F.col("id.name").alias("sheet"), "at", F.concat(F.lit("url("), "before").alias("before"), "name", F.concat("after", F.lit(")")).alias("after"), "literal")
    folder = F.regexp_extract("sheet", r"^(.*/)[^/]*$", 1)
    stays = F.col("name").startswith("data:") | F.col("name").startswith("http")
    inner = _with_entry(inner, entries, F.when(~stays, F.concat(folder, "name")))
    shown = F.when(F.col("data").isNotNull(), F.concat(F.lit("url("), as_data_uri(F.col("name"), F.col("data")), F.lit(")"))).otherwise(F.concat("before", "name", "after"))
    styled = _together(inner, ["guid", "of"], F.concat(F.coalesce(shown, F.lit("")), "literal")).withColumnRenamed("whole", "css").withColumnRenamed("of", "at")
    both = rows.join(styled, ["guid", "at"], "left")
    plain = F.concat("before", "name", "after")
    shown = F.when((F.col("kind") == "img") & F.col("data").isNotNull(), F.concat("before", as_data_uri(F.col("name"), F.col("data")), "after")).when(F.col("css").isNotNull(), F.concat(F.lit("<style>"), "css", F.lit("</style>"))).otherwise(plain)
    whole = _together(both, ["guid"], F.concat(F.coalesce(shown, F.lit("")), "literal"))
    counts = rows.groupBy("guid").agg(F.count_if(F.col("kind").isNotNull() & F.col("data").isNotNull()).alias("inlined"), F.count_if(F.col("kind").isNotNull() & F.col("data").isNull()).alias("left"))
    return whole.join(counts, "guid").select("guid", F.col("whole").alias("html"), "inlined", "left")


def export_counts(rows: DataFrame) -> DataFrame:
    """One row: notes, entries and bytes of packages as written (path, entries, size)."""
    return rows.agg(F.count("*").alias("notes"), F.coalesce(F.sum(F.size("entries")), F.lit(0)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
