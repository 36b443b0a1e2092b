"""Names, keys and addresses of entries, attachments and objects as Column expressions.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import content_type

#: The longest stem and extension of an entry, the pattern of an image held in a text.
LONGEST_STEM, LONGEST_EXTENSION = 40, 12
DATA_URI = r"data:image/[a-z0-9.+-]+;base64,[A-Za-z0-9+/]+={0,2}"
#: Start and multiplier of FNV-1a with 64 bits, of which the low 32 bits depend on the low 32 bits alone.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LOW = 0xFFFFFFFF


def cloud_key(prefix: str, rest: Column) -> Column:
    """prefix/rest; rest alone where the prefix, less slashes at its ends, is empty."""
    p = prefix.strip("/")
    return F.concat(F.lit(f"{p}/"), rest) if p else rest


def attachment_key(prefix: str, stored: Column) -> Column:
    """The object's key: stored itself where it has the prefix already."""
    p = prefix.strip("/")
    return F.when(stored.startswith(f"{p}/"), stored).otherwise(cloud_key(p, stored)) if p else stored


def attachment_place(path: Column, tier: Column, stored: Column, root: str = "native") -> Column:
    """Where an attachment lies below the prefix: the stored place, or by its tier and its path without attachments/."""
    segment = F.regexp_replace(path, "^attachments/", "")
    folder = F.when(tier == 4, "_unlinked_attachments").otherwise("attachments")
    return F.coalesce(stored, F.concat(F.lit(f"{root}/"), folder, F.lit("/"), segment))


def conflict_place(guid: Column, revision: Column, local: bool = False, root: str = "_conflicts") -> Column:
    """Where the losing copy of a conflict is kept; the local one's name says so."""
    bare = F.regexp_replace(guid, r"^[{}]+|[{}]+$", "")
    return F.concat(F.lit(f"{root}/"), bare, F.lit("_"), revision.cast("string"), F.lit("_local.zip" if local else ".zip"))


def entry_stem(name: Column, fallback: Column) -> Column:
    """Last segment of name without its extension, what isn't a letter, a number or one of -_. made _, at most 40 characters.

    fallback where nothing but _ is left, and for null.
    """
    last = F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)([^/\\]*)$", 1)
    stem = F.substring(F.regexp_replace(F.regexp_replace(last, r"(?s)\.[^.]*$", ""), r"[^\p{L}\p{N}_.-]", "_"), 1, LONGEST_STEM)
    stem = F.regexp_replace(stem, r"\.+$", "")
    return F.when(stem.rlike("^_*$"), fallback).otherwise(stem)


def entry_extension(name: Column) -> Column:
    """ASCII letters and digits after the last dot in lower case, at most 12; bin where there are none, and for null."""
    raw = F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)\.([^.]*)$", 1)
    return F.coalesce(F.nullif(F.lower(F.substring(F.regexp_replace(raw, "[^A-Za-z0-9]", ""), 1, LONGEST_EXTENSION)), F.lit("")), F.lit("bin"))


def url_encode_path(path: Column) -> Column:
    """Percent codes for every byte but ASCII letters, digits and /_-:.@ ."""
    c = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%40", "@")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def path_hash(path: Column) -> Column:
    """Low 32 bits of FNV-1a (64) over the UTF-8 bytes, in eight hex digits."""
    digits = F.hex(F.encode(path, "UTF-8"))
    codes = F.transform(F.filter(F.split(digits, r"(?<=\G..)"), lambda b: b != ""), lambda b: F.conv(b, 16, 10).cast("long"))
    last = F.aggregate(codes, F.lit(FNV_START & LOW).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME & LOW).cast("long")).bitwiseAND(F.lit(LOW)))
    return F.lower(F.lpad(F.hex(last), 8, "0"))


def machine_tag(host: Column) -> Column:
    return F.substring(F.md5(F.coalesce(host, F.lit(""))), 1, 12)


def etag(data: Column) -> Column:
    return F.concat(F.lit('"'), F.md5(data), F.lit('"'))


def valid_content_md5(hex_md5: Column) -> Column:
    """Base64 of an MD5 in hex; null for what isn't one."""
    return F.when(hex_md5.rlike("^[0-9A-Fa-f]{32}$"), F.base64(F.unhex(hex_md5)))


def data_uris(text: Column) -> Column:
    """Images held in the text as data URIs, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(DATA_URI), 0)


def data_uri_bytes(uri: Column) -> Column:
    """What follows base64, as bytes; empty where there is none."""
    return F.unbase64(F.when(uri.contains("base64,"), F.substring_index(uri, "base64,", -1)).otherwise(""))


def as_data_uri(name: Column, data: Column) -> Column:
    """data as a data URI of the type that name's extension tells; base64 without line ends."""
    return F.concat(F.lit("data:"), F.substring_index(content_type(name), ";", 1), F.lit(";base64,"), F.regexp_replace(F.base64(data), r"[\r\n]", ""))


def paste_kind(n_files: Column, text: Column, html: Column) -> Column:
    """files, text-data, html-data or none: what a paste brings, in this order."""
    return F.when(n_files > 0, "files").when(text.rlike(DATA_URI), "text-data").when(html.rlike(r"(?i)<img\s") & html.rlike(DATA_URI), "html-data").otherwise("none")


def reference(entry: Column, name: Column, markdown: bool, image: bool, unnamed: str = "attachment") -> Column:
    """How a body refers to an entry: an image or a link, as Markdown or HTML; brackets and quotes leave the name."""
    shown = F.substring(F.regexp_replace(name, r'[\[\]"]', ""), 1, 80)
    if not image:
        shown = F.when(shown == "", unnamed).otherwise(shown)
    if markdown:
        return F.concat(F.lit("![" if image else "["), shown, F.lit("]("), entry, F.lit(")"))
    return F.concat(F.lit('<img src="'), entry, F.lit('" alt="'), shown, F.lit('">')) if image else F.concat(F.lit('<a href="'), entry, F.lit('">'), shown, F.lit("</a>"))


def error_code(message: Column) -> Column:
    """CODE of 'CODE: what went wrong'; empty where there is none."""
    return F.regexp_extract(message, r"^\s*([A-Z][A-Z0-9_]{2,}):", 1)


def megabytes(n: Column) -> Column:
    return F.round(n / (1 << 20), 1)
