"""Text functions as Column expressions: HTML to text, names, paths, escapes, hashes.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that file names may not hold, the longest name, patterns of markup in the order they go.
ILLEGAL = r'[\\/:*?"<>|]'
CONTROL = r"[\x00-\x1f]"
LONGEST_NAME = 120
MARKUP = (
    (r"(?is)<style[\s\S]*?</style>", " "),
    (r"(?is)<script[\s\S]*?</script>", " "),
    (r"(?s)<!--[\s\S]*?-->", " "),
    (r"(?i)</(p|div|li|tr|h[1-6]|br)\s*>|<br\s*/?>", "\n"),
    (r"(?s)<[^>]*>", " "),
)
#: Folders that aren't the user's, names shown as text, types by extension, labels of attachment origins.
SYSTEM_FOLDERS = ["/My Notes/", "/My Drafts/", "/My Journals/", "/My Sticky Notes/", "/Deleted Items/"]
TEXT_EXTENSIONS = ["log", "jtl", "sh", "jmx", "txt", "conf", "ini", "json", "py", "xml", "csv"]
CONTENT_TYPES = {
    "html": "text/html; charset=utf-8",
    "htm": "text/html; charset=utf-8",
    "css": "text/css; charset=utf-8",
    "js": "text/javascript; charset=utf-8",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "ico": "image/x-icon",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "eot": "application/vnd.ms-fontobject",
    "json": "application/json; charset=utf-8",
    "txt": "text/plain; charset=utf-8",
    "php": "text/html; charset=utf-8",
}
ORIGINS = {0: "文件未随导出下载", 1: "库内记录", 2: "按文件名推断", 3: "归属存疑"}


def _all(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


#: Characters with Unicode's property White_Space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def ascii_lower(c: Column) -> Column:
    """A-Z folded, other letters as they are: the case rule of name comparisons and of LIKE here."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def decode_entities(c: Column) -> Column:
    """Named entities of HTML's five and nbsp, and numeric ones, in one pass; unknown ones stay.

    The ampersand's own entity goes last, by way of a private mark, so that nothing is decoded twice.
    """
    mark = "\ue000"
    c = F.replace(c, F.lit("&amp;"), F.lit(mark))
    for name, by in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(by))
    pieces = F.split(c, r"(?=&#[0-9xX])|(?<=;)")

    def numeric(p: Column) -> Column:
        dec, hexa = F.regexp_extract(p, r"^&#([0-9]{1,7});$", 1), F.regexp_extract(p, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        code = F.coalesce(F.nullif(dec, F.lit("")).cast("int"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("int"))
        bad = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        shown = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.isNull(), p).when(bad, F.lit("")).otherwise(shown)

    decoded = F.when(c.contains("&#"), F.array_join(F.transform(pieces, numeric), "")).otherwise(c)
    return F.replace(decoded, F.lit(mark), F.lit("&"))


def extract_text(html: Column) -> Column:
    """Plain text of HTML: no style, script, comments or tags; block ends and br are line feeds; entities decoded; white space folded."""
    c = decode_entities(_all(html, *MARKUP))
    return trim(_all(c, (r"[ \t\r\f]+", " "), (r"(?U)\n\s*\n+", "\n")))


def fingerprint(text: Column) -> Column:
    """First 16 bytes of SHA-256 of the trimmed text, in hex."""
    return F.substring(F.sha2(trim(text), 256), 1, 32)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sanitize_title(c: Column) -> Column:
    """A title as a file name: illegal characters to _, no controls, no dots at the end, never empty, 120 characters at most."""
    c = _all(trim(c), (ILLEGAL, "_"), (CONTROL, ""))
    c = F.regexp_replace(trim(c), r"\.+$", "")
    return F.substring(F.when(c == "", "untitled").otherwise(c), 1, LONGEST_NAME)


def sanitize_location(c: Column) -> Column:
    """sanitize_title for each segment of a path; empty segments stay, so that slashes at the ends do."""
    return F.array_join(F.transform(F.split(c, "/"), lambda s: F.when(s == "", s).otherwise(sanitize_title(s))), "/")


def ancestors(location: Column) -> Column:
    """/a/b/ -> [/a/, /a/b/]."""
    parts = F.filter(F.split(location, "/"), lambda s: s != "")
    return F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))


def name_of(path: Column) -> Column:
    return F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1)


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]+/$", "")


def normalize_code(c: Column) -> Column:
    """Tabs to four spaces, no zero-width spaces, no-break spaces to spaces."""
    return F.replace(F.replace(F.replace(c, F.lit("\t"), F.lit("    ")), F.lit("\u200b"), F.lit("")), F.lit("\u00a0"), F.lit(" "))


def is_guid(c: Column) -> Column:
    """Hex digits and dashes, in braces or not."""
    return F.regexp_replace(c, r"^\{|\}$", "").rlike(r"^[0-9a-fA-F-]+$")


def normalize_guid(c: Column) -> Column:
    return F.when(is_guid(c), F.lower(F.regexp_replace(c, r"^\{|\}$", "")))


def normalize_location(c: Column) -> Column:
    """Canonical /a/b/ form; null where a segment is . or .. ."""
    parts = F.transform(F.filter(F.split(c, "/"), lambda s: trim(s) != ""), trim)
    joined = F.array_join(parts, "/")
    return F.when(F.exists(parts, lambda s: s.isin(".", "..")), F.lit(None)).when(joined == "", F.lit("/")).otherwise(F.concat(F.lit("/"), joined, F.lit("/")))


def unsafe_path(c: Column) -> Column:
    return c.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def reserved_path(c: Column) -> Column:
    """Any segment that begins with _ or . ."""
    return c.rlike(r"(^|/)[_.]")


def system_folder(c: Column) -> Column:
    return c.isin(*SYSTEM_FOLDERS)


def illegal_name(c: Column) -> Column:
    return c.rlike(r'[:*?"<>|]') | (F.length(c) > LONGEST_NAME)


def remote_url(c: Column) -> Column:
    return c.rlike(r"(?i)^(https?:)?//")


def previewable(name: Column) -> Column:
    return extension(name).isin(*TEXT_EXTENSIONS)


def origin_label(tier: Column, source: Column) -> Column:
    """How an attachment came to its note, in the words that users see; '' for none."""
    out = F.when((tier == 0) & (source == "db-missing"), ORIGINS[0])
    for n in (1, 2, 3):
        out = out.when(tier == n, ORIGINS[n])
    return out.otherwise("")


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, F.format_string("%.1f KB", F.bround(n / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / (1 << 20), 1)))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,8})$", 1))


def content_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return F.coalesce(table[extension(name)], F.lit("application/octet-stream"))


def image_kind(data: Column) -> Column:
    """png, jpg, gif, webp, bmp or svg by the first bytes; null for others."""
    head = F.hex(F.substring(data, 1, 12))
    text = F.lower(F.make_valid_utf8(F.substring(data, 1, 256).cast("string")))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp").when(head.startswith("424D"), "bmp").when(text.contains("<svg"), "svg")
    )


def disk_path(source_path: Column) -> Column:
    """attachments/x lies at _attachments/x on disk; other paths where they say."""
    return F.when(source_path.startswith("attachments/"), F.concat(F.lit("_"), source_path)).otherwise(source_path)


def content_md5(hex_md5: Column) -> Column:
    return F.base64(F.unhex(hex_md5))


def resource_refs(html: Column) -> Column:
    """Distinct names under index_files/ that the HTML refers to."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"index_files/([^\"'()\s<>?#]+)"), 1))


def inject_before_body_end(html: Column, snippet: Column) -> Column:
    """snippet and a line feed before the last </body> of any case, else a line feed and snippet at the end."""
    at = F.regexp_instr(F.reverse(ascii_lower(html)), F.lit(">ydob/<"))
    cut = F.length(html) - at - 6
    return F.when(at > 0, F.concat(F.substring(html, F.lit(1), cut), snippet, F.lit("\n"), F.substring(html, cut + 1, F.length(html)))).otherwise(F.concat(html, F.lit("\n"), snippet))


#: The forms of Markdown lines, in the order they are tried.  Indents are looser than when rendering.
LINES = (
    ("fence", r"\s*(?:`{3,}|~{3,})"),
    ("hr", r"\s{0,3}(?:-(?:\s*-){2,}|\*(?:\s*\*){2,}|_(?:\s*_){2,})\s*$"),
    ("heading", r"\s*(#{1,6})\s+"),
    ("list", r"[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+(\[[ xX]\][ \t]+)?"),
    ("quote", r"\s*(?:>[ \t]?)+"),
    ("table", r"\s{0,3}\|.*\|\s*$"),
)


def line_kind(line: Column) -> Column:
    """blank, fence, hr, heading, list, quote, table or text, of a Markdown line without its line feed."""
    kind = F.when(line.rlike(r"(?U)^\s*$"), "blank")
    for name, form in LINES:
        kind = kind.when(line.rlike(f"(?U)^{form}"), name)
    return kind.otherwise("text")


def validate_html(html: Column, host_scheme: str) -> Column:
    """rejected (empty, host reference, or null), scripts (how many), no_text, before a body is saved.

    host_scheme: the URL scheme by which the application refers to itself, which must not get into bodies.
    """
    rejected = F.when(trim(html) == "", "empty").when(html.contains(host_scheme), "host reference")
    return F.struct(rejected.alias("rejected"), F.regexp_count(html, F.lit("(?i)<script")).alias("scripts"), (extract_text(html) == "").alias("no_text"))


def canonical_role(role: Column) -> Column:
    """The older name of the writer's role mapped to the present one; others as they are."""
    return F.when(role == "export", "writer").otherwise(role)


def canonical_policy(policy: Column) -> Column:
    """on_demand, or full for anything else, so that a slip of the pen never hides notes."""
    return F.when(trim(policy) == "on_demand", "on_demand").otherwise("full")
