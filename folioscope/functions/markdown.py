"""HTML to Markdown by the standard library's tokenizer, as an Arrow-batched UDF; and what notes' code blocks need."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from folioscope.sources.store import in_bounded_batches

#: Part of export decisions: documents made by another version are made anew.
CONVERTER_VERSION = "3"

STATS = ("code_blocks", "code_tables", "mirrors", "tables", "layout_tables", "dropped_data_imgs")
#: Elements that are left out with all they hold, and elements without an end that are left out alone.
IGNORED = ("style", "script", "title", "noscript", "iframe", "svg", "canvas", "object", "template")
IGNORED_VOID = ("meta", "link", "base", "embed", "input", "param", "source", "track", "col", "area", "wbr")
BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "figure", "address", "form"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: All elements without an end.
VOID = {"br", "hr", "img", *IGNORED_VOID}


#: Classes of tables that lay out code beside its line numbers, and of tables that lay out one column.
CODE_TABLES = ("lntable", "crayon-table", "hljs-ln", "syntaxhighlighter", "highlighter", "diff-table", "blob-code", "crayon-code", "code-table", "chroma")
LAYOUT_TABLE = "d-block"
#: Parts of class names (in any case) of the cells of a code table that hold line numbers, and of elements in
#: code that are no code; a button in code is none either.
GUTTER = ("nums", "number", "gutter", "blob-num", "lineno")
CHROME = ("pre-numbering", "hljs-button", "hljs-ln-numbers", "crayon-nums", "copy-code", "code-copy", "copy-button", "btn-copy")
_LANGUAGE = re.compile(r"(?:brush:|language-|lang-|highlight-|source-)(?:source-|highlight-)?([a-z0-9+#]{1,16})")
_NUMBER = re.compile(r"\s*[0-9]+\s*")
_BLOCK_START = re.compile(r"[ \t]*(?:[-*+](?:[ \t]|$)|[0-9]+[.)] |>|\||```|#+ )")


def escape(text: str) -> str:
    """Characters that Markdown would read as marks, escaped; < only where a tag could begin."""
    return re.sub(r"([\\`*_\[\]]|<(?=[A-Za-z/!?]))", r"\\\1", text)


def language_of(cls: str) -> str:
    """The language that a class names by a prefix, else ''."""
    found = (_LANGUAGE.fullmatch(t) for t in re.sub(r"brush:\s+", "brush:", cls.lower()).split())
    return next((m[1] for m in found if m), "")


def dedent_layout(text: str) -> str:
    """Lines of four or more columns of indent without it, unless a list, quote, table, fence or heading begins there; white lines are empty."""
    out = []
    for line in text.split("\n"):
        bare = line.lstrip(" \t")
        indent = len(line[: len(line) - len(bare)].expandtabs(4))
        out.append("" if not line.strip() else bare if indent >= 4 and not _BLOCK_START.match(line) else line)
    return "\n".join(out)


def edges_off(code: str) -> str:
    """code without carriage returns, white space at line ends and empty lines at both ends."""
    lines = [x.rstrip() for x in code.replace("\r", "").split("\n")]
    some = [i for i, x in enumerate(lines) if x]
    return "\n".join(lines[some[0] : some[-1] + 1]) if some else ""


def without_numbers(code: str) -> str:
    """code without the lines of numbers at its end, if there are two or more of them."""
    lines = code.rstrip("\n").split("\n")
    n = len(lines)
    while n and _NUMBER.fullmatch(lines[n - 1]):
        n -= 1
    return "\n".join(lines[:n] if len(lines) - n >= 2 else lines).rstrip("\n")


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.skip = 0
        self.head = False
        self.lists: list[list] = []
        self.quotes = 0
        self.pre: list[str] | None = None
        self.chrome: tuple[str, int] | None = None  # a part of code that is no code: its tag, and how deep it is nested
        self.language = ""
        self.container = ""
        self.hidden: list[str] | None = None
        self.mirror: tuple[str, int] | None = None
        self.links: list[tuple[str, int]] = []
        self.tables: list[dict] = []
        self.code_table: dict | None = None
        self.layout: list[bool] = []
        self.marks: list[int] = []
        self.stats = dict.fromkeys(STATS, 0)

    def fence(self, code: str, language: str) -> None:
        if not code.strip():
            return
        mark = "```" if "```" not in code else "~~~~"
        self.flush(True)
        self.out += [mark + language, *code.split("\n"), mark, ""]
        self.stats["code_blocks"] += 1

    def inside(self, tag: str, end: bool, at: tuple[str, int]) -> tuple[str, int] | None:
        """How deep in an element that is left out a tag of its own name leads; None at its end."""
        if tag != at[0] or tag in VOID:
            return at
        return (tag, at[1] + (-1 if end else 1)) if not end or at[1] > 1 else None

    # -- output
    def flush(self, blank: bool = False) -> None:
        text = re.sub(r"[ \t]+", " ", "".join(self.line)).strip()
        self.line = []
        self.marks = []
        if text:
            self.out.append("> " * self.quotes + text)
        if blank and self.out and self.out[-1] != "":
            self.out.append("")

    def target(self) -> list[str]:
        return self.tables[-1]["cell"] if self.tables and self.tables[-1]["cell"] is not None else self.line

    # -- events
    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        cls = a.get("class") or ""
        if tag in ("head", "body"):  # a head that was never closed ends with the body's begin
            self.head = tag == "head"
        if self.head:
            return
        if self.mirror:
            self.mirror = self.inside(tag, False, self.mirror)
            return
        if tag in IGNORED:
            self.skip += 1
        if self.skip:
            return
        if "code_mirror" in tag:
            self.mirror = (tag, 1)
            self.stats["mirrors"] += 1
            return
        if a.get("data-mode") is not None or a.get("data-lang") is not None:
            self.container = a.get("data-mode") or a.get("data-lang") or ""
        if tag == "textarea":
            self.hidden = [] if re.search(r"(?i)display\s*:\s*none", a.get("style") or "") else None
            return
        if self.code_table is not None:
            self.code_start(tag, cls)
            return
        if self.pre is not None:
            if self.chrome:
                self.chrome = self.inside(tag, False, self.chrome)
            elif tag == "button" or any(m in cls.lower() for m in CHROME):
                self.chrome = (tag, 1)
            elif tag in ("br", "li") and (tag == "br" or (self.pre and not "".join(self.pre[-1:]).endswith("\n"))):
                self.pre.append("\n")
            elif tag == "code":
                self.language = self.language or language_of(cls)
            return
        if tag == "table" and not self.tables and (any(m in cls.lower() for m in CODE_TABLES) or "diff" in cls.lower().split()):
            tokens = cls.lower().split()
            after = tokens[tokens.index("syntaxhighlighter") + 1 :][:1] if "syntaxhighlighter" in tokens else []
            self.code_table = {"depth": 1, "rows": [], "cell": None, "language": "diff" if {"diff", "diff-table"} & set(tokens) else "".join(after)}
            return
        if tag == "table" and not self.tables:
            self.layout.append(LAYOUT_TABLE in cls.split())
            if self.layout[-1]:
                self.stats["layout_tables"] += 1
                self.flush(True)
                return
        if self.layout and self.layout[-1] and tag in ("tbody", "thead", "tr", "td", "th"):
            self.flush(True)
            return
        if tag in HEADINGS:
            self.flush(True)
            self.line.append("#" * HEADINGS[tag] + " ")
        elif tag == "table":
            if not self.tables:
                self.flush(True)
            self.tables.append({"rows": [], "cell": None, "complex": False})
        elif tag == "tr" and self.tables:
            self.tables[-1]["rows"].append([])
        elif tag in ("td", "th") and self.tables:
            self.tables[-1]["cell"] = []
            self.tables[-1]["complex"] |= any(re.fullmatch(r"[0-9]+", a.get(k) or "") and int(a[k]) > 1 for k in ("colspan", "rowspan"))
        elif tag in BLOCKS:
            if not self.tables:
                self.flush(True)
            elif tag == "div":
                self.target().append("\n")
        elif tag == "pre":
            self.flush(True)
            self.pre = []
            self.language = language_of(cls)
        elif tag in ("ul", "ol"):
            self.flush(not self.lists)
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.line.append("- " if kind[0] == "ul" else f"{kind[1]}. ")
        elif tag == "blockquote":
            self.flush(True)
            self.quotes += 1
        elif tag == "hr":
            self.flush(True)
            self.out += ["---", ""]
        elif tag == "br":
            if self.tables:
                self.target().append("\n")
            else:
                self.flush()
        elif tag == "input" and (a.get("type") or "").lower() == "checkbox":
            self.target().append("[x] " if "checked" in a else "[ ] ")
        elif tag == "img":
            if (src := a.get("src") or "").startswith("data:"):
                self.stats["dropped_data_imgs"] += 1
            elif src:
                self.target().append(f"![{escape(a.get('alt') or '')}]({src})")
        elif tag == "a":
            self.links.append((a.get("href") or "", len(self.target())))
        elif tag in ("b", "strong", "i", "em", "del", "s", "code"):
            self.marks.append(len(self.target()))

    def handle_endtag(self, tag):
        if self.head:
            self.head = tag != "head"
            return
        if self.mirror:
            self.mirror = self.inside(tag, True, self.mirror)
            return
        if tag in IGNORED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "textarea":
            if self.hidden is not None:
                self.fence("".join(self.hidden).strip("\n"), self.container)
            self.hidden, self.container = None, ""
            return
        if self.code_table is not None:
            self.code_end(tag)
            return
        if tag == "pre" and self.pre is not None:
            code = without_numbers("".join(self.pre).replace("\u200b", "").replace("\u00a0", " ").strip("\n"))
            self.pre, self.chrome = None, None
            self.fence(code, self.language)
            return
        if self.pre is not None:
            if self.chrome:
                self.chrome = self.inside(tag, True, self.chrome)
            return
        if tag == "table" and not self.tables and self.layout and self.layout.pop():
            self.flush(True)
            return
        if self.layout and self.layout[-1] and tag in ("tbody", "thead", "tr", "td", "th"):
            self.flush(True)
            return
        if tag in HEADINGS or (tag in BLOCKS and not self.tables):
            if not re.fullmatch(r"#+ ", "".join(self.line)):
                self.flush(True)
            self.line = []
        elif tag in ("td", "th") and self.tables and self.tables[-1]["cell"] is not None:
            t = self.tables[-1]
            if not t["rows"]:
                t["rows"].append([])
            t["rows"][-1].append("<br>".join(x for x in (re.sub(r"\s+", " ", y).strip() for y in "".join(t["cell"]).split("\n")) if x).replace("|", "\\|"))
            t["cell"] = None
        elif tag == "table" and self.tables:
            self.end_table()
            if not self.tables and self.layout:
                self.layout.pop()
        elif tag in ("ul", "ol") and self.lists:
            self.flush()
            self.lists.pop()
            if not self.lists:
                self.flush(True)
        elif tag == "li":
            prefix = "  " * max(0, len(self.lists) - 1)
            before = len(self.out)
            self.flush()
            self.out[before:] = [prefix + x for x in self.out[before:]]
        elif tag == "blockquote":
            self.flush(True)
            self.quotes = max(0, self.quotes - 1)
        elif tag == "a" and self.links:
            href, at = self.links.pop()
            own = self.target()
            label = "".join(own[at:]).strip()
            if label and href and not href.lower().startswith("javascript:"):
                own[at:] = [f"[{label}]({href})"]
        elif tag in ("b", "strong", "i", "em", "del", "s", "code") and self.marks:
            own, at = self.target(), self.marks.pop()
            inner = "".join(own[at:])
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(tag, "~~")
            if inner.strip():  # an empty mark goes
                own[at:] = [inner[: len(inner) - len(inner.lstrip())], mark + inner.strip() + mark, inner[len(inner.rstrip()) :]]

    # -- tables of code: line numbers go, each row or each line of a cell is a line
    def code_start(self, tag: str, cls: str) -> None:
        t = self.code_table
        if tag == "table":
            t["depth"] += 1
        elif tag == "tr":
            t["rows"].append([])
        elif tag in ("td", "th"):
            t["cell"] = {"gutter": any(g in cls.lower() for g in GUTTER), "text": []}
            (t["rows"] or t["rows"].append([]) or t["rows"])[-1].append(t["cell"])
        elif t["cell"] is not None and tag in ("br", "div", "li", "p") and t["cell"]["text"] and not t["cell"]["text"][-1].endswith("\n"):
            t["cell"]["text"].append("\n")

    def code_end(self, tag: str) -> None:
        t = self.code_table
        if tag in ("td", "th"):
            t["cell"] = None
        elif tag == "table":
            t["depth"] -= 1
            if t["depth"]:
                return
            self.code_table = None
            lines = []
            for row in t["rows"]:
                cells = [(c["gutter"], edges_off("".join(c["text"]).replace("\u200b", "").replace("\u00a0", " "))) for c in row]
                if any(marked for marked, _ in cells):  # a class says which cells are numbers: the others stay, empty ones as empty lines
                    lines += [x for marked, x in cells if not marked]
                else:
                    lines += [x for _, x in cells if x and not re.fullmatch(r"[0-9\s]*", x)]
            before = self.stats["code_blocks"]
            self.fence("\n".join(lines), t["language"])
            self.stats["code_tables"] += self.stats["code_blocks"] - before

    def end_table(self) -> None:
        t = self.tables.pop()
        rows = [r for r in t["rows"] if r]
        if self.tables and self.tables[-1]["cell"] is not None:
            self.tables[-1]["cell"].append("\n" + "\n".join(c.replace("<br>", "\n").replace("\\|", "|") for r in rows for c in r))
            return
        if not rows:
            return
        width = max(map(len, rows))
        if t["complex"]:  # merged cells: a line for each row
            self.out += [x for x in (" | ".join(r).strip() for r in rows) if x] + [""]
            self.stats["tables"] += 1
            return
        rows = [r + [""] * (width - len(r)) for r in rows]
        self.stats["tables"] += 1
        self.out += ["| " + " | ".join(r) + " |" for r in rows[:1]] + ["|" + " --- |" * width] + ["| " + " | ".join(r) + " |" for r in rows[1:]] + [""]

    def handle_data(self, data):
        if self.skip or self.head or self.mirror or self.chrome:
            return
        if self.hidden is not None:
            self.hidden.append(data)
        elif self.code_table is not None:
            if self.code_table["cell"] is not None:
                self.code_table["cell"]["text"].append(data)
        elif self.pre is not None:
            self.pre.append(data)
        else:
            self.target().append(escape(re.sub(r"\s+", " ", data)))


def convert_with_stats(html: str | None) -> tuple[str, dict[str, int]]:
    """Markdown of one HTML text, at most one blank line in a row outside code; and what was made or left out (STATS)."""
    w = _Writer()
    if html:
        w.feed(html)
        w.close()
        if w.pre is not None:
            w.handle_endtag("pre")
        while w.tables:
            w.end_table()
        w.flush()
    parts, code = [], None  # lines of code as they are, others dedented and with single blank lines
    for line in w.out:
        if code is None and re.match("```|~~~~", line):
            code = line[:4] if line.startswith("~~~~") else "```"
        elif code is not None:
            code = None if line == code else code
        else:
            line = dedent_layout(line)
            if not line and (not parts or not parts[-1]):
                continue
        parts.append(line)
    return "\n".join(parts).strip(), w.stats


#: An ampersand that begins no reference with its semicolon.
_BARE = r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)"


def references_closed(html: Column) -> Column:
    """html in which only references that end in a semicolon are any: &amp that was cut before its semicolon stays text.

    Browsers, and html_to_md, also read some names without it.
    """
    return F.regexp_replace(html, _BARE, "&amp;")


def convert(html: str | None) -> str:
    """Markdown of one HTML text."""
    return convert_with_stats(html)[0]


@in_bounded_batches
@F.pandas_udf(StringType())
def html_to_md(html: pd.Series) -> pd.Series:
    return html.map(convert)


@in_bounded_batches
@F.pandas_udf(StructType([StructField("md", StringType()), *[StructField(n, IntegerType()) for n in STATS]]))
def html_to_md_with_stats(html: pd.Series) -> pd.DataFrame:
    made = [convert_with_stats(h) for h in html]
    return pd.DataFrame({"md": [m for m, _ in made], **{n: [s[n] for _, s in made] for n in STATS}})


_BLOCKS = ArrayType(StructType([StructField("mode", StringType()), StructField("source", StringType()), StructField("rendered", BooleanType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
#: A code area's hidden source, the editor's container with its language, and the lines that the editor rendered.
_TEXTAREA = re.compile(r"(?is)<textarea\b([^>]*)>(.*?)</textarea>")
_HIDDEN = re.compile(r"(?is)display(.{0,17})")
_CONTAINER = re.compile(r"(?is)<(?!textarea\b|/)[a-z][^>]*\bdata-(?:mode|lang)\s*=\s*[\"']([^\"']*)[^>]*>")
_RENDERED = re.compile(r"(?is)<pre\b[^>]*\bclass\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</pre>")


def rendered_lines(mirror: str) -> list[str]:
    """Lines of code that the editor has rendered: class CodeMirror-line as a word, and none that is for measuring."""
    own = [m for m in _RENDERED.finditer(mirror) if "CodeMirror-line" in m[1].split() and "measure" not in m[1]]
    return [unescape(re.sub(r"(?s)<[^>]*>", "", m[2])).replace("\u200b", "").replace("\u00a0", " ") for m in own]


def find_blocks(text: str, mirror: str = "code-mirror") -> list[dict]:
    """Hidden, non-empty text areas that hold code.

    mode is the language of the nearest container that ends before the area; rendered tells whether an element named
    by mirror follows with lines in it.
    """
    containers = [(m.end(), m[1]) for m in _CONTAINER.finditer(text)]
    out, mode, k = [], "", 0
    for m in _TEXTAREA.finditer(text):
        hidden = _HIDDEN.search(m[1])
        while k < len(containers) and containers[k][0] <= m.start():
            mode, k = containers[k][1], k + 1
        if not (hidden and "none" in hidden[1].lower()) or not m[2].strip():
            continue
        after = re.compile(rf"\s*<{re.escape(mirror)}>(.*?)</{re.escape(mirror)}>", re.S).match(text, m.end())
        out.append({"mode": mode, "source": unescape(m[2]), "rendered": bool(after and rendered_lines(after[1])), "start": m.start(), "end": m.end()})
    return out


@in_bounded_batches
@F.pandas_udf(_BLOCKS)
def code_blocks(html: pd.Series) -> pd.Series:
    """find_blocks of every text; null has none."""
    return html.map(lambda text: find_blocks(text or ""))
