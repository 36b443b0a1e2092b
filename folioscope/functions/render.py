"""Markdown to HTML and to coloured source; hidden code made visible.  Arrow-batched UDFs over whole texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from folioscope.functions import inlines, text
from folioscope.functions.markdown import find_blocks
from folioscope.functions.text import html_escape, human_size, normalize_code
from folioscope.sources.store import in_bounded_batches

# ---- Markdown to HTML: blocks are read line by line, a block's inside by the same reader

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-*+]|[0-9]{1,9}[.)])(?:([ ]{1,4})(?=\S)|[ ]*$|([ ]))")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r"[ ]{0,3}\|?[ ]*:?-+:?[ ]*(\|[ ]*:?-+:?[ ]*)*\|?[ ]*$")
_HTML = re.compile(r" {0,3}<(?:!--|\?|![A-Z]|/?(?:address|article|aside|blockquote|body|center|details|div|dl|dt|dd|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|meta|nav|ol|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))", re.I)


#: Blocks within blocks that are followed; deeper ones stay text.
DEPTH = 100
#: Addresses of the text's references; a text is read for them first if it can have any.
_references: inlines.References = {}


def _safe(text: str) -> str:
    return inlines.safe(text)


def _quoted(text: str) -> str:
    return inlines.quoted(inlines.plain(text))


def _inline(text: str) -> str:
    return inlines.inline(text, _references)


def _cells(line: str) -> list[str]:
    line = re.sub(r"^\s*\|", "", line.rstrip())
    line = re.sub(r"(?<!\\)\|$", "", line)
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def _table(head: str, delimiter: str, body: list[str]) -> str:
    sides = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":"))) for c in _cells(delimiter)]

    def row(line: str, tag: str) -> str:
        cells = (_cells(line) + [""] * len(sides))[: len(sides)]
        return "<tr>" + "".join(f"<{tag}" + (f' style="text-align: {s}"' if s else "") + f">{_inline(c)}</{tag}>" for c, s in zip(cells, sides, strict=True)) + "</tr>"

    rows = "".join(row(x, "td") + "\n" for x in body)
    return f"<table><thead>{row(head, 'th')}</thead><tbody>\n{rows}</tbody></table>\n"


def _paragraph(lines: list[str], tight: bool) -> str:
    text = inlines.definitions("\n".join(x.lstrip() for x in lines).rstrip(), _references)
    if not text:
        return ""
    return _inline(text) if tight else f"<p>{_inline(text)}</p>\n"


def _starts_block(line: str) -> bool:
    item = _ITEM.match(line)
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or re.match(r" {0,3}>", line) or _HTML.match(line) or (item and line[item.end() :].strip() and item[2] in ("-", "*", "+", "1.", "1)")))


def _list(lines: list[str], i: int, depth: int) -> tuple[str, int]:
    """The list that begins at line i, and the line after it."""
    first = _ITEM.match(lines[i])
    kind, items, loose, gap = first[2][-1], [], False, False
    while i < len(lines):
        m = _ITEM.match(lines[i])
        if not m or m[2][-1] != kind or _RULE.match(lines[i]):
            break
        loose |= gap
        width = len(m[1]) + len(m[2]) + len(m[3] or " ")
        own, i, gap = [lines[i][width:]], i + 1, False
        while i < len(lines):
            if not lines[i].strip():
                own.append("")
                gap = True
            elif lines[i].startswith(" " * width):
                loose |= gap and not _ITEM.match(lines[i].lstrip())
                own.append(lines[i][width:])
                gap = False
            elif gap or _ITEM.match(lines[i]) or _starts_block(lines[i]):
                break
            else:
                own.append(lines[i].lstrip())
            i += 1
        while own and not own[-1]:
            own.pop()
        items.append(own or [""])
    out = []
    for own in items:
        box = re.match(r"\[([ xX])\]\s+", own[0])
        if box:
            own = [own[0][box.end() :], *own[1:]]
        inner = _blocks(own, depth + 1, not loose)
        mark = f'<input disabled="" type="checkbox"{"" if box[1] == " " else chr(32) + "checked=" + chr(34) * 2}/>\n' if box else ""
        out.append(f"<li>{mark}{inner}</li>\n" if not loose else f"<li>\n{mark}{inner}</li>\n")
    if kind in ".)":
        number = int(first[2][:-1])
        return (f'<ol start="{number}">\n' if number != 1 else "<ol>\n") + "".join(out) + "</ol>\n", i
    return "<ul>\n" + "".join(out) + "</ul>\n", i


def _blocks(lines: list[str], depth: int = 0, tight: bool = False) -> str:
    """HTML of lines; tight: paragraphs without their tags, as in a list whose items have no blank lines between."""
    if depth > DEPTH:
        return _paragraph(lines, tight)
    out, i, n = [], 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif line.startswith("    "):
            j = i
            while j < n and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            code = "\n".join(x[4:] for x in lines[i:j]).strip("\n")
            out.append(f"<pre><code>{_safe(code)}\n</code></pre>\n")
            i = j
        elif m := _FENCE.match(line):
            j = i + 1
            while j < n and not re.match(r" {0,3}" + re.escape(m[1]) + m[1][0] + r"*\s*$", lines[j]):
                j += 1
            code = "".join(_safe(x) + "\n" for x in lines[i + 1 : j])
            out.append(f'<pre><code class="language-{_quoted(m[2])}">{code}</code></pre>\n' if m[2] else f"<pre><code>{code}</code></pre>\n")
            i = j + 1
        elif m := _HEADING.match(line):
            level = len(m[1])
            out.append(f"<h{level}>{_inline(m[2] or '')}</h{level}>\n")
            i += 1
        elif _RULE.match(line):
            out.append("<hr />\n")
            i += 1
        elif re.match(r" {0,3}>", line):
            j, own = i, []
            while j < n and lines[j].strip() and (re.match(r" {0,3}>", lines[j]) or (own and own[-1].strip() and not _starts_block(lines[j]))):
                own.append(re.sub(r"^ {0,3}> ?", "", lines[j]))
                j += 1
            out.append(f"<blockquote>\n{_blocks(own, depth + 1)}</blockquote>\n")
            i = j
        elif _ITEM.match(line):
            made, i = _list(lines, i, depth)
            out.append(made if not (tight and out) else "\n" + made)
        elif _HTML.match(line):
            j = i
            while j < n and lines[j].strip():
                j += 1
            out.append("\n".join(lines[i:j]) + "\n")
            i = j
        elif "|" in line and i + 1 < n and _DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1] and len(_cells(line)) == len(_cells(lines[i + 1])):
            j = i + 2
            while j < n and lines[j].strip() and not _starts_block(lines[j]):
                j += 1
            out.append(_table(line, lines[i + 1], lines[i + 2 : j]))
            i = j
        else:
            j = i + 1
            while j < n and lines[j].strip() and not _UNDERLINE.match(lines[j]) and not _starts_block(lines[j]):
                j += 1
            if j < n and (m := _UNDERLINE.match(lines[j])):
                level, own = 1 if m[1][0] == "=" else 2, inlines.definitions("\n".join(x.strip() for x in lines[i:j]), _references)
                if not own:  # definitions alone: the underline is no underline
                    i = j
                    continue
                out.append(f"<h{level}>{_inline(own)}</h{level}>\n")
                j += 1
            else:
                out.append(_paragraph(lines[i:j], tight))
            i = j
    return "".join(out)


def to_html(md: str | None) -> str:
    """HTML of one Markdown text; null gives empty."""
    if not md:
        return ""
    text = md.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd")
    lines = [re.sub(r"^([ ]{0,3})\t", r"\1    ", x) for x in text.split("\n")]
    _references.clear()
    if "]:" in text:
        _blocks(lines)
    return _blocks(lines)


@in_bounded_batches
@F.pandas_udf(StringType())
def md_to_html(md: pd.Series) -> pd.Series:
    return md.map(to_html)


def document(md: Column, title: Column, css: str = "", language: str = "en") -> Column:
    """A whole HTML document around the body that md_to_html makes."""
    head = f'<!DOCTYPE html>\n<html lang="{language}"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><title>'
    return F.concat(F.lit(head), html_escape(title), F.lit(f'</title><style>{css}</style></head><body class="md-body">'), md_to_html(md), F.lit("</body></html>"))


# ---- coloured source: tags go in, no character of the escaped source is lost

#: The forms of text.LINES.
_LINES = tuple((name, re.compile(form)) for name, form in text.LINES)
_EMPHASIS = {"***": "md-strong md-em", "___": "md-strong md-em", "**": "md-strong", "__": "md-strong", "~~": "md-strike", "*": "md-em", "_": "md-em"}


def _nearest(mark: str) -> str:
    """mark, what lies before its nearest repeat, and that; underscores only at the edges of words."""
    m, edge = re.escape(mark), (r"(?<![^\W_])", r"(?![^\W_])") if mark[0] == "_" else ("", "")
    return f"{edge[0]}{m}(?!\\s|{m})(?:(?!{m}).)++(?<!\\s){m}{edge[1]}"


_SPANS = re.compile(r"(?P<code>(?P<tick>`+)(?P<inner>\S(?:.*?\S)?)(?P=tick))|(?P<link>!?\[)(?P<label>[^\]]*)\]\((?P<url>[^)\s]*)(?P<rest>(?:\s+\"[^\"]*\")?\))|(?P<auto><(?:https?://|mailto:)[^>\s]+>)|(?P<em>" + "|".join(map(_nearest, _EMPHASIS)) + r")|(?P<esc>\\.)", re.S)


def _span(cls: str, text: str) -> str:
    return f'<span class="{cls}">{_safe(text)}</span>' if cls and text else _safe(text)


def _coloured(text: str) -> str:
    out, at = [], 0
    for m in _SPANS.finditer(text):
        out.append(_safe(text[at : m.start()]))
        at = m.end()
        if m["code"]:
            out += [_span("md-tick", m["tick"]), _span("md-ic", m["inner"]), _safe(m["tick"])]
        elif m["link"]:
            out += [_span("md-link", m["link"]), _span("md-link", m["label"]), _span("md-url", "]("), _span("md-url", m["url"]), _safe(m["rest"])]
        elif m["em"]:
            mark = next(k for k in _EMPHASIS if re.fullmatch(_nearest(k), m["em"], re.S))
            inner, cls = m["em"][len(mark) : -len(mark)], _EMPHASIS[mark]
            out += [_span(f"{cls} md-delim", mark), _span(cls, inner), _span(f"{cls} md-delim", mark)]
        else:
            out.append(_span("md-esc" if m["esc"] else "", m[0]))
    return "".join(out) + _safe(text[at:])


def coloured_source(md: str | None) -> str:
    """md escaped, with spans that name its marks; without its tags it is the escaped text, to the last white space."""
    out, fenced = [], False
    for line in (md or "").split("\n"):
        kind, m = next(((k, found) for k, r in _LINES if (found := r.match(line))), ("text", None)) if line.strip() else ("blank", None)
        if fenced or kind == "fence":
            out.append(_span("md-fence" if kind == "fence" else "md-code", line))
            fenced ^= kind == "fence"
        elif kind in ("text", "blank"):
            out.append(_coloured(line))
        elif kind == "hr":
            out.append(_span("md-hr", line))
        elif kind == "table":
            out.append(f'<span class="md-tbl">{_coloured(line)}</span>')
        else:
            level = f"md-h{len(m[1])}" if kind == "heading" else ""
            before = {"heading": level, "list": "md-list md-task-box" if kind == "list" and m[1] else "md-list", "quote": "md-quote"}[kind]
            around = {"heading": f"{level} md-hc", "list": "", "quote": "md-quote-c"}[kind]
            inner = _coloured(line[m.end() :])
            out.append(_span(before, m[0]) + (f'<span class="{around}">{inner}</span>' if around else inner))
    return "\n".join(out)


@in_bounded_batches
@F.pandas_udf(StringType())
def highlight_md(md: pd.Series) -> pd.Series:
    return md.map(coloured_source)


def strip_tags(c: Column) -> Column:
    """Without tags; entities stay."""
    return F.regexp_replace(c, "<[^>]*>", "")


# ---- code in notes

_MADE = StructType([StructField("html", StringType()), StructField("n", IntegerType())])
_STYLE = "margin:0;overflow-x:auto;white-space:pre;"


def materialize_code(html: Column, mirror: str) -> Column:
    """Struct of html, in which each hidden code area without a rendered mirror has become a pre, and n, how many.

    mirror: the tag in which the editor leaves rendered lines after a code area.
    """

    def make(text: str | None) -> dict:
        blocks = [b for b in find_blocks(text or "", mirror) if not b["rendered"]]
        for b in reversed(blocks):
            cls = f' class="language-{_safe(b["mode"].lower()).replace(chr(34), "&quot;")}"' if b["mode"] else ""
            shown = f'<pre style="{_STYLE}"><code{cls}>{_safe(b["source"]).replace(chr(34), "&quot;")}</code></pre>'
            text = text[: b["start"]] + shown + text[b["end"] :]
        return {"html": text or "", "n": len(blocks)}

    @in_bounded_batches
    @F.pandas_udf(_MADE)
    def made(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(column.map(make)), columns=["html", "n"])

    return made(html)


def _folded(c: Column) -> Column:
    """Each line's white space folded to one space, none at its ends; zero-width spaces gone."""
    return F.array_join(F.transform(F.split(F.replace(c, F.lit("\u200b"), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\u00a0]+", " "))), "\n")


def compare_rendered(source: Column, rendered: Column) -> Column:
    """same (tabs as four spaces), width (only the width of white space differs) or diff; line feeds at the end don't count."""
    a, b = (F.regexp_replace(x, r"\n+\z", "") for x in (source, rendered))
    return F.when(normalize_code(a) == normalize_code(b), "same").when(_folded(a) == _folded(b), "width").otherwise("diff")


def attachments_block(items: Column, heading: str, absent: str) -> Column:
    """A closing block that lists attachments.  items: array of structs name, href, size; absent is said where href is empty."""

    def row(x: Column) -> Column:
        size = F.when(x["size"] > 0, F.concat(F.lit(' <span style="color:#999;">（'), human_size(x["size"]), F.lit("）</span>"))).otherwise("")
        shown = F.concat(F.lit("📎 "), html_escape(x["name"]), size)
        link = F.concat(F.lit('<li><a href="'), html_escape(x["href"]), F.lit('" style="color:#2b6cb0;">'), shown, F.lit("</a></li>"))
        return F.when(F.coalesce(x["href"], F.lit("")) == "", F.concat(F.lit('<li><span style="color:#999;">'), shown, F.lit(f"（{absent}）</span></li>"))).otherwise(link)

    # The block's markup, with its styles inside, so that it needs no other file.
    head = f'<div style="border-top:1px solid #ddd;margin-top:2em;padding-top:1em;font-family:sans-serif;">\n<h3 style="font-size:14px;color:#666;margin:0 0 .5em;">{heading}（'
    return F.concat(F.lit(head), F.size(items).cast("string"), F.lit('）</h3>\n<ul style="list-style:none;padding:0;margin:0;font-size:13px;">'), F.array_join(F.transform(items, row), ""), F.lit("</ul>\n</div>"))
