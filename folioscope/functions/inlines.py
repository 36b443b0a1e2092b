"""Marks within a paragraph of Markdown: one pass with a stack of delimiter runs and a stack of brackets, as the standard describes them.

A run of * or _ is remembered with its length and whether it can open or close; a closer takes the nearest opener that fits, and what
lies between them and was left open stays text.  A bracket that closes becomes a link or an image if an address follows it or
its label has one in the table of references.  Nothing is nested by recursion, so depth has no limit, and what has been looked
for in vain is not looked for again.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
import urllib.parse

_SPECIAL = re.compile(r"[\\`*_~\[\]!<&\n]")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_MAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
_TAG = re.compile(r"</?[A-Za-z][\w-]*(?:\s[^<>]*)?/?>|<\?[^<>]*\?>|<![A-Z][^<>]*>")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_TITLE = re.compile(r"\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\))", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S)
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*", re.S)
_MARKS = {("*", 1): "em", ("_", 1): "em", ("*", 2): "strong", ("_", 2): "strong", ("~", 2): "del"}

#: Parentheses within parentheses of an address, as the standard's own programs allow.
PARENTHESES = 32

References = dict[str, tuple[str, str | None]]


def safe(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def plain(text: str) -> str:
    """An address or a title without escapes and entities."""
    return entities.unescape(_ESCAPED.sub(r"\1", text)) if "\\" in text or "&" in text else text


def quoted(text: str) -> str:
    return safe(text).replace('"', "&quot;")


def href(url: str) -> str:
    return safe(urllib.parse.quote(plain(url), safe="!#$%&'()*+,-./:;=?@_~")).replace("'", "&#x27;")


def folded(label: str) -> str:
    """A label as references are looked up: white space runs are one space, case doesn't count."""
    return " ".join(label.split()).casefold()


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """The address at a place and where it ends: in angle brackets, or with balanced parentheses up to white space."""
    if text[at : at + 1] == "<":
        m = re.compile(r"<((?:[^<>\\\n]|\\.)*)>").match(text, at)
        return (m[1], m.end()) if m else None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c <= " " or c == "\x7f":
            break
        if c == "\\" and i + 1 < len(text) and not text[i + 1].isspace():
            i += 2
            continue
        if c == "(":
            depth += 1
            if depth > PARENTHESES:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        i += 1
    return None if depth else (text[at:i], i)


def _title(text: str, at: int) -> tuple[str | None, int]:
    m = _TITLE.match(text, at)
    return (next(g for g in m.groups() if g is not None), m.end()) if m else (None, at)


def _address(text: str, at: int) -> tuple[str, str | None, int] | None:
    """(url, title, end) of ( ... ) at a place."""
    if text[at : at + 1] != "(":
        return None
    i = at + 1 + len(text[at + 1 :]) - len(text[at + 1 :].lstrip(" \t\n")) if text[at + 1 : at + 2] in (" ", "\t", "\n") else at + 1
    found = _destination(text, i)
    if found is None:
        return None
    url, i = found
    title, i = _title(text, i)
    while text[i : i + 1] in (" ", "\t", "\n"):
        i += 1
    return (url, title, i + 1) if text[i : i + 1] == ")" else None


def definitions(text: str, into: References) -> str:
    """What is left of a paragraph when the definitions of references at its beginning have gone into the table; the first of a label counts."""
    while m := _DEFINITION.match(text):
        found = _destination(text, m.end())
        if found is None or not folded(m[1]) or (not found[0] and text[m.end() : m.end() + 1] != "<"):
            break
        url, end = found
        title, after = _title(text, end)
        rest = re.compile(r"[ \t]*(?:\n|$)").match(text, after)
        if title is not None and not rest:  # what looks like a title is text of its own line, if it begins one
            title, rest = None, re.compile(r"[ \t]*(?:\n|$)").match(text, end)
        if not rest:
            break
        into.setdefault(folded(m[1]), (url, title))
        text = text[rest.end() :]
    return text


class _Run:
    """A run of one delimiter: characters left, the length it had, and the tags that go before and after what is left."""

    __slots__ = ("after", "at", "before", "char", "closes", "length", "left", "opens")

    def __init__(self, char: str, length: int, opens: bool, closes: bool, at: int):
        self.char, self.left, self.length, self.opens, self.closes, self.at = char, length, length, opens, closes, at
        self.before: list[str] = []
        self.after: list[str] = []


def _kind(c: str) -> int:
    """0: white space or an edge, 1: punctuation or a symbol, 2: anything else."""
    if not c or c.isspace():
        return 0
    if c.isascii():
        return 2 if c.isalnum() else 1
    return 1 if unicodedata.category(c)[0] in "PS" else 2


class _Reader:
    def __init__(self, text: str, references: References):
        self.text, self.references = text, references
        self.out: list[str] = []  # HTML
        self.bare: list[str] = []  # the same as text, for what an image says
        self.runs: list[_Run] = []
        self.brackets: list[list] = []  # place in out, image, may become a link, runs before it, place in the text
        self.ticks: dict[int, list[int]] | None = None
        self.comments = True

    def add(self, shown: str, bare: str) -> None:
        self.out.append(shown)
        self.bare.append(bare)

    def read(self) -> str:
        text, at, n = self.text, 0, len(self.text)
        while at < n:
            m = _SPECIAL.search(text, at)
            if not m:
                self.add(safe(text[at:]), text[at:])
                break
            if m.start() > at:
                piece = text[at : m.start()]
                if m[0] == "\n":
                    piece = piece.rstrip(" ") or ""
                self.add(safe(piece), piece)
            at = self.mark(m[0], m.start(), at)
        self.emphasis(0)
        return self.joined(0)

    def joined(self, begin: int) -> str:
        return "".join(self.out[begin:])

    def mark(self, c: str, at: int, before: int) -> int:
        """Read the mark at a place; where to go on.  before: where the text before it began."""
        text = self.text
        if c == "\n":
            hard = text[max(before, at - 2) : at] == "  "
            self.add("<br />\n" if hard else "\n", "\n")
            return at + 1
        if c == "\\":
            following = text[at + 1 : at + 2]
            if following == "\n":
                self.add("<br />\n", "\n")
                return at + 2
            if following and following.isascii() and not following.isalnum() and following > " " and following != "\x7f":
                self.add(safe(following), following)
                return at + 2
        elif c == "`":
            return self.code(at)
        elif c == "<":
            for form, prefix in ((_AUTO, ""), (_MAIL, "mailto:")):
                if m := form.match(text, at):
                    self.add(f'<a href="{href(prefix + m[1])}">{safe(m[1])}</a>', m[1])
                    return m.end()
            if text.startswith("<!--", at) and self.comments:
                end = text.find("-->", at + 4)
                self.comments = end >= 0
                if end >= 0:
                    self.add(text[at : end + 3], "")
                    return end + 3
            if m := _TAG.match(text, at):
                self.add(m[0], "")
                return m.end()
        elif c == "&":
            if m := _ENTITY.match(text, at):
                shown = entities.unescape(m[0])
                self.add(safe(shown), shown)
                return m.end()
        elif c in "*_~":
            end = at + 1
            while text[end : end + 1] == c:
                end += 1
            left, right = _kind(text[at - 1] if at else ""), _kind(text[end : end + 1])
            opens, closes = bool(right) and (right == 2 or left < 2), bool(left) and (left == 2 or right < 2)
            if c == "_":
                opens, closes = opens and (not closes or left == 1), closes and (not opens or right == 1)
            if (opens or closes) and (c != "~" or end - at == 2):
                self.runs.append(_Run(c, end - at, opens, closes, len(self.out)))
            self.add(text[at:end], text[at:end])
            return end
        elif c == "[" or (c == "!" and text[at + 1 : at + 2] == "["):
            end = at + len(c) + (c == "!")
            self.brackets.append([len(self.out), c == "!", True, len(self.runs), end])
            self.add(text[at:end], text[at:end])
            return end
        elif c == "]":
            return self.close(at)
        self.add(safe(c), c)
        return at + 1

    def code(self, at: int) -> int:
        text = self.text
        if self.ticks is None:
            self.ticks = {}
            for m in re.finditer("`+", text):
                self.ticks.setdefault(len(m[0]), []).append(m.start())
            for places in self.ticks.values():
                places.reverse()
        end = at
        while text[end : end + 1] == "`":
            end += 1
        size = end - at
        places = self.ticks.get(size, [])
        while places and places[-1] < end:
            places.pop()
        if not places:
            self.add(text[at:end], text[at:end])
            return end
        inner = text[end : places[-1]].replace("\n", " ")
        if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip(" "):
            inner = inner[1:-1]
        self.add(f"<code>{safe(inner)}</code>", inner)
        return places[-1] + size

    def close(self, at: int) -> int:
        text = self.text
        found = None
        if self.brackets:
            place, image, live, runs, begin = self.brackets.pop()
            if live or image:
                found = _address(text, at + 1)
                if found is None:
                    label, end = text[begin:at], at + 1
                    if (m := _LABEL.match(text, at + 1)) is not None:
                        label, end = m[1] if m[1].strip() else label, m.end()
                    known = self.references.get(folded(label)) if self.references and len(label) < 1000 else None
                    if known is None and end > at + 1 and self.references:  # a bracket of its own follows
                        known, end = self.references.get(folded(text[begin:at])) if not m[1].strip() else None, at + 1 if m[1].strip() else end
                    found = (*known, end) if known else None
        if found is None:
            self.add("]", "]")
            return at + 1
        url, title, end = found
        self.emphasis(runs)
        told = f' title="{quoted(plain(title))}"' if title else ""
        if image:
            shown = "".join(self.bare[place + 1 :])
            del self.out[place:], self.bare[place:]
            self.add(f'<img src="{href(url)}" alt="{quoted(shown)}"{told} />', shown)
        else:
            self.out[place], self.bare[place] = f'<a href="{href(url)}"{told}>', ""
            self.add("</a>", "")
            for other in reversed(self.brackets):  # a link holds no link
                if not other[1]:
                    if not other[2]:
                        break
                    other[2] = False
        return end

    def emphasis(self, begin: int) -> None:
        """Match the runs from a place on and write their tags."""
        stack: list[_Run] = []
        floor: dict[tuple, int] = {}
        for run in self.runs[begin:]:
            while run.closes and run.left:
                key = (run.char, run.opens, run.length % 3)
                i, low = len(stack) - 1, min(floor.get(key, 0), len(stack))
                while i >= low and not self.fits(stack[i], run):
                    i -= 1
                if i < low:
                    floor[key] = len(stack)
                    break
                opener = stack[i]
                del stack[i + 1 :]
                size = 2 if min(opener.left, run.left) >= 2 else 1
                tag = _MARKS[run.char, size]
                opener.left -= size
                run.left -= size
                opener.after.insert(0, f"<{tag}>")
                run.before.append(f"</{tag}>")
                if not opener.left:
                    stack.pop()
            if run.opens and run.left:
                stack.append(run)
        for run in self.runs[begin:]:
            if run.at < len(self.out):
                self.out[run.at] = "".join(run.before) + run.char * run.left + "".join(run.after)
                self.bare[run.at] = run.char * run.left
        del self.runs[begin:]

    @staticmethod
    def fits(opener: _Run, closer: _Run) -> bool:
        if opener.char != closer.char:
            return False
        if closer.char == "~":
            return opener.left == closer.left == 2
        return not ((opener.closes or closer.opens) and (opener.length + closer.length) % 3 == 0 and (opener.length % 3 or closer.length % 3))


def inline(text: str, references: References) -> str:
    """HTML of the text of a paragraph, a heading or a cell."""
    return _Reader(text, references).read() if _SPECIAL.search(text) else safe(text)
