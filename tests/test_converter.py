"""What the converter leaves out, code tables by class and by content, cells and merged cells, indents."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import markdown


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<pre><code>a = 1</code><div class="btn-copy">Copy</div></pre>', "```\na = 1\n```"),
        *[(f'<pre>x<span class="Big-{c.upper()}-small">no<b>o</b></span>y</pre>', "```\nxy\n```") for c in markdown.CHROME],
        ("<pre>x<button>Copy<i>!</i></button>y</pre>", "```\nxy\n```"),
        ('<pre>a<div class="toolbar">b</div><p class="line-numbers">c</p></pre>', "```\nabc\n```"),
        *[(f"a<{t}>gone</{t}>b", "ab") for t in markdown.IGNORED],
        *[(f"a<{t}>b", "ab") for t in markdown.IGNORED_VOID],
        ("<head><title>t</title>never closed<body>text", "text"),
        ("<head><meta><link></head>text", "text"),
        *[(f'<table class="hljs-ln"><tr><td class="x-{g.upper()}-y">7 x</td><td>a</td></tr><tr><td class="{g}">8</td><td></td></tr><tr><td class="{g}">9</td><td>b</td></tr></table>', "```\na\n\nb\n```") for g in markdown.GUTTER],
        ('<table class="lntable"><tr><td>1\n2</td><td>a\n\nb  </td></tr><tr><td></td><td>c</td></tr></table>', "```\na\n\nb\nc\n```"),
        ("<table><tr><td>a<br><br>b<div>c</div></td><td> | </td></tr></table>", "| a<br>b<br>c | \\| |\n| --- | --- |"),
        ('<table><tr><td colspan="2">a</td></tr><tr><td>b</td><td>c</td></tr><tr><td></td></tr></table>', "a\nb | c"),
        ('<table><tr><td colspan="1">a</td></tr></table>', "| a |\n| --- |"),
        ("<table><tr><td>x<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>y</td></tr></table>", "| x<br>a<br>b<br>cy |\n| --- |"),
    ],
)
def test_converted(html, want):
    assert markdown.convert(html).strip() == want


def test_references_without_semicolon(spark):
    """A title cut behind &amp: the converter reads it as browsers do, the query as its SQL, whole references stay."""
    html = '<h1>a &amp;&amp</h1><p>&lt; &#65; &#x42; &amp;lt; &ampx &quot "&1;" &;</p><a href="/x?a=1&b=2&amp;c=3">l</a>'
    plain, closed = (spark.createDataFrame([(html,), (None,)], "html string").select(markdown.html_to_md(c)).collect() for c in (F.col("html"), markdown.references_closed(F.col("html"))))
    assert plain[0][0].split("\n")[0] == "# a &&" and closed[0][0].split("\n") == ["# a &&amp", "", '< A B &lt; &ampx &quot "&1;" &;', "", "[l](/x?a=1&b=2&c=3)"]
    assert plain[1][0] == closed[1][0] == ""


@pytest.mark.parametrize(
    ("line", "kept"),
    [("-", True), ("- x", True), ("-\tx", True), ("+", True), ("*a", False), ("-x", False), ("1. x", True), ("12) x", True), ("1.x", False), ("> x", True), ("|x", True), ("```", True), ("``", False), ("~~~", False), ("# x", True), ("######## x", True), ("#x", False), ("word", False)],
)
def test_indents_stay_before_blocks_only(line, kept):
    for indent in ("    ", "\t", "  \t  "):
        assert markdown.dedent_layout(f"a\n{indent}{line}\n") == f"a\n{indent if kept else ''}{line}\n"
    assert markdown.dedent_layout(f"   {line}") == f"   {line}"
