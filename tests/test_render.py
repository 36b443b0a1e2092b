"""Rendering, colouring, hidden code, names and keys, audits."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import keys, markdown, render
from folioscope.operators import audit


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("# T *x* #", "<h1>T <em>x</em></h1>\n"),
        ("T\n===\nU\n---", "<h1>T</h1>\n<h2>U</h2>\n"),
        ("a **b** ~~c~~ `d<e` \\*f\\*", "<p>a <strong>b</strong> <del>c</del> <code>d&lt;e</code> *f*</p>\n"),
        ("a\nb  \nc", "<p>a\nb<br />\nc</p>\n"),
        ("***a*** snake_case_x", "<p><em><strong>a</strong></em> snake_case_x</p>\n"),
        ('[a](u "t") ![i](v) <https://x.y>', '<p><a href="u" title="t">a</a> <img src="v" alt="i" /> <a href="https://x.y">https://x.y</a></p>\n'),
        ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n"),
        ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"),
        ("3. a\n   - b", '<ol start="3">\n<li>a\n<ul>\n<li>b</li>\n</ul>\n</li>\n</ol>\n'),
        ("- [x] a", '<ul>\n<li><input disabled="" type="checkbox" checked=""/>\na</li>\n</ul>\n'),
        ("> a\nb\n\nc", "<blockquote>\n<p>a\nb</p>\n</blockquote>\n<p>c</p>\n"),
        ("```py\n<x>\n```\n***\n    y", '<pre><code class="language-py">&lt;x&gt;\n</code></pre>\n<hr />\n<pre><code>y\n</code></pre>\n'),
        ("|a|b|\n|-|:-:|\n|1|\\||", '<table><thead><tr><th>a</th><th style="text-align: center">b</th></tr></thead><tbody>\n<tr><td>1</td><td style="text-align: center">|</td></tr>\n</tbody></table>\n'),
        ("<div>\n*x*\n</div>", "<div>\n*x*\n</div>\n"),
        ("&amp; &lt; a & b", "<p>&amp; &lt; a &amp; b</p>\n"),
        (None, ""),
        ("\n \n", ""),
    ],
)
def test_md_to_html(md, want):
    assert render.to_html(md) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1_*~`[]()<>!|#-+> \t\n\\.:\"=", max_size=80))
def test_any_source(md):
    import re

    escaped = md.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    assert re.sub("<[^>]*>", "", render.coloured_source(md)) == escaped
    render.to_html(md)


def test_long_sources():
    for piece in ("*a ", "**a ", "[a ", "`a ", "_a_ ", "> ", "- a\n", "~~", "<a ", "| a |\n"):
        assert render.to_html(piece * 20_000)
        assert render.coloured_source(piece * 5_000)


HIDDEN = '<p data-mode="Py"></p><textarea style="display: none">a &lt; b</textarea>'


def test_hidden_code(spark):
    shown = '<cm><pre class=" CodeMirror-line ">a <b>x</b></pre></cm>'
    measured = '<cm><pre class="CodeMirror-line-like">xxx</pre></cm>'
    assert [b["rendered"] for b in markdown.find_blocks(HIDDEN + " " + shown + HIDDEN + measured + HIDDEN, "cm")] == [True, False, False]
    assert [b["mode"] for b in markdown.find_blocks(HIDDEN + "<i data-mode=''></i>" + HIDDEN[HIDDEN.index("<textarea") :])] == ["Py", ""]
    df = spark.createDataFrame([(HIDDEN + shown,), (HIDDEN + "y",), (None,)], "h string")
    got = [r[0] for r in df.select(render.materialize_code(F.col("h"), "cm").alias("x")).collect()]
    assert [r["n"] for r in got] == [0, 1, 0] and got[2]["html"] == ""
    assert got[1]["html"] == '<p data-mode="Py"></p><pre style="margin:0;overflow-x:auto;white-space:pre;"><code class="language-py">a &lt; b</code></pre>y'


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (keys.url_encode_path, "/a b/ü~*.x", "/a%20b/%C3%BC%7E%2A.x"),
        (keys.path_hash, "", "84222325"),
        (keys.path_hash, "a", "8601ec8c"),
        (lambda c: keys.entry_stem(c, F.lit("none")), "x/ a(b).tar.gz", "_a_b_.tar"),
        (lambda c: keys.entry_stem(c, F.lit("none")), "  .png", "none"),
        (keys.entry_extension, "a.P-N G!", "png"),
        (keys.entry_extension, "a", "bin"),
        (lambda c: keys.attachment_key("p/", c), "p/x", "p/x"),
        (lambda c: keys.attachment_key("p/", c), "x", "p/x"),
        (lambda c: keys.conflict_place(c, F.lit(3)), "{g}", "_conflicts/g_3.zip"),
        (keys.valid_content_md5, "zz", None),
        (keys.error_code, "PATH_UNSAFE: no", "PATH_UNSAFE"),
        (lambda c: keys.as_data_uri(F.lit("a.css"), c.cast("binary")), "hi", "data:text/css;base64,aGk="),
        (lambda c: keys.data_uri_bytes(c).cast("string"), "data:image/png;base64,aGk=", "hi"),
        (lambda c: keys.reference(F.lit("e"), c, True, False), '[]"', "[attachment](e)"),
        (lambda c: keys.reference(F.lit("e"), c, False, True), "n", '<img src="e" alt="n">'),
    ],
)
def test_keys(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "c string").select(f(F.col("c")).alias("x")).first()[0] == want


def test_attachments_block(spark):
    df = spark.sql("select array(named_struct('name', 'a<b', 'href', 'u', 'size', 2048L), named_struct('name', 'c', 'href', '', 'size', 0L)) items")
    got = df.select(render.attachments_block(F.col("items"), "Files", "absent")).first()[0]
    assert "Files（2）" in got and '<a href="u" style="color:#2b6cb0;">📎 a&lt;b' in got and "（2.0 KB）" in got and "📎 c（absent）" in got


def test_audits(spark):
    notes = spark.createDataFrame([("a", "```\nx\n```\n\n    tab"), ("b", "```\nx\n```"), ("c", "")], "guid string, body string")
    assert [tuple(r) for r in audit.worst_rendered(notes).collect()] == [("a", 1, 2, 1)]
    bodies = spark.createDataFrame([(1, "index_files/a.png index_files/d/b.png index_files/a.png"), (2, None)], "key int, html string")
    entries = spark.createDataFrame([(1, "b.png"), (1, "b.png"), (2, "a.png")], "key int, name string")
    assert [tuple(r) for r in audit.missing_refs(bodies, entries).collect()] == [(1, "index_files/a.png".split("/")[1])]
    none = audit.conversion_stats(spark.createDataFrame([], "key int, html string")).first()
    assert tuple(none) == (0,) * 8
    made = audit.conversion_stats(spark.createDataFrame([(1, "<pre>x</pre><table><tr><td>a</td><td>b</td></tr></table>"), (2, None)], "key int, html string")).first()
    assert made.asDict() == {"documents": 2, "code_blocks": 1, "code_tables": 0, "mirrors": 0, "tables": 1, "layout_tables": 0, "dropped_data_imgs": 0, "empty": 1}


def test_trash_files(spark):
    disk = spark.createDataFrame([("t/1/x.zip",), ("t/2/x_3.zip",), ("t/1/y_a_b.zip",)], "path string")
    tombs = spark.createDataFrame([("x", "/n/x.zip", None), ("e", "/n/x.zip", "t/1/x.zip"), ("y", "/n/y.zip", "gone"), ("ya", "/n/y_a.zip", None), ("z", "/z.zip", None), ("n", None, None)], "guid string, last_path string, trash_path string")
    got = dict(tuple(r) for r in audit.trash_files(tombs, disk).collect())
    assert got == {"x": "t/2/x_3.zip", "e": "t/1/x.zip", "y": "t/1/y_a_b.zip", "ya": "t/1/y_a_b.zip", "z": None, "n": None}


def test_whole_texts_come_in_bounded_batches(spark, monkeypatch):
    """However many texts a task has, Python holds a batch of few bytes of them."""
    from folioscope.sources import store

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    texts = spark.createDataFrame([(f"# t\n\n{'x' * 50_000}",)] * 40, "t string").coalesce(1)
    try:
        for made in (render.md_to_html, render.highlight_md, markdown.html_to_md, markdown.html_to_md_with_stats, markdown.code_blocks, lambda c: render.materialize_code(c, "m")):
            spark.conf.set(key, str(64 << 20))
            texts.select(made(F.col("t")))
            assert int(spark.conf.get(key)) == store.BATCH_BYTES
        spark.conf.set(key, str(1 << 18))
        assert texts.agg(F.sum(F.length(render.md_to_html(F.col("t"))))).first()[0] == 40 * (50_000 + len("<h1>t</h1>\n<p></p>\n"))
        assert int(spark.conf.get(key)) == 1 << 18
    finally:
        spark.conf.set(key, before)


def test_render_counts_in_bounded_batches(spark):
    from folioscope.sources import store

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(64 << 20))
        rows = audit.worst_rendered(spark.createDataFrame([("a", "```\nx\n```\n\nw\n\n    y"), ("b", "z")], "guid string, body string"))
        assert int(spark.conf.get(key)) == store.BATCH_BYTES
        assert [tuple(r) for r in rows.collect()] == [("a", 1, 2, 1)]
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # bodies are rendered once
    finally:
        spark.conf.set(key, before)
