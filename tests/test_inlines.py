"""Emphasis, links, references and code in paragraphs, by the standard's own rules (examples written anew)."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.functions import render


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ("*red **blue** red*", "<em>red <strong>blue</strong> red</em>"),
        ("***both** one*", "<em><strong>both</strong> one</em>"),
        ("**two*one**", "<strong>two*one</strong>"),
        ("*one**two*", "<em>one**two</em>"),
        ("in*side*word and in_side_word", "in<em>side</em>word and in_side_word"),
        ('a*"quoted"*', 'a*"quoted"*'),
        ("(*a*), _(b)_.", "(<em>a</em>), <em>(b)</em>."),
        ("* not, ** not **", None),
        ("__a__b and __c__", "__a__b and <strong>c</strong>"),
        ("*a `*` b*", "<em>a <code>*</code> b</em>"),
        ("*overlap __here* and__ there", "<em>overlap __here</em> and__ there"),
        ("*" * 60 + "x" + "*" * 60, "<strong>" * 30 + "x" + "</strong>" * 30),
        ("~~gone *all*~~ ~one~ ~~~three~~~", "<del>gone <em>all</em></del> ~one~ ~~~three~~~"),
        ("`` a ` b `` ``` c `` ` d `", "<code>a ` b</code> ``` c `` <code>d</code>"),
        ("[to *x* `]`](/u 'T\\'s')", '<a href="/u" title="T\'s">to <em>x</em> <code>]</code></a>'),
        ("[no [inner](/i) link](/o)", '[no <a href="/i">inner</a> link](/o)'),
        ("[a *b](/u) c*", '<a href="/u">a *b</a> c*'),
        ('![is *one* [two](x)](p.png "t")', '<img src="p.png" alt="is one two" title="t" />'),
        ("[a](<x y>) [b](/p(q)r) [c]( ) [d](/x\\)y)", '<a href="x%20y">a</a> <a href="/p(q)r">b</a> <a href="">c</a> <a href="/x)y">d</a>'),
        ("[a](/é?b=1&c='2')", '<a href="/%C3%A9?b=1&amp;c=&#x27;2&#x27;">a</a>'),
        ("[a](/x y) [b] (c)", "[a](/x y) [b] (c)"),
        ("<mailto:a@b> <a.b@c.de> <b>bold</b> <!-- x --> <1", '<a href="mailto:a@b">mailto:a@b</a> <a href="mailto:a.b@c.de">a.b@c.de</a> <b>bold</b> <!-- x --> &lt;1'),
        ("\\*a\\* \\a &copy; &nosuch; &#65;", "*a* \\a © &amp;nosuch; A"),
        ("a  \nb\\\nc\nd", "a<br />\nb<br />\nc\nd"),
    ],
)
def test_marks(md, want):
    assert render.to_html(md) == (f"<p>{want}</p>\n" if want is not None else "<ul>\n<li>not, ** not **</li>\n</ul>\n")


@pytest.mark.parametrize(
    ("md", "want"),
    [
        ('[Foo  Bar]: /u "T"\n\n[foo bar] [x][FOO BAR] [foo bar][]', '<p><a href="/u" title="T">foo bar</a> <a href="/u" title="T">x</a> <a href="/u" title="T">foo bar</a></p>\n'),
        ("[a][b] [b]\n\n[b]: <my url>\n[b]: /second\n", '<p><a href="my%20url">a</a> <a href="my%20url">b</a></p>\n'),
        ("[a]: /u\n'title over\ntwo lines'\ntext [a]", '<p>text <a href="/u" title="title over\ntwo lines">a</a></p>\n'),
        ('[a]: /u "title" no\n\n[a]', '<p>[a]: /u &quot;title&quot; no</p>\n<p>[a]</p>\n'.replace("&quot;", '"')),
        ("> [q]: /in\n\n[q] ![q]", '<blockquote>\n</blockquote>\n<p><a href="/in">q</a> <img src="/in" alt="q" /></p>\n'),
        ("[a]: /u\n===\n[a]", '<p>===\n<a href="/u">a</a></p>\n'),
        ("```\n[c]: /code\n```\n[c]", "<pre><code>[c]: /code\n</code></pre>\n<p>[c]</p>\n"),
        ("[a][none][b]\n\n[b]: /b", '<p>[a]<a href="/b">none</a></p>\n'),
    ],
)
def test_references(md, want):
    assert render.to_html(md) == want


def test_references_end_with_their_text():
    assert "<a" in render.to_html("[a]: /u\n\n[a]") and "<a" not in render.to_html("[a]")


@pytest.mark.parametrize("piece", ["*a ", "**a ", "a** b* ", "*a_ ", "[a ", "[a](", "[a][", "]", "![", "`a ", "``a` ", "_a_ ", "~~", "<a ", "<!-- ", "&a", "\\", "[a]: ", "*a**b_c", "(*", "> "])
def test_time_grows_with_the_text(piece):
    """What goes on without an end is read in time that grows in proportion."""
    began = time.process_time()
    render.to_html(piece * 20_000)
    assert time.process_time() - began < 4


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab *_~`[]()<>!\\&;\n\"':/.é", max_size=60))
def test_no_text_is_lost(md):
    import re
    from html import unescape

    letters = lambda s: re.sub(r"[^abé]", "", s)
    if not re.search(r"[\[<&]", md):
        assert letters(unescape(re.sub("<[^>]*>", "", render.to_html(md)))) == letters(md)
    else:
        render.to_html(md)
