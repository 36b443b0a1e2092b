import pytest
from pyspark.sql import functions as F

from folioscope.functions import markdown, text
from folioscope.operators import library, search, writes
from folioscope.sources import packages
from folioscope.sources.views import conform
from folioscope.streaming import fold


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'binary' if isinstance(v, bytes) else 'string' if isinstance(v, str) else 'long'}" for i, v in enumerate(values)))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.decode_entities, "a &amp;lt; b &lt;&#65;&#x42;&nbsp;&copy; &#xD800;&#x1F600;", "a &lt; b <AB &copy; 😀"),
        (text.extract_text, "<style>x</style><p>One&nbsp; two</p><script>y</script>three<br>four<!-- c -->", "One two\n three\nfour"),
        (text.html_escape, '<a href="x">&</a>', "&lt;a href=&quot;x&quot;&gt;&amp;&lt;/a&gt;"),
        (text.sanitize_title, " a/b:c*? ..", "a_b_c__ "),
        (text.sanitize_title, " ... ", "untitled"),
        (text.sanitize_location, "/a//b?/", "/a//b_/"),
        (text.normalize_location, " a / b", "/a/b/"),
        (text.normalize_location, "/a/../b", None),
        (text.normalize_guid, "{AB-12}", "ab-12"),
        (text.normalize_guid, "xyz", None),
        (text.normalize_code, "\ta​ b", "    a b"),
        (text.content_type, "x.PNG", "image/png"),
        (text.content_type, "x.unknown", "application/octet-stream"),
        (text.disk_path, "attachments/x", "_attachments/x"),
        (text.unsafe_path, "a/../b", True),
        (text.unsafe_path, "a..b/c", False),
        (text.reserved_path, "a/_b/c", True),
        (text.remote_url, "//host/x", True),
        (text.illegal_name, "a|b", True),
        (text.human_size, 1536, "1.5 KB"),
        (text.content_md5, "d41d8cd98f00b204e9800998ecf8427e", "1B2M2Y8AsgTpgAmY7PhCfg=="),
    ],
)
def test_text(spark, f, given, want):
    assert one(spark, f, given) == want


def test_more_text(spark):
    assert one(spark, text.ancestors, "/a/b/") == ["/a/", "/a/b/"] and one(spark, text.ancestors, "/") == []
    assert one(spark, text.resource_refs, 'x src="index_files/a.png" index_files/b.png\' index_files/a.png"') == ["a.png", "b.png"]
    assert one(spark, text.inject_before_body_end, "<b></BODY>x</body>y", "!") == "<b></BODY>x!\n</body>y"
    assert one(spark, text.inject_before_body_end, "none", "!") == "none\n!"
    assert one(spark, text.image_kind, b"\x89PNG\r\n\x1a\n0000") == "png" and one(spark, text.image_kind, b"<?xml?><svg/>") == "svg" and one(spark, text.image_kind, b"zzzz") is None
    check = lambda c: text.validate_html(c, "app://")
    assert one(spark, check, " ")["rejected"] == "empty" and one(spark, check, "<a href='app://x'>y</a>")["rejected"] == "host reference"
    assert tuple(one(spark, check, "<SCRIPT>a</script><script></script><img>")) == (None, 2, True)
    assert one(spark, text.canonical_role, "export") == "writer" and one(spark, text.canonical_role, "") == "" and one(spark, text.canonical_policy, " on_demand ") == "on_demand" and one(spark, text.canonical_policy, "x") == "full"
    assert one(spark, lambda c: search.occurrences(c, "ana"), "Banana") == 2
    assert one(spark, lambda c: search.highlight(c, "É"), "café") == "caf<mark>é</mark>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h2>T</h2><p>a <b>b</b> <i></i>c</p>", "## T\n\na **b** c"),
        ("<ul><li>a<li>b</li></ul>", "- a\n- b"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
        ("<table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2|3</td></tr></table>", "| x | y |\n| --- | --- |\n| 1 | 2\\|3 |"),
        ('<pre class="lang-py">a\n  b</pre>', "```py\na\n  b\n```"),
        ('<a href="u">t</a><img src="data:x"><img src="i.png" alt="p">', "[t](u)![p](i.png)"),
        ("<blockquote>q</blockquote><hr>", "> q\n\n---"),
        ("<script>x</script>a_b", "a\\_b"),
        ('<div data-mode="shell"><textarea style="display: none;">echo hi\nls -l</textarea><x_code_mirror><pre class="CodeMirror-line">echo hi</pre></x_code_mirror></div><p>z</p>', "```shell\necho hi\nls -l\n```\n\nz"),
        ('<div data-mode="js"><textarea style="display:none">   </textarea></div>', ""),
        ('<table class="lntable"><tr><td><pre><span>1\n</span><span>2\n</span></pre></td><td><pre>[m] = 0\ndone</pre></td></tr></table>', "```\n[m] = 0\ndone\n```"),
        ('<table class="hljs-ln"><tr><td class="hljs-ln-numbers"></td><td>one</td></tr><tr><td class="hljs-ln-numbers"></td><td></td></tr><tr><td class="hljs-ln-numbers"></td><td>two</td></tr></table>', "```\none\n\ntwo\n```"),
        ('<table class="diff-table"><tr><td class="blob-num"></td><td> kept</td></tr><tr><td class="blob-num"></td><td>-gone</td></tr></table>', "```diff\n kept\n-gone\n```"),
        ('<table class="d-block"><tr><td><p>c</p><ul><li>i</li></ul></td></tr></table><table><tr><td>a</td><td>b</td></tr></table>z', "c\n\n- i\n\n| a | b |\n| --- | --- |\n\nz"),
        ("<table><tr><td>V</td><td>B<table><tr><td>in</td></tr></table>tail</td></tr></table>", "| V | B<br>intail |\n| --- | --- |"),
        ('<table><tr><td colspan="2">both</td></tr><tr><td>a</td><td>b</td></tr></table>', "both\na | b"),
        ('<pre><code class="language-sh">one<ul class="pre-numbering"><li>1</li></ul><button>copy</button></code></pre>after', "```sh\none\n```\n\nafter"),
        ("<pre><ol><li>a</li><li>b</li></ol></pre>", "```\na\nb\n```"),
        ("<p>&lt;name&gt; a &lt; b</p><ul><li><input type=checkbox checked>do<li><input type=checkbox>not</ul>", "\\<name> a < b\n\n- [x] do\n- [ ] not"),
        ("<table><tr><td>k<br>m</td><td>n</td></tr></table>", "| k<br>m | n |\n| --- | --- |"),
        ("<head><title>t<body><p>x</p>", "x"),
        (None, ""),
    ],
)
def test_markdown(html, want):
    assert markdown.convert(html) == want


def test_markdown_layout_and_numbers():
    assert markdown.dedent_layout("        Home\n\tIssues\n    - keep\n   x\n    \nb") == "Home\nIssues\n    - keep\n   x\n\nb"
    assert [markdown.without_numbers(x) for x in ("a\n42", "a\n1\n2\n\n", "1\n2")] == ["a\n42", "a", ""]
    assert markdown.language_of("line-numbers language-python") == "python" and markdown.language_of("highlight-source-shell") == "shell" and markdown.language_of("editor-body") == ""
    _, stats = markdown.convert_with_stats('<table class="lntable"><tr><td>x</td></tr></table><img src="data:y"><table><tr><td>1</td><td>2</td></tr></table><pre>z</pre>')
    assert stats == {"code_blocks": 2, "code_tables": 1, "mirrors": 0, "tables": 1, "layout_tables": 0, "dropped_data_imgs": 1}


def test_code_blocks(spark):
    df = spark.createDataFrame([('<div data-mode="python"><textarea style="display: none">a &lt; b</textarea></div><textarea>shown</textarea>',)], "h string")
    got = df.select(markdown.code_blocks("h").alias("b")).first()["b"]
    assert [(b["mode"], b["source"]) for b in got] == [("python", "a < b")]


def test_packages(spark, tmp_path):
    first = packages.make_package({"index.html": b"\xef\xbb\xbf<p>x</p>", "index_files/a.png": b"1"})
    second = packages.make_package({"note.md": b"# m"}, base=first)
    (tmp_path / "{0a-1}").write_bytes(first)
    (tmp_path / "{0b-2}").write_bytes(second)
    (tmp_path / "{0c-3}").write_bytes(b"broken")
    (tmp_path / "other").write_bytes(first)
    got = {r["guid"]: r for r in packages.read_packages(spark, str(tmp_path)).collect()}
    assert set(got) == {"0a-1", "0b-2", "0c-3"} and got["0a-1"]["body"] == "<p>x</p>" and got["0b-2"]["format"] == "markdown"
    assert got["0c-3"]["format"] is None and got["0c-3"]["body"] == "" and "index_files/a.png" in got["0b-2"]["entries"]
    assert {r["guid"] for r in packages.list_packages(spark, str(tmp_path)).collect()} == set(got)
    with pytest.raises(KeyError):
        packages.make_package({"no": b""}, base=first, must_exist=True)


@pytest.mark.parametrize(("raw", "want"), [("a/./b", "a/b"), ("a/../b", None), ("/a", None), ("a%2Fb", "a/b"), ("%252e%252e/x", None), ("a\\b", None), ("c:x", None), ("", None)])
def test_entry_paths(raw, want):
    assert packages.sanitize_entry(raw) == want


def test_folder_positions(spark):
    meta = spark.createDataFrame([("SYNC_INFO", "FOLDERS_POS", '{"/a/": 3}'), ("x", "y", "z")], "group string, key string, value string")
    assert [tuple(r) for r in packages.folder_positions(meta).collect()] == [("/a/", 3)]
    with pytest.raises(Exception, match="(?i)malformed|parse|FAILFAST"):
        packages.folder_positions(spark.createDataFrame([("SYNC_INFO", "FOLDERS_POS", "{bad")], "group string, key string, value string")).collect()


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").cast("string").alias("guid"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("event"))
    events.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    fold.run(stream, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, fold.state(spark, str(tmp_path / "state")).collect())) == sorted(map(tuple, fold.fold(events).collect()))
    assert fold.latest_version(spark, str(tmp_path / "state")) == 2


def test_row_changes(spark):
    m = spark.createDataFrame([(g, g, f"/{g}", f"m{g}", "d", 1, 1, False, False) for g in "abcd"], writes.COLUMNS)
    gone = spark.createDataFrame([], "guid string, removed_at string, payload string, synced_revision long")
    ev = lambda *rows: spark.createDataFrame(list(rows), "guid string, kind string, title string, path string, md5 string, at string")
    m1, gone1 = writes.apply_events(m, gone, ev(("a", "save", None, None, "new", "t"), ("b", "rename", "B", "/B", None, "t"), ("c", "delete", None, None, None, "t"), ("e", "create", "E", "/e", "me", "t")))
    got = {r["guid"]: r for r in m1.collect()}
    assert set(got) == set("abde") and got["a"]["md5"] == "new" and got["a"]["dirty_data"] and got["a"]["revision"] == 2
    assert got["b"]["title"] == "B" and got["b"]["dirty_info"] and not got["b"]["dirty_data"] and got["e"]["dirty_info"] and not got["d"]["dirty_info"]
    m2, gone2 = writes.apply_events(m1, gone1, ev(("c", "restore", None, None, None, "u")))
    back = m2.where("guid = 'c'").first()
    assert back["data_modified"] == "d" and back["dirty_data"] and back["revision"] == 2 and gone2.isEmpty()


def names_in_order(rows):
    """One note after another, each asking what is taken already."""
    used, out = {}, []
    for guid, location, title in sorted(rows, key=lambda r: (r[2], r[0])):
        own, base = used.setdefault(location, set()), title
        candidates = [base, f"{base[:110]}_{guid.strip('{}')[:8]}", *[f"{base[:110]}_{i}" for i in range(2, 99)]]
        name = next(c for c in candidates if c not in own)
        own |= {name, name + ".zip"}
        out.append((guid, name))
    return dict(out)


def test_containment(spark):
    bodies = [("1", "see photo.png and my file name.txt"), ("2", "xphoto.pngx; a b"), ("3", "a  b"), ("4", ""), ("5", "the end of my file name.txtual")]
    names = ["photo.png", "a b", "b", "x", "my file name.txt", "of my", "file name.txt", "", " ", None, "zzz", "the"]
    n = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(names)], "file_path string, display_name string")
    got = sorted(tuple(r) for r in library.containment(n, spark.createDataFrame(bodies, "guid string, body string")).collect())
    assert got == sorted((f"f{i}", g) for i, x in enumerate(names) for g, b in bodies if x and x.strip() and x in b)


def test_export_names(spark):
    long = "t" * 115
    rows = [("g1", "/x/", "same"), ("{g2-aaaabb}", "/x/", "same"), ("g2-aaaabbbc", "/x/", "same"), ("g3", "/y/", "same")]
    rows += [("z1", "/x/", "a"), ("z2", "/x/", "a.zip"), ("z3", "/x/", "a_z4"), ("z4", "/x/", "a"), ("z5", "/x/", "a_2"), ("z6", "/x/", "b"), ("z7", "/x/", "b")]
    rows += [("y1", "/x/", long), ("y2", "/x/", long), ("y3", "/x/", long[:110] + "_y2"), ("y2", "/y/", "b"), ("g2-aaaaccc", "/x/", "same"), ("h1", "/x/", "same_2")]
    rows = [(f"{g}", loc, t) for g, loc, t in rows]
    got = {r["guid"]: r["name"] for r in library.export_names(spark.createDataFrame([r for r in rows if r[1] == "/x/"], "guid string, location string, title string")).collect()}
    assert got == names_in_order([r for r in rows if r[1] == "/x/"])
    assert got["g1"] == "same" and got["z7"] == "b_z7"
    assert library.export_names(spark.createDataFrame([], "guid string, location string, title string")).count() == 0


def test_upsert_and_conform(spark):
    base = spark.createDataFrame([("a", 1, False, False), ("b", 1, True, False)], "guid string, x int, dirty_info boolean, dirty_data boolean")
    out = {r["guid"]: tuple(r)[1:] for r in library.upsert(base, spark.createDataFrame([("b", 2), ("c", 3)], "guid string, x int")).collect()}
    assert out == {"a": (1, False, False), "b": (2, True, False), "c": (3, True, True)}
    assert conform(spark.createDataFrame([("a",)], "guid string"), origin="elsewhere").first()["origin"] == "elsewhere"
    with pytest.raises(ValueError, match="newer"):
        conform(base, 7)


def test_trim_is_unicode_white_space(spark):
    marks = [chr(i) for i in [*range(0x00, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    rows = [(m + "é a" + m + "b" + m + " " + m,) for m in marks] + [("",), (" \u3000\n",), (None,), ("x",)]
    own = spark.createDataFrame(rows, "t string")
    assert own.where(~text.trim(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
