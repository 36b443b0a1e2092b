"""Packages written and read as files, and what goes into them."""

import glob
import json
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.operators import export
from folioscope.sources import package_files as files

NOTES = "guid string, title string, location string, body string, resources array<struct<name: string, data: binary>>"


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/out"


@pytest.fixture
def notes(spark):
    rows = [("g1", "T/itle", "/a/b/", "héllo", [("index_files/x.png", b"x"), ("../evil", b"e"), ("%2e%2E/evil", b"e"), ("note.md", b"no")]), ("g2", "T_itle", "/a/b/", None, None), ("g3", "100%25", "/", "z" * 300_000, [])]
    return spark.createDataFrame(rows, NOTES)


def test_round_trip(spark, notes, folder):
    made = export.packages(notes)
    assert {r["guid"]: r["skipped"] for r in made.collect()} == {"g1": 2, "g2": 0, "g3": 0}
    files.write_packages(made, folder)
    rows = {r["guid"]: r for r in files.written(spark, folder).collect()}
    assert {g: r["path"] for g, r in rows.items()} == {"g1": "a/b/T_itle.zip", "g2": "a/b/T_itle_g2.zip", "g3": "100%25.zip"}
    with zipfile.ZipFile(f"{folder[7:]}/a/b/T_itle.zip") as z:
        assert z.namelist() == ["note.md", "index_files/x.png"] and z.read("note.md") == "héllo".encode()
    assert rows["g3"]["size"] == os.path.getsize(f"{folder[7:]}/100%25.zip") < 3000
    listed = {(r["guid"], r["name"]): r for r in files.list_entries(spark, folder, ("note.md",)).collect()}
    assert set(listed) == {("g1", "note.md"), ("g1", "index_files/x.png"), ("g2", "note.md"), ("g3", "note.md")}
    assert listed["g3", "note.md"]["bytes"] == 300_000 and listed["g1", "index_files/x.png"]["data"] is None and bytes(listed["g2", "note.md"]["data"]) == b""


def test_ranges_are_a_small_part_of_a_large_package(spark, folder):
    big = [("big.bin", os.urandom(2_000_000)), ("small.txt", b"small")]
    files.write_packages(spark.createDataFrame([("p.zip", "g", big)], f"path string, guid string, entries {export.ENTRIES}"), folder)
    (row,) = files.list_entries(spark, folder).where("name = 'big.bin'").collect()
    assert row["file_bytes"] > 2_000_000 and row["read_bytes"] < 70_000
    wanted = spark.createDataFrame([("p.zip", "small.txt"), ("p.zip", "sm%61ll.txt"), ("p.zip", "../p.zip"), ("p.zip", "none"), ("../p.zip", "small.txt"), ("gone.zip", "x")], "path string, entry string")
    got = {(r["path"], r["entry"]): r for r in files.read_ranges(spark, folder, wanted).collect()}
    assert {k: r["data"] and bytes(r["data"]) for k, r in got.items()} == {("p.zip", "small.txt"): b"small", ("p.zip", "sm%61ll.txt"): b"small", ("p.zip", "../p.zip"): None, ("p.zip", "none"): None, ("../p.zip", "small.txt"): None, ("gone.zip", "x"): None}
    assert got["p.zip", "small.txt"]["read_bytes"] < 80_000


def test_later_commits_replace_paths(spark, notes, folder):
    files.write_packages(export.packages(notes), folder)
    changed = notes.where("guid = 'g2'").withColumn("title", F.lit("100%25")).withColumn("location", F.lit("/"))
    files.write_packages(export.packages(changed), folder)
    rows = {r["path"]: (r["guid"], r["number"]) for r in files.written(spark, folder).collect()}
    assert rows["100%25.zip"] == ("g2", 2) and rows["a/b/T_itle.zip"] == ("g1", 1) and len(rows) == 3
    assert {(r["path"], r["guid"]) for r in files.list_entries(spark, folder).collect()} == {(p, g) for p, (g, _) in rows.items()}


def test_a_task_that_fails_leaves_no_half_package_and_no_commit(spark, notes, folder, monkeypatch):
    bad = export.packages(notes).unionByName(spark.createDataFrame([("../out.zip", "g9", [("a", b"b")], 0)], f"path string, guid string, entries {export.ENTRIES}, skipped int"))
    with pytest.raises(Exception, match="not a path below"):
        files.write_packages(bad.coalesce(1), folder)
    assert files.written(spark, folder).collect() == [] and not glob.glob(f"{folder[7:]}/**/*.part", recursive=True) and not glob.glob(f"{folder[7:]}/**/.*", recursive=True)
    files.write_packages(export.packages(notes), folder)
    assert files.written(spark, folder).count() == 3


def test_an_attempt_that_is_repeated_counts_once(tmp_path, monkeypatch):
    """Two attempts of one task write the same package; the commit names the list of one of them."""

    class Context:
        attempt = 0

        def partitionId(self):  # noqa: N802
            return 3

        def taskAttemptId(self):  # noqa: N802
            Context.attempt += 1
            return Context.attempt

    monkeypatch.setattr(files.TaskContext, "get", staticmethod(Context))
    batch = pa.RecordBatch.from_pylist([{"path": "a.zip", "guid": "g", "entries": [{"name": "n", "data": b"d"}]}])
    writer = files.PackageWriter(f"file://{tmp_path}")
    writer.write(iter([batch]))
    first = (tmp_path / "a.zip").read_bytes()
    second = writer.write(iter([batch]))
    assert (tmp_path / "a.zip").read_bytes() == first
    writer.commit([second, None])
    assert json.loads((tmp_path / "_manifest" / "0000000001.json").read_text())["lists"] == [second.name]
    assert len(files.PackageReader(f"file://{tmp_path}", "packages", "").partitions()) == 1
    files.PackageWriter(f"file://{tmp_path}").abort([])
    stopped = files._replace
    with pytest.raises(TypeError):
        stopped(files.pafs.LocalFileSystem(), str(tmp_path / "a.zip"), object())
    assert (tmp_path / "a.zip").read_bytes() == first and not list(tmp_path.glob(".*.part"))


def test_html_package_with_attachments(spark, notes):
    att = spark.createDataFrame([("g1", "f.txt", b"one", 3, 0), ("g1", "f.txt", b"two", 3, 1), ("g1", "gone?", None, 9, 2)], "guid string, display_name string, data binary, size long, at int")
    page = notes.withColumn("body", F.when(F.col("guid") == "g1", "<p>é</BODY>").otherwise(F.col("body")))
    rows = {r["guid"]: {e["name"]: bytes(e["data"]) for e in r["entries"]} for r in export.packages(page, "html", att).collect()}
    assert list(rows["g1"]) == ["index.html", "index_files/x.png", "attachments/f.txt", "attachments/f_2.txt"] and rows["g1"]["attachments/f_2.txt"] == b"two"
    text = rows["g1"]["index.html"].decode()
    assert text.startswith("<p>é<div") and text.endswith("</div>\n</BODY>") and text.count("<li>") == 3 and 'href="attachments/f_2.txt"' in text and "gone?" in text
    assert rows["g2"] == {"index.html": b""}


def test_only_what_the_plan_names_is_written(spark, notes):
    plan = spark.createDataFrame([("g1", "reused"), ("g2", "added"), ("g3", "reexported"), ("g4", "tombstoned")], "guid string, status string")
    assert {r["guid"] for r in export.wanted_packages(export.packages(notes), plan).collect()} == {"g2", "g3"}


def test_self_contained_page(spark):
    html = '<p>imgx</p><IMG a="1" src="index_files/a%20b.png"> mid <link rel=x href="index_files/s/m.css" /> end <img class=x src="index_files/none.gif"><img src="http://x/y.png">'
    css = b"\xef\xbb\xbfbody{background:url('p.png')} i{x:url(data:abc)} u{y:url(q.png)}"
    pages = spark.createDataFrame([("1", html), ("2", "plain"), ("3", None), ("4", '<img src="index_files/a b.png">')], "guid string, html string")
    entries = spark.createDataFrame([("1", "index_files/a b.png", b"PNG"), ("1", "index_files/s/m.css", css), ("1", "index_files/s/p.png", b"P" * 100)], "guid string, name string, data binary")
    own = export.parts(pages)
    whole = own.orderBy("guid", "at").groupBy("guid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat_ws("", "before", "name", "after", "literal").alias("s")))), lambda x: x["s"]), "").alias("s"))
    assert {r["guid"]: r["s"] for r in whole.collect()} == {r["guid"]: r["html"] or "" for r in pages.collect()}
    got = {r["guid"]: (r["html"], r["inlined"], r["left"]) for r in export.self_contained(pages, entries).collect()}
    want = html.replace("index_files/a%20b.png", "data:image/png;base64,UE5H").replace('<link rel=x href="index_files/s/m.css" />', "<style>body{background:url(data:image/png;base64,%s)} i{x:url(data:abc)} u{y:url(q.png)}</style>" % ("UFBQ" * 33 + "UA=="))
    assert got == {"1": (want, 2, 1), "2": ("plain", 0, 0), "3": ("", 0, 0), "4": ('<img src="index_files/a b.png">', 0, 1)}
