"""Library operators where the provided tables lack the columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.operators import library as lib
from folioscope.operators import lifecycle as life
from folioscope.operators import search
from folioscope.sources import packages


@pytest.mark.parametrize("kind", ["boolean", "int"])
def test_latest_keeps_latches_of_older_changes(spark, kind):
    rows = [("a", 1, False, True, "x"), ("a", 2, False, False, "y"), ("b", 1, True, None, "x"), ("b", 1, False, None, "z"), ("c", 5, False, False, "x")]
    rows = rows if kind == "boolean" else [tuple(int(v) if isinstance(v, bool) else v for v in r) for r in rows]
    changes = spark.createDataFrame(rows, f"guid string, ts long, dirty_info {kind}, dirty_data {kind}, title string")
    got = lib.latest(changes)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 2, False, True, "y"), ("b", 1, True, None, "z"), ("c", 5, False, False, "x")]
    assert sorted(r["guid"] for r in lib.unsynced(got).collect()) == ["a", "b"]


def test_invariants_light_and_deep(spark):
    rows = spark.createDataFrame([("ok", "a", "m", 1), ("cut", "b", "m", 9), ("changed", "c", "m", 1), ("gone", "d", "m", 1), ("unread", "e", "m", 1), ("bare", "f", "", 1)], "guid string, path string, md5 string, size long")
    disk = spark.createDataFrame([("a", "m", 1), ("b", "n", 2), ("c", "n", 1), ("e", None, 1), ("f", "n", 1)], "path string, md5 string, size long")
    light = {r["guid"]: r["problem"] for r in lib.invariants(rows, disk, deep=False).collect()}
    assert light == {"cut": "size", "gone": "missing"}
    assert {r["guid"]: r["problem"] for r in lib.invariants(rows, disk).collect()} == light | {"changed": "md5", "unread": "md5"}
    with pytest.raises(ValueError):
        lib.invariants(rows.drop("size"), disk, deep=False)


def test_sync_up_tries_again_after_a_download():
    answers, downs = iter(["STALE", "CONFLICT", "OK"]), []
    assert life.sync_up(lambda: next(answers), lambda: downs.append(1)) == 3 and len(downs) == 2
    with pytest.raises(RuntimeError):
        life.sync_up(lambda: "STALE", lambda: downs.append(1))


def test_unique_names_skip_names_that_are_taken(spark):
    rows = [("s", i, n) for i, n in enumerate(["a.txt", "a_2.txt", "a.txt", "a.txt", ".x", ".x", "b", "b"])] + [("t", 0, "a.txt")]
    got = {(r["scope"], r["at"]): r["unique"] for r in life.unique_names(spark.createDataFrame(rows, "scope string, at int, name string")).collect()}
    assert [got["s", i] for i in range(8)] == ["a.txt", "a_2.txt", "a_3.txt", "a_4.txt", ".x", ".x_2", "b", "b_2"] and got["t", 0] == "a.txt"


def test_probe_length_and_search_of_nothing(spark):
    table = spark.createDataFrame([("<BODY x>a&nbsp;&amp;<style>z</style>  b</body>junk",), ("no <b>body</b> ",), (None,)], "h string")
    assert [r[0] for r in table.select(life.probe_length(F.col("h"))).collect()] == [5, 7, None]
    notes = spark.createDataFrame([("1", "Wer", "x", "/a/")], "guid string, title string, body string, location string")
    files = spark.createDataFrame([("f", "wer.txt", None, 4)], "file_path string, display_name string, db_name string, tier int")
    assert search.respond(notes, files, "  ").collect() == []
    got = sorted((r["kind"], r["title"], r["snippet"], r["hit_in"]) for r in search.respond(notes, files, "wer").collect())
    assert got == [("attachment", "wer.txt", "", "name"), ("note", "<mark>Wer</mark>", "x", "title")]


def test_files_on_disk(spark, tmp_path):
    package = packages.make_package({"index.html": b"<p>x", "index_files/a b.png": b"png"})
    for name, data in {"notes/{11}": package, "notes/{22}": b"no zip", "a/b/1.txt": b"x", "c/2.txt": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    content = spark.createDataFrame([("11", package), ("22", b"no zip")], "guid string, content binary")
    wanted = [("11", "index_files/a%20b.png"), ("11", "index.html"), ("11", "../index.html"), ("22", "index.html")]
    got = {(r["guid"], r["entry"]): r["data"] and bytes(r["data"]) for r in packages.read_entries(content, spark.createDataFrame(wanted, "guid string, entry string")).collect()}
    assert got == dict(zip(wanted, [b"png", b"<p>x", None, None]))
    snap = {r["path"]: r["bytes"] for r in packages.snapshot(spark, str(tmp_path), ["a", "c"]).collect()}
    assert snap == {"a/b/1.txt": 1, "c/2.txt": 1}
    assert {r["path"] for r in packages.disk_dirs(spark.createDataFrame([("a/b/1.txt",), ("_trash/2.txt",), ("top.txt",)], "path string")).collect()} == {"/a/", "/a/b/"}
    assert {r["md5"] for r in packages.file_md5(spark, str(tmp_path / "a")).collect()} == {hashlib.md5(b"x").hexdigest()}
    lines = spark.createDataFrame([('{"old": 7, "role": "reader"}',), ("{}",), ("no json",)], "value string")
    got = packages.settings(lines, {"role": ("string", "writer"), "new": ("int", 4)}, {"old": "new"})
    assert [tuple(r) for r in got.collect()] == [("reader", 7), ("writer", 4), ("writer", 4)]


def test_names_of_many_scopes_without_a_call_for_each(spark):
    """Two files of one name in each of many notes: tasks go through all their scopes, in batches, in order of `at`."""
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 1000).alias("scope"), (-F.col("id")).alias("at"), F.lit("a.txt").alias("name"))
    named = life.unique_names(rows)
    assert "FlatMapGroups" not in named._jdf.queryExecution().toString()
    got = {(r["scope"], r["at"]): r["unique"] for r in named.collect()}
    assert got == {(f"s{i % 1000}", -i): ["a_3.txt", "a_2.txt", "a.txt"][i // 1000] for i in range(3000)}
    notes = spark.range(2000).select(F.col("id").cast("string").alias("guid"), F.concat(F.lit("t"), F.col("id") % 1000).alias("title"), F.lit("/x/").alias("location"))
    export = lib.export_names(notes)
    assert "FlatMapGroups" not in export._jdf.queryExecution().toString()
    assert {r["guid"]: r["name"] for r in export.collect()} == {str(i): f"t{i % 1000}" if (str(i) == min(str(i % 1000), str(i % 1000 + 1000))) else f"t{i % 1000}_{i}" for i in range(2000)}
