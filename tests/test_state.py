"""Streams folded by key and by parts, trees walked by tasks, ranks and samples."""

import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import audit
from folioscope.operators import library as lib
from folioscope.sources import walk
from folioscope.streaming import fold, keyed

SHAPE = "guid string, ts long, event string, dirty_info boolean, dirty_data boolean"


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    """Late and repeated times, nulls, a key that only comes later, a deleted note that is edited again."""
    first = [("a", 1, "edit", True, False), ("b", 5, "edit", False, True), ("b", 6, "sync", None, None), ("c", 1, "edit", True, True), (None, 1, "edit", True, True)]
    second = [("a", 3, "delete", False, True), ("c", 0, "sync", None, None), ("d", 1, "edit", False, False), ("b", 4, "edit", True, False), ("a", 2, "sync", None, None)]
    third = [("a", 4, "edit", True, None), ("d", 9, "sync", None, None), ("d", 9, "edit", True, True)]
    for rows in (first, second, third):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = keyed.run(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination()
    got = {r["guid"]: tuple(r)[1:] for r in keyed.state(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": (4, "edit", 4, True, True, False), "b": (6, "sync", 3, False, False, False), "c": (1, "edit", 2, True, True, False), "d": (9, "sync", 3, False, False, False)}


def test_keyed_state_folds_without_a_call_for_each_key(spark):
    rows = [("a", 2, "edit", True, False), ("a", 2, "sync", True, True), ("a", None, "delete", True, False), ("b", 1, None, True, False)]
    folded = keyed._folded(spark.createDataFrame(rows, SHAPE))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Python" not in plan
    assert {r["guid"]: tuple(r)[1:] for r in folded.collect()} == {"a": (2, "sync", 3, 2, keyed.NEVER, 2), "b": (1, None, 1, 1, keyed.NEVER, keyed.NEVER)}


def test_fold_prunes_versions_that_no_index_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fold, "KEPT_BATCHES", 2)
    shape = "guid string, ts long, event string"
    for i in range(5):
        spark.createDataFrame([("a", i, "edit"), (f"n{i}", i, "sync")], shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        fold.run(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    rows = {r["guid"]: (r["ts"], r["writes"]) for r in fold.state(spark, f"{tmp_path}/state").collect()}
    assert rows == {"a": (4, 5), **{f"n{i}": (i, 1) for i in range(5)}}
    assert len(os.listdir(tmp_path / "state" / "index")) <= 2 * 2
    part = [n for n in os.listdir(tmp_path / "state" / "v0") if n.startswith("part=")]
    assert len(part) == 1 and fold.latest_version(spark, f"{tmp_path}/state") == 4


def test_walk_is_a_plain_walk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "FOLDERS", 2)
    for name in ("a/b/c/1.txt", "a/.hidden/_x/2.txt", "_attachments/3 é%20.txt", "top.txt", "a/b/.DS_Store"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty/deep").mkdir(parents=True)
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    want = {(os.path.relpath(os.path.join(at, n), tmp_path), n in dirs) for at, dirs, names in os.walk(tmp_path) for n in [*dirs, *names] if n != "loop"}
    rows = walk.walk(spark, str(tmp_path)).collect()
    assert {(r["path"], r["folder"]) for r in rows} == want and len(rows) == len(want)
    assert all(r["folder"] or r["bytes"] == os.path.getsize(tmp_path / r["path"]) and r["mtime"] == int(os.path.getmtime(tmp_path / r["path"])) for r in rows)
    assert {r["path"] for r in walk.folders(spark, str(tmp_path)).collect()} == {"/a/", "/a/b/", "/a/b/c/", "/empty/", "/empty/deep/"}
    assert {r["path"] for r in walk.folders(spark, str(tmp_path), 1).collect()} == {"/a/", "/empty/"}
    assert {(r["path"], r["bytes"]) for r in walk.snapshot(spark, str(tmp_path), ["empty", "top.txt"]).collect()} == {("empty", 0), ("empty/deep", 0), ("top.txt", 7)}
    assert [r["path"] for r in walk.attachments(spark, str(tmp_path)).collect()] == ["_attachments/3 é%20.txt", "a/.hidden/_x/2.txt", "a/b/c/1.txt", "top.txt"]
    assert walk.walk(spark, str(tmp_path / "none")).collect() == []


def test_attachments_with_guids(spark, tmp_path):
    guid = "0F8FAD5B-D9CB-469F-A165-70867728950E"
    (tmp_path / f"[{{{guid}}}]report.pdf").write_text("x")
    (tmp_path / "plain.pdf").write_text("yy")
    assert [tuple(r) for r in walk.attachments(spark, str(tmp_path)).collect()] == [(f"[{{{guid}}}]report.pdf", "report.pdf", guid.lower(), 1), ("plain.pdf", "plain.pdf", None, 2)]


@pytest.mark.parametrize("rows", [200_000, 3])
def test_nearest_rank(spark, monkeypatch, rows):
    monkeypatch.setattr(lib, "RANK_ROWS", rows)
    monkeypatch.setattr(lib, "RANK_BINS", 4)
    values = [0.0, -1.5, 1e300, -1e300, 2.0, 2.0, 2.0, 2.0, 5e-324, float("inf"), float("-inf"), float("nan"), 3.25, 7.0, 7.0, None]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted((v for v in values if v is not None and v == v)) + [float("nan")]
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["q"]: r["value"] for r in lib.nearest_rank(table, "v", qs).collect()}
    assert {q: repr(v) for q, v in got.items()} == {q: repr(ordered[int((len(ordered) - 1) * q + 0.5)]) for q in qs}
    big = [2**62 + i for i in range(10)] + [-(2**62)] * 3
    got = {r["q"]: r["value"] for r in lib.nearest_rank(spark.createDataFrame([(v,) for v in big], "v long"), "v", qs).collect()}
    assert got == {q: sorted(big)[int((len(big) - 1) * q + 0.5)] for q in qs}
    assert lib.nearest_rank(table.where("v is null"), "v", qs).collect() == []


def test_samples_are_the_smallest(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", f"{i:03d}", i % 2 == 0) for i in range(60)] * 2 + [("c", None, True)], "k string, id string, passed boolean")
    got = {r["k"]: r["samples"] for r in lib.smallest(rows, "id", 3, ("k",)).collect()}
    assert got == {"a": ["001", "002", "004"], "b": ["000", "003", "006"]}
    report = lib.report(rows.select("id", "passed", F.lit(False).alias("skipped")))
    assert "collect_list" not in report._jdf.queryExecution().toString()
    assert [tuple(r) for r in report.collect()] == [(False, 60, ["001", "003", "005", "007", "009", "011", "013", "015"])]
    assert [tuple(r) for r in lib.report(rows.where("false").select("id", "passed", F.lit(False).alias("skipped"))).collect()] == [(True, 0, [])]


def test_conversion_samples(spark):
    docs = spark.createDataFrame([(i, "<table><tr><td>1</td><td>2</td></tr></table>" if i % 2 else "") for i in range(20)], "key int, html string")
    got = {r["kind"]: (r["documents"], r["samples"]) for r in audit.conversion_samples(docs).collect()}
    assert got == {"tables": (10, [1, 3, 5, 7, 9]), "empty": (10, [0, 2, 4, 6, 8])}


@pytest.mark.parametrize("limits", [(200_000, 20_000), (200_000, 2), (3, 2), (0, 2)])
def test_names_in_bodies_by_automata_and_by_joins(spark, monkeypatch, limits):
    """One automaton, several, and joins find the same names; a name in another, repeated ones, and ones that are nothing."""
    monkeypatch.setattr(lib, "AUTOMATON_NAMES", limits[0])
    monkeypatch.setattr(lib, "CHUNK_NAMES", limits[1])
    names = [("a", "report.pdf"), ("b", "port.p"), ("c", "report.pdf"), ("d", "x y z.txt"), ("e", " "), ("f", None), ("g", ""), ("h", "é全"), ("i", "absent"), ("j", "a  b")]
    bodies = [("1", "the report.pdf and report.pdf"), ("2", "sport.px y z.txt"), ("3", None), ("4", ""), ("5", "caféé全文"), ("6", "a  b a b")]
    got = lib.containment(spark.createDataFrame(names, "file_path string, display_name string"), spark.createDataFrame(bodies, "guid string, body string"))
    want = {(f, g) for f, n in names for g, b in bodies if n and n.strip() and b and n in b}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
