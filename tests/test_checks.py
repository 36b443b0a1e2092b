"""Checks of exports and corpora, imports of files, settings, and small readers."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import checks, search
from folioscope.operators import library as lib


def test_import_copies_what_is_wanted(spark, tmp_path):
    source, library = tmp_path / "s", tmp_path / "l"
    for name, data in {"attachments/a": b"aaa", "attachments/b": b"b", "other/c": b"\xff\x00"}.items():
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(data)
    rows = spark.createDataFrame([("attachments/a", 3, 1), ("attachments/b", 1, 2), ("other/c", 0, 3), ("gone/d", 4, 4), ("../e", 1, 1), ("db-missing:x", 1, 0), ("f", 1, 0)], "file_path string, size long, tier int")
    there = spark.createDataFrame([("attachments/a", 3), ("attachments/b", 1), ("other/c", 2)], "path string, bytes long")
    held = spark.createDataFrame([("_attachments/b", 1), ("_attachments/a", 2)], "path string, bytes long")
    plan = checks.import_plan(rows, there, held)
    assert {r["file_path"]: r["action"] for r in plan.collect()} == {"attachments/a": "copied", "attachments/b": "skipped", "other/c": "copied", "gone/d": "missing", "../e": "unsafe"}
    assert {r["file_path"]: r["bytes"] for r in checks.import_files(plan, f"file://{source}", f"file://{library}").collect()} == {"attachments/a": 3, "other/c": 2}
    assert (library / "_attachments" / "a").read_bytes() == b"aaa" and (library / "other" / "c").read_bytes() == b"\xff\x00" and not list(library.rglob("*.part"))
    (source / "other" / "c").unlink()
    assert {r["file_path"]: r["bytes"] for r in checks.import_files(plan, f"file://{source}", f"file://{library}").collect()} == {"attachments/a": 3, "other/c": None}
    assert [tuple(r) for r in checks.import_report(plan).collect()] == [(2, 1, 1, 1, ["missing: gone/d", "unsafe: ../e"])]
    assert [tuple(r) for r in checks.import_report(plan.where("false")).collect()] == [(0, 0, 0, 0, [])]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, bad boolean")
    both = checks.check("X2", rows, ~F.col("bad"), "id").unionByName(checks.check("X1", rows.where("bad"), F.lit(False), "id"))
    got = checks.report_rows(both).collect()
    assert [r["line"] for r in got] == ["ok   X1: 0 of 1", "FAIL X2: 1 of 3 (b)", "1 of 2 checks passed"]
    assert json.loads(got[1]["json"]) == {"id": "X2", "total": 3, "failed": 1, "passed": False, "samples": ["b"]} and json.loads(got[2]["json"]) == {"passed": False, "checks": 2}
    checks.write_report(both, f"file://{tmp_path}/r")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/r/text").collect()] == [r["line"] for r in got]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, None), ({"endpoint": " https://s3.example.com/ "}, None), ({"endpoint": "http://localhost:9000"}, None), ({"endpoint": "http://172.31.0.9:1/x"}, None), ({"endpoint": "http://127.8.0.1"}, None),
        ({"endpoint": " / "}, "endpoint is empty"), ({"endpoint": "s3.example.com"}, "endpoint has no scheme"), ({"endpoint": "http://172.32.0.1"}, "endpoint is public and not https"), ({"endpoint": "http://10.1.2"}, "endpoint is public and not https"), ({"endpoint": "http://10.1.2.300"}, "endpoint is public and not https"),
        ({"bucket": "ab"}, "bucket"), ({"bucket": "Abc"}, "bucket"), ({"bucket": "abc-"}, "bucket"), ({"bucket": "a" * 64}, "bucket"), ({"bucket": "a.b-9"}, None),
        ({"prefix": "a/../b"}, "prefix"), ({"prefix": "a..b/c"}, None), ({"concurrency": 0}, "concurrency"), ({"concurrency": 17}, "concurrency"), ({"role": "export"}, None), ({"role": ""}, None), ({"role": "owner"}, "role"),
    ],
)
def test_settings(spark, change, want):
    row = {"endpoint": "https://x", "bucket": "abc", "prefix": "", "concurrency": 4, "role": "reader"} | change
    table = spark.createDataFrame([tuple(row.values())], "endpoint string, bucket string, prefix string, concurrency int, role string").select(F.struct("*").alias("s"))
    assert table.select(checks.settings_problem(F.col("s"))).first()[0] == want


def test_inspection_of_odd_bodies(spark):
    code = b'<textarea style="display:none">a\tb</textarea><code-mirror><pre class="CodeMirror-line">%s</pre></code-mirror>'
    rows = [("bom", b"\xef\xbb\xbfplain text here", 15), ("bad", b"\xffx", 2), ("none", None, 0), ("same", code % b"a   b", 0), ("wide", code % b"a  b", 0), ("diff", code % b"c", 0), ("ref", b'<img src="index_files/a/x.png"><img src=\'//h/y\'>', 0), ("fffd", "x�".encode(), 2)]
    got = checks.inspection(spark.createDataFrame(rows, "guid string, data binary, body_len long"), spark.createDataFrame([("ref", "index_files/y.png"), ("other", "index_files/x.png")], "guid string, name string")).first()
    assert {k: got[k] for k in ("notes", "open_fail", "decode_fail", "mojibake_notes", "code_blocks", "code_blank", "code_same", "code_width", "code_diff", "refs_missing", "remote_sources")} == {"notes": 8, "open_fail": 1, "decode_fail": 1, "mojibake_notes": 2, "code_blocks": 3, "code_blank": 0, "code_same": 1, "code_width": 1, "code_diff": 1, "refs_missing": 1, "remote_sources": 1}
    assert checks.inspection(spark.createDataFrame([], "guid string, data binary, body_len long"), spark.createDataFrame([], "guid string, name string")).first()["notes"] == 0


def test_small_readers(spark):
    rows = spark.createDataFrame([("b", None, None, None), ("a", 1, 2, "x")], "file_path string, size long, tier int, source string")
    assert [tuple(r) for r in lib.load_attachments(rows).collect()] == [("a", 1, 2, "x"), ("b", 0, 0, "")]
    meta = spark.createDataFrame([("md_converter", "3")], "key string, value string")
    assert [lib.converter_stale(meta, "md", "3"), lib.converter_stale(meta, "md", "4"), lib.converter_stale(meta, "native", "4"), lib.converter_stale(meta.where("false"), "md", "3")] == [False, True, False, True]
    assert search.cleared(spark.createDataFrame([("k", 1)], "keyword string, ts long")).collect() == []
    kinds = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n\xff\xfe",), (b"\xff\xd8\xff\xe0",), (b"\xfe\xff<SVG ",), (b"\xff\xfe",)], "d binary")
    assert [r[0] for r in kinds.select(text.image_kind(F.col("d"))).collect()] == ["png", "jpg", "svg", None]
