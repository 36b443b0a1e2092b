"""The stored index: versions, merges, writers that die or meet, and searches by postings."""

import os

import pytest
from pyspark.sql import functions as F

from folioscope.operators import grams, search
from folioscope.plans import lifecycle
from folioscope.sources import index as module
from folioscope.sources.index import Conflict, Index
from folioscope.sources.store import listed, read_text, write_new

NOTES = [("1", "Title one", "aaaa bb Where WHEREVER", "/en/"), ("2", "où", "ça et là ÉTÉ été", "/fr/"), ("3", "x", "", "/en/a/"), ("4", "aaa", "aa aaa aaaaa", "/de/"), ("5", "日本語テキスト", "全文検索 日本語 日本", "/ja/"), ("6", "İstanbul", "i̇s.*\\E[x]", "/tr/")]
SHAPE = "guid string, title string, body string, location string"


@pytest.fixture
def notes(spark):
    return spark.createDataFrame(NOTES, SHAPE)


@pytest.fixture
def own(spark, tmp_path):
    return Index(spark, f"file://{tmp_path}/index")


def by_guid(df):
    return {r["guid"]: r["title"] for r in df.collect()}


@pytest.mark.parametrize("keyword", ["where", "WHERE", "aaa", "aa", "été", "日本語", "テキ", "istanbul", ".*\\e", "/en", "absent", "zzz", "  tit ", "e o"])
def test_search_by_postings_is_search_by_scan(notes, own, keyword):
    own.build(notes)
    assert sorted(map(tuple, search.search_index(own, keyword).collect())) == sorted(map(tuple, search.search(notes, keyword).collect()))


def test_versions_are_pinned_and_merges_touch_their_keys(spark, notes, own):
    assert own.version() == 0
    assert own.build(notes, folder=notes.select(F.col("location").alias("path")).distinct()) == 1
    first = own.table("note", 1)
    more = spark.createDataFrame([("2", "new", "été bis", "/fr/"), ("7", "seven", "where to", "/en/")], SHAPE)
    assert own.merge(spark.createDataFrame([("2",), ("4",), ("7",), (None,)], "guid string"), more) == 2
    assert by_guid(own.table("note")) == {"1": "Title one", "2": "new", "3": "x", "5": "日本語テキスト", "6": "İstanbul", "7": "seven"}
    assert len(by_guid(first)) == 6 and by_guid(own.table("note", 1))["2"] == "où"
    assert own.describe()["totals"]["notes"] == 6 and own.table("folder").count() == 6
    assert {r["guid"] for r in search.search_index(own, "where").collect()} == {"1", "7"}
    assert search.search_index(own, "aaa").collect() != [] and {r["guid"] for r in search.search_index(own, "aaa").collect()} == {"1"}


def test_many_merges_become_one_layer(spark, notes, own, monkeypatch):
    monkeypatch.setattr(module, "LAYERS", 3)
    own.build(notes)
    for i in range(5):
        own.merge(spark.createDataFrame([("1",)], "guid string"), spark.createDataFrame([("1", f"t{i}", f"word{i} aaa", "/en/")], SHAPE))
    assert len(own.describe()["tables"]["note"]) <= 3
    assert by_guid(own.table("note"))["1"] == "t4" and {r["guid"] for r in search.search_index(own, "word4").collect()} == {"1"}
    assert search.search_index(own, "word3").collect() == []


def test_a_writer_that_dies_leaves_no_version(notes, own, monkeypatch):
    own.build(notes)
    monkeypatch.setattr(own, "_commit", lambda after, state: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        own.build(notes.limit(1))
    monkeypatch.undo()
    assert own.version() == 1 and own.table("note").count() == 6
    assert own.build(notes.limit(2)) == 2 and own.table("note").count() == 2
    assert own.sweep(keep=1) == 2 and own.table("note").count() == 2
    assert [n for n, _, _ in listed(own.spark, f"{own.root}/versions")] == ["0000000002.json"]


def test_of_two_writers_one_commits(notes, own):
    state = own.describe(own.build(notes))
    assert own._commit(1, state) == 2
    with pytest.raises(Conflict):
        own._commit(1, state)


def test_users_tables_stay_over_a_rebuild(spark, notes, own):
    own.build(notes)
    own.put("search_history", spark.createDataFrame([("where", 5)], "keyword string, ts long"))
    own.build(notes.limit(1))
    assert [tuple(r) for r in own.table("search_history").collect()] == [("where", 5)]
    assert own.build(notes.limit(1), search_history=spark.createDataFrame([], "keyword string, ts long")) == 4
    assert own.table("search_history").count() == 0


def test_lists_of_a_keyword_are_a_small_part(spark, own):
    many = spark.range(4000).select(F.col("id").cast("string").alias("guid"), F.concat(F.lit("note "), "id").alias("title"), F.sha2(F.col("id").cast("string"), 512).alias("body"), F.lit("/a/").alias("location"))
    own.build(many)
    lists, bodies = own.bytes_of_lists("note 399")
    whole = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(own.root[7:] + "/data") for f in files if "/grams/" in at)
    assert 0 < lists < whole / 3 and bodies > 0
    assert search.search_index(own, "note 3999").count() == 1


def test_an_empty_library_and_repeated_segments(notes, own, monkeypatch):
    own.build(notes.where("false"))
    assert search.search_index(own, "where").collect() == [] and own.describe()["totals"] == {"notes": 0, "d": 0}
    monkeypatch.setattr(grams, "SEGMENT_CHARACTERS", 1)
    monkeypatch.setattr(grams, "TASK_BYTES", 1)
    own.build(notes.coalesce(1))
    assert {r["guid"] for r in search.search_index(own, "aaa").collect()} == {"1", "4"}


def test_files_appear_whole_or_not(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.txt"
    assert write_new(spark, path, "één") and not write_new(spark, path, "two")
    assert read_text(spark, path) == "één" and [n for n, _, _ in listed(spark, f"file://{tmp_path}/a")] == ["b.txt"]
    assert listed(spark, f"file://{tmp_path}/none") == []


def test_postings_are_packed(spark):
    """Lists leave the task that makes them as packed differences, large numbers too, and are the same when unpacked."""
    import numpy as np

    lists = [[0], [5], [0, 1, 2], [127, 128, 16_512, 1 << 33, (1 << 33) + 1], list(range(1 << 40, (1 << 40) + 3000, 3)), [(1 << 62) - 1]]
    packed = grams.pack(np.array([x for own in lists for x in own]), np.cumsum([0, *map(len, lists)]))
    assert grams.unpack(packed).to_pylist() == lists and len(packed[4].as_py()) == 6 + 999
    assert grams.unpack(packed.slice(2, 2)).to_pylist() == lists[2:4] and grams.unpack(packed.slice(0, 0)).to_pylist() == []
    rows = spark.range(500).select(F.col("id").alias("n"), F.lit("abc").alias("t")).coalesce(1)
    made = grams.postings(rows, ("t",)).collect()
    assert [r["n"] for r in made] == [500] and len(made[0]["notes"]) < 600


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_stay_where_they_are(spark, own, monkeypatch):
    """Notes of a table that isn't small are written by the tasks that made them, and meet the keys of a merge by a broadcast."""
    many = spark.range(400).select(F.col("id").cast("string").alias("guid"), F.lit("t").alias("title"), F.concat(F.lit("word "), F.repeat(F.sha2(F.col("id").cast("string"), 512), 2)).alias("body"), F.lit("/a/").alias("location"))
    written, plain = [], own._write
    monkeypatch.setattr(own, "_write", lambda df, folder, name, *how: (written.append((name, plan_of(df))), plain(df, folder, name, *how))[1])
    monkeypatch.setattr(module, "FILE_BYTES", 1 << 10)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own.build(many)
        own.merge(many.where("guid % 3 = 0").select("guid"), many.where("guid % 2 = 0").withColumn("title", F.lit("new")))
        assert own.sweep(keep=1) == 0
        rows = own.table("note")
        assert [name for name, plan in written if name == "note" and "Exchange hashpartitioning" in plan] == []
        assert "Exchange hashpartitioning" not in plan_of(rows)
        assert by_guid(rows) == {str(i): "new" if i % 3 == 0 else "t" for i in range(400) if i % 3 or i % 2 == 0}
        assert search.search_index(own, "word").count() == 200
        monkeypatch.setattr(module, "BROADCAST_KEYS", 1)
        assert "Exchange hashpartitioning" in plan_of(own.table("note")) and own.table("note").count() == len(by_guid(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_texts_at_hand_are_not_joined(spark, tmp_path):
    """Notes get their bodies from their own rows; where ids are repeated each note meets each of their texts, as a join has it."""
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one\ntwo", "en", "a", 7), (2, None, None, "b", None), (3, "", "de", None, 0), (None, "lost", "en", "a", 4)]
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/key/documents.parquet")
    own = lifecycle._with_bodies(spark, f"{tmp_path}/key")
    assert "Exchange" not in plan_of(own)
    assert sorted((r["guid"], r["title"], r["body"]) for r in own.select("guid", "title", "body").collect()) == [("1", "one", "one\ntwo"), ("2", "", None), ("3", "", "")]
    spark.createDataFrame([*rows, (1, "other", "en", "a", 5)], shape).write.parquet(f"{tmp_path}/twice/documents.parquet")
    own = lifecycle._with_bodies(spark, f"{tmp_path}/twice").where("doc_id = 1")
    assert sorted((r["title"], r["body"]) for r in own.collect()) == [("one", "one\ntwo"), ("one", "other"), ("other", "one\ntwo"), ("other", "other")]
