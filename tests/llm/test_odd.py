"""Names that operators use inside, near copies under one doc_id, memory that is bounded in bytes, very many languages."""

import hashlib
import re
import zlib
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import common, op2_fingerprints, op3_search, op5_toxicity, op7_binary, op9_dedup, op10_language, registry
from folioscope.llm.encoding import Encoder

ROOT = Path(corpus_pipeline.__file__).parent
TEXT = " ".join(f"w{i}" for i in range(400))


def names_inside():
    """Every name that the operators' and the pipeline's code gives to a column."""
    code = "".join(p.read_text() for p in [*sorted((ROOT / "folioscope" / "llm").glob("*.py")), ROOT / "corpus_pipeline.py"])
    found = {m for pattern in (r'\.alias\("(\w+)"', r'withColumn(?:Renamed)?\("(\w+)"', r'withColumnRenamed\("\w+", "(\w+)"', r'F\.col\("(\w+)"', r'"(\w+) (?:long|int|string|double|boolean|binary)') for m in re.findall(pattern, code)}
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture(scope="module")
def clashing(odd):
    names = names_inside()
    assert {"gone_id", "toxic", "component", "content", "node", "row", "id"} <= set(names)
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    return plain.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def test_stages_with_clashing_names(spark, clashing, odd, small):
    docs, plain = clashing, odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs, plain = stage(spark, docs, small), stage(spark, plain, small)
        if name == "packing":
            break
        assert docs.columns == clashing.columns
        key = lambda r: str((r["doc_id"], r["text"]))
        assert sorted(map(key, docs.collect())) == sorted(map(key, plain.collect()))
        assert all(r[n] == f"own {n}" for r in docs.collect() for n in names_inside())
    assert docs.count() == plain.count()


def test_operators_with_clashing_names(clashing, spark):
    labels = spark.createDataFrame([(1, 0, 1, "x", 2), (5, 1, 0, "x", 2), (5, 0, 1, "y", 3), (None, 1, 1, "z", 4)], "doc_id long, toxic int, quality int, text string, good int")
    assert op5_toxicity.severity(clashing, op5_toxicity.learn(clashing, labels)).count() == clashing.count()
    assert op9_dedup.near_duplicates(clashing).count() == clashing.count() == op2_fingerprints.near_classes(clashing).count()
    assert op10_language.predict(clashing, op10_language.learn(clashing)).count() == clashing.count()
    assert len(registry.queries()) == 13


def test_near_copies_under_one_doc_id(spark, small):
    """One row of a group stays, whatever ids its rows have; texts under one id that aren't alike stay both."""
    near = TEXT.replace("w200", "other")
    far = " ".join(f"v{i}" for i in range(300))
    rows = [(7, TEXT), (7, near), (8, TEXT + " end"), (9, far), (9, "something else altogether with few words"), (3, far + " more"), (11, TEXT), (None, TEXT), (None, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, small).collect()]
    assert sum(i == 7 for i, _ in got) == 1 and {i for i, _ in got} == {7, 3, 9, None}
    assert [t for i, t in got if i == 9] == ["something else altogether with few words"] and sum(i is None for i, _ in got) == 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_memory_is_bounded_in_bytes(name):
    """Texts without a place to cut are encoded each time and leave nothing; many words leave no more than is allowed."""
    draw = np.random.default_rng(1)
    letters = lambda n: "".join(map(chr, draw.integers(0x61, 0x7B, n)))
    own, library = Encoder(public_tokenizers.path(name), most=200_000), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(12):
        texts = [letters(9000) for _ in range(5)] + [" ".join(letters(6) for _ in range(200)), "same words again and again"]
        ids, bounds = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert max(map(len, own.known), default=0) <= 64 and own.ids.nbytes < 6 << 20
        assert own.weight == sum(map(len, own.known)) + 160 * len(own.known) + 4 * int(own.bounds[len(own.known)])
    assert own.weight < 200_000 + 12 * 6 * 200 * 170


def test_very_many_languages(spark, monkeypatch):
    monkeypatch.setattr(op10_language, "LANGUAGES", 5)
    monkeypatch.setattr(op10_language, "TRAINING", 20)
    monkeypatch.setattr(op10_language, "STEPS", 3)
    rows = [(i, f"{'abcdefghij'[i % 10] * 20} " * 5, f"l{i % 40}" if i % 2 else "l0") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = op10_language.learn(docs)
    assert len(net.languages) == 5 and "l0" in net.languages
    assert {r["lang_pred"] for r in op10_language.predict(docs, net).collect()} <= set(net.languages)


def test_statistics_of_queries_are_made_once(monkeypatch):
    draw = np.random.default_rng(3)
    queries, x = draw.integers(-99, 99, (6, 32)).astype(float), draw.integers(-99, 99, (50, 32)).astype(float)
    answers = []
    for known in (None, [op3_search.statistics(queries, n) for n in op3_search.LEVELS]):
        best = op3_search.Best(6, 5)
        op3_search.search_block(queries, np.arange(6), best, x, np.arange(50), known=known)
        answers.append((best.scores.tolist(), best.ids.tolist()))
    assert answers[0] == answers[1]


def test_hot_ids_are_split(spark):
    """A third of the rows have no id and a third one id: several ranges hold them, and what comes next and what came before is as in one order."""
    words = np.random.default_rng(5)
    text = lambda i: " ".join(f"w{words.integers(50)}" for _ in range(5 + i % 40)) if i % 11 else None
    rows = [(None if i % 3 == 0 else 500 if i % 3 == 1 else i, text(i)) for i in range(900)] + [(500, "same text")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ranges = common.Ranges(docs, "doc_id", 8)
    number = ranges.number(F.col("doc_id"), common.tie_of(F.col("text")))
    parts = docs.groupBy(number.alias("part")).count().collect()
    assert max(r["count"] for r in parts) < 300 and max(r["part"] for r in parts) < len(ranges) and ranges.split
    tied = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), common.tie_of(F.col("text")).alias("tie"), number.alias("part")).collect()
    order = sorted(tied, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"], r["text"]))
    assert [r["part"] for r in order] == sorted(r["part"] for r in order)
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in op2_fingerprints.with_edits(docs).collect())
    follow = [r["text"] for r in order[1:]] + [order[0]["text"]]
    assert got == sorted((str(r["doc_id"]), len(r["text"]), hashlib.sha256(op2_fingerprints.edited(r["text"], n).encode()).hexdigest()) for r, n in zip(order, follow))
    path = public_tokenizers.path("word_bpe_49k.json")
    library, start, want = Tokenizer.from_file(path), 0, []
    for r in order:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 1]
        want.append((start, str(r["doc_id"]), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["start"], str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in op7_binary.digests(op7_binary.write_segments(docs, path)).collect()) == want
    many = common.Ranges(spark.range(100_000), "id", 300)
    assert len(many) == 301 and many.number(F.col("id"), F.lit(0)) is not None
    sizes = [r["count"] for r in spark.range(100_000).groupBy(many.number(F.col("id"), F.lit(0)).alias("n")).count().collect()]
    assert len(sizes) == 300 and max(sizes) < 500
