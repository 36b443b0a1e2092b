"""Ranked search, periodic runs and quality against plain versions."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import op11_ranking, op12_runs, op13_quality

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items, k=10):
    known = [(i, terms(t)) for i, t in docs]
    known = [(i, ts) for i, ts in known if ts]
    count, total = len(known), sum(len(ts) for _, ts in known)
    df = {}
    for _, ts in known:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, ts in known:
            m = 25 + 75 * len(ts) * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in terms(text) if t in df)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return out


def by_rank(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1]))


def test_ranked_search(spark, small, plain):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert by_rank(op11_ranking.query(spark, small).collect()) == by_rank(brute_ranks(plain, items))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    assert by_rank(db.sql(op11_ranking.ORACLE).fetchall()) == by_rank(brute_ranks(plain, items))


@pytest.mark.parametrize("sizes", [(op11_ranking.SEGMENT_DOCS, op11_ranking.ITEMS), (70, 3)])
def test_ranked_search_with_ties(spark, monkeypatch, sizes):
    """Few words and lengths, so that most scores are shared; many segments, and items in blocks."""
    monkeypatch.setattr(op11_ranking, "SEGMENT_DOCS", sizes[0])
    monkeypatch.setattr(op11_ranking, "ITEMS", sizes[1])
    draw = random.Random(4)
    docs = [(i if i % 9 else None, " ".join(draw.choice(["Ab", "b", "c", "dé", "e9", "rare%d" % draw.randrange(90)]) for _ in range(draw.randrange(0, 9)))) for i in range(700)]
    docs += [(5, "b b b"), (5, "b b b"), (None, None), (6, ""), (7, "?!"), (8, "b " * 70_000)]
    items = [(i, " ".join(draw.choice(["ab", "b", "c", "dé", "e9", "rare%d" % draw.randrange(90), "absent"]) for _ in range(i % 8))) for i in range(12)]
    got = op11_ranking.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([*items, (None, "b"), (50, None)], "item_id long, text string"))
    assert by_rank(got.collect()) == by_rank(brute_ranks(docs, items))


def test_ranked_search_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "alpha WORD x", 3), (1, "b", 4), (2, "?", 5)], "item_id long, text string, rank int")
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert by_rank(op11_ranking.ranked(odd, items).collect()) == by_rank(brute_ranks(plain, [(1, "alpha WORD x")]))
    assert op11_ranking.ranked(none, items).collect() == [] and op11_ranking.ranked(odd, items.where("false")).collect() == []


def test_blocks_are_passed_over():
    """A rare term sets the threshold, and the frequent one's blocks are only read where they could reach it."""
    n = 40_000
    text = ["common " * (1 + i % 3) + ("rare " if i % 4000 == 7 else "") + "filler%d" % i for i in range(n)]
    length = np.array([len(t.split()) for t in text])
    builder = op11_ranking.Builder(n, int(length.sum()))
    rows = [r for a in range(0, n, 1000) for r in builder.add(pa.array(range(a, a + 1000), pa.int64()), pa.array(text[a : a + 1000]))]
    rows = pa.Table.from_batches([*rows, *builder.close()]).to_pylist()
    segment = op11_ranking.Segment(np.frombuffer(rows[0]["postings"], "<i8"), rows[0]["df"], np.frombuffer(rows[0]["heads"], "<i8"), n, int(length.sum()))
    for r in rows:
        if r["term"] in ("common", "rare"):
            segment.add(r["term"], r["heads"], r["postings"])
    number = segment.number
    best = segment.search([(number["common"], 300), (number["rare"], 9000)], [], 3)
    assert len(best) == 3 and {b[2] % 4000 for b in best} == {7}
    assert len(segment.read[number["common"]]) < 140 and len(segment.heads[number["common"]]) == 313


def test_compressed_blocks_come_back():
    draw = np.random.default_rng(2)
    docs = np.sort(draw.choice(1 << 18, 5000, replace=False))
    tf = draw.integers(1, 5, 5000)
    tf[17] = 70_000
    term = np.repeat([0, 1, 2], [3000, 1, 1999])
    heads, data, first, at = op11_ranking.compressed(term, docs, tf, np.full(5000, 100))
    n = np.full(1 << 18, 0)
    own = op11_ranking.Segment(np.arange(1 << 18), 1 << 18, n, 1, 1)
    for t in range(3):
        own.add(str(t), heads[first[t] : first[t + 1]].tobytes(), data[at[t] : at[t + 1]].tobytes())
        d, value = own.blocks(t, np.arange(first[t + 1] - first[t]))
        assert np.array_equal(d, docs[term == t]) and np.array_equal(value, op11_ranking.impact(tf[term == t], np.full((term == t).sum(), 25)))


def brute_runs(words):
    """(start, length, period) by trying every period."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        start = None
        for j in range(q, n + 1):
            if j < n and words[j] == words[j - q]:
                start = j - q if start is None else start
            elif start is not None:
                if j - start >= max(24, 3 * q):
                    best.setdefault((start, j), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in best.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_digest(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_of_random_words():
    draw = random.Random(5)
    seen = 0
    for _ in range(400):
        words = []
        for _ in range(draw.randrange(1, 6)):
            base = [draw.choice("abAc") if draw.random() < 0.7 else str(draw.randrange(50)) for _ in range(draw.randrange(1, 12))]
            words += draw.choice([base, (base * draw.randrange(2, 12))[: draw.randrange(10, 100)], (base * 40)[: draw.randrange(10, 100)], words[-draw.randrange(1, 80) :]])
        want = brute_runs(words)
        part = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([" ".join(words)])], ["doc_id", "text"])
        got = op12_runs._step(part, None)
        assert [tuple(r.values()) for r in got["runs"].to_pylist()[0]] == want
        seen += len(want)
    assert seen > 300


def test_runs_copied_from_earlier_factors():
    block = ["x", *(["a", "b", "c"] * 12), "y", *(["d"] * 30), "z"]
    words = [*block, "between", *block, "again", *block]
    own = op12_runs.factors([sorted(set(words)).index(w) for w in words])
    assert [f for f in own if f[1] - f[0] > 24 and f[2] >= 0]
    hashes = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    assert op12_runs.runs(hashes) == brute_runs(words) and len(brute_runs(words)) == 6


def test_colliding_prefix_hashes_are_seen(monkeypatch):
    """With hashes that call everything alike the words themselves decide."""
    monkeypatch.setattr(op12_runs.Prefixes, "same", lambda self, a, b, n: np.ones(len(a), bool))
    words = [*"abcd", *"abc" * 12, *"xyz", *"d" * 30, *"qr"]
    got = op12_runs.runs(np.array([ord(w) for w in words], np.uint64))
    assert got == brute_runs(words)


def test_periodic_runs(spark, small, plain):
    got = sorted(tuple(r) for r in op12_runs.query(spark, small).collect())
    some = [(i, t) for i, t in plain if len(words_of(t)) < 1500]
    want = sorted(brute_digest(i, t) for i, t in some)
    wanted = {w[0] for w in want}
    assert len(got) == len(plain) and [g for g in got if g[0] in wanted] == want and sum(w[1] for w in want) > 5


def test_periodic_runs_of_odd_rows(spark, odd, none):
    more = spark.createDataFrame([(9, "la " * 100, "x", 1), (None, "la\n" * 30, "x", 1), (11, None, "x", 1)], "doc_id long, text string, runs string, start int")
    docs = odd.unionByName(more, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = op12_runs.digests(op12_runs.periodic(docs, op12_runs.planted)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_digest(i, t)) for i, t in rows)
    plain = {r["text"]: r for r in op12_runs.periodic(docs).select("doc_id", "runs", "collapsed", "collapsed").toDF("doc_id", "runs", "collapsed", "text").collect()}
    assert len(plain["la"]["runs"]) == 1
    assert op12_runs.digests(op12_runs.periodic(none)).collect() == []


def test_quality_learns(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = op13_quality.query(spark, small).collect()
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert [tuple(r) for r in rows] == [tuple(r) for r in op13_quality.query(spark, small).collect()]
    taught = [r["predicted"] == known[r["doc_id"]] for r in rows if r["doc_id"] in known and not r["held_out"]]
    assert np.mean(taught) > 0.9


def test_quality_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op13_quality.query(spark, sf).collect() if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in rows]) > 0.95
    kept = [r["predicted"] for r in rows if known[r["doc_id"]] == 1]
    assert np.mean(kept) > 0.97


def test_quality_without_or_with_one_kind_of_label(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    every = lambda i: i.isNotNull()
    assert {(r["score"], r["predicted"]) for r in op13_quality.judged(odd, labels, every).collect()} == {(1.0, 1)}
    assert {(r["score"], r["predicted"]) for r in op13_quality.judged(odd, labels.where("false"), every).collect()} == {(0.5, 1)}
    both = labels.unionByName(spark.createDataFrame([(6, 0), (8, 0), (9, 0)], "doc_id long, quality int"))
    clash = odd.selectExpr("*", "1 as good", "2 as half", "3 as x", "0.1D as score")
    got = op13_quality.judged(clash, both, every).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert op13_quality.judged(none, both, every).collect() == []


def test_statistics_and_isotonic_by_hand():
    names = op13_quality.STATISTICS
    row = dict(zip(names, op13_quality.statistics(pa.array(["Ab ab!! ab\nab ab ab\nab ab ab"]))[0]))
    assert row["unlike_words"] == pytest.approx(3 / 9) and row["again_lines"] == pytest.approx(1 / 3) and row["top_word"] == pytest.approx(7 / 9)
    assert row["exclaiming"] == pytest.approx(2 / 28) and row["capitals"] == pytest.approx(1 / 9) and row["lines"] == pytest.approx(2 / 28)
    assert np.isfinite(op13_quality.statistics(pa.array([None, "", " ", "\n", "a", "é" * 50_000]))).all()
    x = np.array([[i / 7 % 1, i / 3 % 1] for i in range(60)])
    z = op13_quality.fourier(np.repeat(x, 14, axis=1), np.zeros(28), np.ones(28))[:, :-1]
    exact = np.exp(-((np.repeat(x, 14, axis=1)[:, None] - np.repeat(x, 14, axis=1)[None]) ** 2).sum(-1) / (2 * 28 * op13_quality.WIDTH**2))
    assert np.abs(2 * z @ z.T / op13_quality.FEATURES - exact).max() < 0.35
    good, n = np.array([0.0, 2, 1, 0, 3]), np.array([2.0, 2, 2, 2, 3])
    assert op13_quality.isotonic(good, n).tolist() == [0, 0.5, 0.5, 0.5, 1]
