import hashlib
import re

import numpy as np
import pyarrow as pa

import pytest

from folioscope.llm import linking, op2_fingerprints, op9_dedup
from folioscope.llm.linking import components
from folioscope.llm.shingles import sets


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(texts, size, part, whole):
    sets = {i: shingle_set(t, size) for i, t in texts}
    of = {i: i for i in sets}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and whole * common >= part * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark, docs, small, plain):
    got = {r["doc_id"]: tuple(r)[1:] for r in op9_dedup.query(spark, small).collect()}
    assert got == brute(plain, 3, 85, 100)
    got = {r["doc_id"]: tuple(r)[1:] for r in op9_dedup.near_duplicates(docs).collect()}
    assert got == brute(plain, 5, 80, 100)


def test_near_duplicates_of_odd_rows(odd, none):
    rows = op9_dedup.near_duplicates(odd, 3, 85, 100).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[4]["component_id"] == 1 and not by[4]["kept"] and by[6]["component_id"] == 5
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[7]["n_shingles"] == 0 and by[7]["kept"] and by[2]["component_id"] == 2
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert [r["component_id"] for r in rows if r["doc_id"] == 9] == [9, 9]
    assert op9_dedup.near_duplicates(none).collect() == []


def test_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):  # each a few words on from the one before
        rows.append((i, " ".join(words[:i] + [f"new{j}" for j in range(i)] + words[2 * i :]) if i < 3 else " ".join(words[i - 3 : i + 60])))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: tuple(r)[1:] for r in op9_dedup.near_duplicates(table, 3, 85, 100).collect()} == brute(rows, 3, 85, 100)


def near_copies(seed, groups, count, words=150):
    """Texts with up to a fifth of their words replaced, of few or many edits, in groups around a base that isn't itself among them."""
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"b{g}x{i}" for i in range(words)]
        for i in range(count):
            own = list(base)
            for at in draw.integers(words, size=draw.integers(0, 8)):
                own[at] = f"e{draw.integers(5)}" if draw.random() < 0.3 else f"n{draw.integers(1 << 40)}"
            rows.append((len(rows), " ".join(own[: words - int(draw.integers(0, 12))])))
    return rows


def dense(rows, size, part, whole):
    """component of each id, by all intersections at once."""
    own = sets(pa.array([t for _, t in rows]), size)
    flat, ids = np.unique(np.concatenate(own), return_inverse=True)
    x = np.zeros((len(own), len(flat)), np.float32)
    x[np.repeat(np.arange(len(own)), [len(s) for s in own]), ids] = 1
    common, n = x @ x.T, np.array([len(s) for s in own])
    near = whole * common >= part * (n[:, None] + n[None] - common)
    label = np.arange(len(own))
    while True:
        low = np.where(near, label[None], len(own)).min(axis=1)
        if (low == label).all():
            return {i: rows[c][0] for (i, _), c in zip(rows, label)}
        label = low


@pytest.mark.parametrize(("size", "part", "blocks"), [(5, 80, None), (3, 85, None), (5, 80, (20, 100))])
def test_large_groups_of_near_copies(spark, monkeypatch, size, part, blocks):
    if blocks:  # many blocks of guests and hosts
        monkeypatch.setattr(linking, "GUEST_ROWS", blocks[0])
        monkeypatch.setattr(linking, "HOST_ROWS", blocks[1])
    rows = near_copies(size, 3, 400)
    want = dense(rows, size, part, 100)
    assert 30 < len(set(want.values())) < 1100
    got = op9_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, part, 100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_stars_alone_leave_links_open(spark):
    """Two texts of one bucket linked with each other but not with its smallest node: steps 2 and 3 find the link."""
    rows = near_copies(11, 1, 600)
    table = spark.createDataFrame(rows, "node long, text string")
    count, width = linking.bands(0.8, 512)
    found = op9_dedup.signatures(table, 5, count, width)
    nodes = found.selectExpr("node", "n_shingles as n", "keys", *[c for c in found.columns if c.startswith("w")])
    edges = linking.stars(nodes)
    links = linking.verified(edges.select("a", "b"), table, 5, 80, 100)
    more = linking.crossings(nodes, edges, linking.components(links), table, 5, 80, 100).collect()
    want = dense(rows, 5, 80, 100)
    assert more and all(want[r["a"]] == want[r["b"]] for r in more)


def test_unlike_texts_of_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    one, other = " ".join(words), " ".join(reversed(words))
    rows = [(5, one), (5, other), (5, other), (3, other + " more"), (8, one + " more"), (6, None), (6, "x y z"), (2, "x y z")]
    got = sorted(tuple(r) for r in op9_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect())
    assert got == sorted([(5, 58, 5, True), (5, 58, 3, False), (5, 58, 3, False), (3, 59, 3, True), (8, 59, 5, False), (6, 0, 6, True), (6, 1, 2, False), (2, 1, 2, True)])


def test_densification_fills_all_bins():
    sig = op9_dedup.one_permutation(np.array([5], np.uint64))
    assert (sig == 5).all()


def test_components(spark):
    draw = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    of = {}

    def root(i):
        while of.setdefault(i, i) != i:
            i = of[i]
        return i

    for a, b in pairs:
        if a != b:
            x, y = root(a), root(b)
            of[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in of}


def test_fingerprints(spark, small, plain):
    got = {r["doc_id"]: r for r in op2_fingerprints.query(spark, small).collect()}
    texts = [t for _, t in plain]
    assert {i: r["class_id"] for i, r in got.items()} == {i: v[1] for i, v in brute(plain, 5, 80, 100).items()}
    near = []
    for n, (i, t) in enumerate(plain):
        following = texts[(n + 1) % len(texts)]
        k = len(t) // 4
        changed = t[: len(t) - k] + following[:k]
        row = got[i]
        assert row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = shingle_set(t, 5), shingle_set(changed, 5), shingle_set(following, 5)
        for one, other, said in ((a, b, row["near_edited"]), (a, c, row["near_next"])):
            near.append(said - (len(one & other) / len(one | other) if one | other else 1))
        assert row["edited_fingerprint"] == op2_fingerprints.as_text(op2_fingerprints.prints(pa.array([changed]))[0])
    assert np.abs(near).mean() < 0.03 and np.abs(near).max() < 0.25


def test_fingerprints_of_odd_rows(odd, none):
    rows = op2_fingerprints.with_edits(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[4]["fingerprint"] and by[5]["fingerprint"] == by[6]["fingerprint"]
    assert by[2]["near_next"] == 1.0 and by[2]["n_chars"] == 0
    assert by[10]["edited_sha256"] == hashlib.sha256(op2_fingerprints.edited(odd.where("doc_id = 10").first()["text"], "no id here at all").encode()).hexdigest()
    assert op2_fingerprints.with_edits(none).collect() == []


def test_banded_search(spark, docs, odd, plain):
    want = {i: v[1] for i, v in brute(plain, 5, 80, 100).items()}
    assert {r["doc_id"]: r["class_id"] for r in op2_fingerprints.near_classes(docs).collect()} == want
    assert {r["doc_id"]: r["class_id"] for r in op2_fingerprints.near_classes(odd).collect()}[4] == 1
    rows = near_copies(3, 2, 150)
    for part in (60, 80):  # bands follow the likeness
        got = op2_fingerprints.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), part=part).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == dense(rows, 5, part, 100)
