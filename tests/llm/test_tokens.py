import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscope.llm import op1_tokens, op4_packing, op7_binary
from folioscope.llm.encoding import Encoder

PATHS = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
ALPHABET = [*"ab éñ \n\t.,'s<|>0 1  中 \r  日΅AZİς\x1c\x85", "<|endoftext|>", "don't", "  ", "\n\n", ", ", ". ", ".\n", "!!", "ß,", "×.", "÷", "”.", "é\n", "\nÀ", "\n×", "$$$", "_", "-"]


@pytest.fixture(scope="module", params=sorted(PATHS))
def both(request):
    return Encoder(PATHS[request.param], entries=500), Tokenizer.from_file(PATHS[request.param])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), max_size=6))
def test_ids_are_the_librarys(both, texts):
    own, library = both
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == wanted
    assert own.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in wanted]


def test_counts(spark, small, plain):
    library = Tokenizer.from_file(PATHS["byte_bpe_50k.json"])
    got = {r["doc_id"]: tuple(r)[1:] for r in op1_tokens.query(spark, small).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in plain}


def test_counts_of_odd_rows(odd, none):
    got = op1_tokens.token_counts(odd, PATHS["byte_bpe_50k.json"]).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[2]["n_bytes"] == 0
    assert by[9]["over_limit"] and None in by
    assert op1_tokens.token_counts(none, PATHS["byte_bpe_50k.json"]).collect() == []


def check_packing(rows, texts, length=2048):
    library = Tokenizer.from_file(PATHS["byte_bpe_50k.json"])
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, own in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    fills = []
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
        fills.append(at)
    return sum(0 if f & (f - 1) == 0 else length - f for f in fills) / sum(fills)


def test_packing(spark, small, plain):
    assert check_packing(op4_packing.query(spark, small).collect(), plain) < 0.03


def test_packing_of_odd_rows(odd, none):
    rows = op4_packing.pack(odd, PATHS["byte_bpe_50k.json"]).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 9) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 9)
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert any(r["doc_id"] is None for r in rows)
    assert op4_packing.pack(none, PATHS["byte_bpe_50k.json"]).collect() == []


def test_packing_splits_rows_that_repeat(spark):
    same = spark.range(4000, numPartitions=4).selectExpr("cast(null as long) as doc_id", "'one and the same text' as text")
    rows = op4_packing.pack(same, PATHS["byte_bpe_50k.json"], group_bytes=1 << 14).collect()
    sizes = np.unique([r["sequence_id"] >> 32 for r in rows], return_counts=True)[1]
    assert len(rows) == 4000 and len(sizes) > 15 and sizes.max() < 3 * sizes.mean()
    fills = {}
    for r in rows:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fills.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:]))


def test_first_fit_is_first_fit():
    draw = random.Random(4)
    for _ in range(50):
        sizes = sorted((draw.randint(1, 20) for _ in range(draw.randint(1, 60))), reverse=True)
        bins, offsets = op4_packing.first_fit(np.array(sizes), 20)
        room = []
        for n, b, o in zip(sizes, bins, offsets):
            want = next((i for i, free in enumerate(room) if free >= n), len(room))
            if want == len(room):
                room.append(20)
            assert (b, o) == (want, 20 - room[want])
            room[want] -= n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=3000), st.integers(1, 1500), st.integers(0, 100))
def test_blocks_round_trip(ids, block, percentile):
    payload = op7_binary.encode_blocks(np.array(ids, np.uint32), block, percentile)
    assert op7_binary.decode_blocks(payload).tolist() == ids
    if ids:
        assert op7_binary.decode_block(payload, (len(ids) - 1) // block).tolist() == ids[(len(ids) - 1) // block * block :]


def test_binary(spark, small, plain):
    library = Tokenizer.from_file(PATHS["word_bpe_49k.json"])
    wanted, at = {}, 0
    for i, t in plain:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        wanted[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in op7_binary.query(spark, small).collect()} == wanted


def test_binary_of_odd_rows(odd, none):
    rows = op7_binary.digests(op7_binary.write_segments(odd, PATHS["word_bpe_49k.json"])).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert rows[2]["n_tokens"] == rows[3]["n_tokens"] == 1
    assert op7_binary.digests(op7_binary.write_segments(none, PATHS["word_bpe_49k.json"])).collect() == []
