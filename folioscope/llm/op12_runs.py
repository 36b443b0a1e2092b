"""Periodic runs of words: Kolpakov and Kucherov's method on the stretches of a text where runs can lie.

A run is a stretch with smallest period q and length >= max(LEAST, POWER * q) that can't be extended keeping it.

1. Stretches.  With q <= length / 3 and length >= 24 a run minus one period has 16 words at least, so each of its words lies
   in a repeated group of GRAM = 16 words.  Groups are compared by hashes for all texts of a step at once; words in none are
   in no run, and a run lies in one stretch of words that are.  What follows works on stretches alone.
2. LZ factorisation from the suffix automaton of the stretch: each factor is a new word or the longest that has begun before.
3. Main's step: a run that isn't inside one factor touches the border of two.  With the factor before it, [b', b), and the one
   after it, [b, f), its period is below (f - b') / 2, since otherwise the factor at b' would have been longer.  For
   all such borders and periods at once, how far words q apart agree to both sides of the border is found by bisection over
   hashes of prefixes; the runs found are compared word by word afterwards.
4. A run inside a factor is the copy of one in the factor's earlier occurrence.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, only, steps
from .shingles import Words, mixed

LEAST, POWER = 24, 3
GRAM = min(LEAST - LEAST // POWER, LEAST * (POWER - 1) // POWER)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.Generator(np.random.PCG64(31)).integers(1 << 63, size=GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MODULUS = (1 << 31) - 1


def stretches(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Where words that lie in repeated groups of GRAM begin and end; words: hashes, doc: the text of each, ascending."""
    n = len(words) - GRAM + 1
    if n < 2:
        return []
    whole = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    key = np.zeros(n, np.uint64)
    for j in range(GRAM):
        key += words[j : j + n] * _ODD[j]
    key = mixed(key + mixed(doc[:n].astype(np.uint64) + np.uint64(1)))[whole]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, whole[again], 1)
    np.add.at(change, whole[again] + GRAM, -1)
    inside = np.cumsum(change)[:-1] > 0
    edge = inside & np.concatenate([[True], ~inside[:-1] | (doc[1:] != doc[:-1])])
    last = inside & np.concatenate([~inside[1:] | (doc[1:] != doc[:-1]), [True]])
    return [(a, b) for a, b in zip(np.flatnonzero(edge).tolist(), (np.flatnonzero(last) + 1).tolist()) if b - a >= LEAST]


def automaton(words: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton: each state's transitions, and where its strings end first (the last word's number)."""
    goes: list[dict[int, int]] = [{}]
    length, link, ends = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(words):
        now = len(goes)
        goes.append({})
        length.append(i + 1)
        link.append(0)
        ends.append(i)
        p = last
        while p >= 0 and c not in goes[p]:
            goes[p][c] = now
            p = link[p]
        if p >= 0:
            q = goes[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(goes)
                goes.append(dict(goes[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append(ends[q])
                while p >= 0 and goes[p].get(c) == q:
                    goes[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return goes, ends


def factors(words: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors as (begin, end, where the earlier occurrence begins; -1: a new word)."""
    goes, ends = automaton(words)
    out, at, n = [], 0, len(words)
    while at < n:
        state, to = 0, at
        while to < n:
            step = goes[state].get(words[to])
            if step is None or ends[step] >= to:
                break
            state, to = step, to + 1
        if to == at:
            out.append((at, at + 1, -1))
            at += 1
        else:
            out.append((at, to, ends[state] - (to - at) + 1))
            at = to
    return out


class Prefixes:
    """Equality of stretches by hashes of prefixes, for many pairs at once."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        # sum of value * base^i mod 2^61 - 1 isn't in reach of 64-bit products; two moduli of 31 bits are
        draw = np.random.Generator(np.random.PCG64(17))
        self.parts = []
        for _ in range(2):
            base = int(draw.integers(1 << 20, _MODULUS - 1))
            power = _powers(base, n + 1)
            value = mixed(words + draw.integers(1 << 63, dtype=np.uint64)) % np.uint64(_MODULUS)
            total = np.concatenate([[0], np.cumsum(value.astype(np.int64) * power[:n] % _MODULUS) % _MODULUS])
            self.parts.append((power, total))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of that length at a and at b (a < b) hash alike."""
        ok = np.ones(len(a), bool)
        for power, total in self.parts:
            one = (total[a + length] - total[a]) % _MODULUS
            two = (total[b + length] - total[b]) % _MODULUS
            ok &= one * power[b - a] % _MODULUS == two
        return ok

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b (a < b) on are the same."""
        low, high = np.zeros(len(a), np.int64), self.n - b
        return self._bisect(low, high, lambda m: self.same(a, b, m))

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b (a < b) are the same."""
        return self._bisect(np.zeros(len(a), np.int64), a.copy(), lambda m: self.same(a - m, b - m, m))

    @staticmethod
    def _bisect(low: np.ndarray, high: np.ndarray, ok: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = ok(middle)
            low, high = np.where(good, middle, low), np.where(good, high, np.maximum(low, middle - 1))
        return low


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * pow(base, size, _MODULUS) % _MODULUS
        size += more
    return out


def runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a stretch of word hashes, by start and period."""
    if len(words) < LEAST:
        return []
    _, number = np.unique(words, return_inverse=True)
    own = factors(number.tolist())
    border = np.array([f[0] for f in own[1:]] + [len(words)])
    before = np.array([f[0] for f in own])
    after = np.append(border[1:], len(words))
    most = np.maximum((after - before) // 2, 0)
    b = np.repeat(border, most)
    q = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    found: dict[tuple[int, int], int] = {}
    hashes = Prefixes(words)
    # words q before the border and on from it; then the border and q after it
    for left, right, ok in ((b - q, b, b >= q), (b, b + q, b + q <= len(words))):
        left, right, period = left[ok], right[ok], q[ok]
        ahead, back = hashes.forward(left, right), hashes.backward(left, right)
        start, end = left - back, right + ahead
        good = (end - start >= POWER * period) & (end - start >= LEAST)
        for s, e, p in sorted(set(zip(start[good].tolist(), end[good].tolist(), period[good].tolist())), key=lambda r: r[2]):
            if np.array_equal(number[s : e - p], number[s + p : e]):
                found[s, e] = min(p, found.get((s, e), p))
            else:  # hashes of unlike stretches agree: all runs of that period, word by word
                for s, e in _of_period(number, p):
                    found[s, e] = min(p, found.get((s, e), p))
    ordered = sorted((s, e, p) for (s, e), p in found.items())
    for start, end, source in own:
        if end - start < LEAST + 2 or source < 0:
            continue
        i = bisect_right(ordered, (source, 1 << 62))
        while i < len(ordered) and ordered[i][0] < end:
            s, e, p = ordered[i]
            if e < source + end - start:
                copy = (s + start - source, e + start - source)
                if copy not in found:
                    found[copy] = p
                    insort(ordered, (*copy, p))
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _of_period(number: np.ndarray, period: int) -> list[tuple[int, int]]:
    """Where stretches that a period holds in begin and end, if they are long enough for a run."""
    same = np.concatenate([[False], number[:-period] == number[period:], [False]])
    begins, ends = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
    return [(s, e + period) for s, e in zip(begins.tolist(), ends.tolist()) if e + period - s >= max(LEAST, POWER * period)]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on are made to repeat with period p, for one doc_id in ten; else None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic(docs: DataFrame, change: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: by start, then period; in words), collapsed, of every row of docs(doc_id, text).

    Words are runs of other than ASCII white space, of the whole text; collapsed holds those that stay, joined by one space: all
    but what a run has after its first period.  change(doc_id, words) may give (a, p): the words from a on are then replaced by
    repeats of the p words at a.  Null and empty texts have no words, no runs and an empty collapsed text.  Rows
    with null or repeated doc_ids are handled each for itself; an empty table gives none; other columns are ignored.
    A step holds about a megabyte of text or one text; the automaton is made for a stretch at a time and takes about 400
    bytes for each word of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            yield _step(part, change)

    return only(docs, doc_id="long", text="string").mapInArrow(run, OUT)


def _step(part: pa.RecordBatch, change) -> pa.RecordBatch:
    words = Words(part["text"], folded=False)
    hashes = words.hashes()
    count = np.diff(words.of)
    keys = part["doc_id"].to_pylist()
    which = np.arange(len(hashes))  # the word that stands at each place
    for i, key in enumerate(keys):
        made = change(key, int(count[i])) if change else None
        if made:
            a, p = made
            first = words.of[i] + a
            which[first : words.of[i + 1]] = first + (np.arange(count[i] - a) % p)
    hashes = hashes[which]
    found: list[list[tuple[int, int, int]]] = [[] for _ in keys]
    drop = np.zeros(len(hashes) + 1, np.int64)
    for a, b in stretches(hashes, words.doc):
        base = int(words.of[words.doc[a]])
        for s, length, q in runs(hashes[a:b]):
            found[words.doc[a]].append((a + s - base, length, q))
            drop[a + s + q] += 1
            drop[a + s + length] -= 1
    stay = which[np.cumsum(drop)[:-1] == 0]
    kept = np.concatenate([[0], np.cumsum(np.cumsum(drop)[:-1] == 0)])[words.of]
    # each word that stays with one space after it, in one array of bytes; a text's last space is left out
    size = words.end[stay] - words.start[stay] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.append(words.data, np.uint8(0x20))
    where = np.repeat(words.start[stay] - at[:-1], size) + np.arange(at[-1])
    where[at[1:] - 1] = len(words.data)
    text = data[where].tobytes()
    begins, ends = at[kept[:-1]], at[kept[1:]]
    collapsed = [text[a : max(a, b - 1)].decode() for a, b in zip(begins.tolist(), ends.tolist())]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    lists = pa.array([[dict(zip(("start", "length", "period"), r)) for r in sorted(own, key=lambda r: (r[0], r[2]))] for own in found], kind)
    return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(count, pa.int64()), lists, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), and digests of the runs and of the collapsed text."""
    # the greater exponent by exact products; of equal ones the first in order, which is that of the smallest start, then period
    better = lambda r, s: r.isNull() | (s["length"] * r["period"] > r["length"] * s["period"])
    top = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda r, s: F.when(better(r, s), s).otherwise(r))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return own.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic(documents(spark, sf_dir), planted))
