"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, only, steps, text_buffers

#: Documents whose words teach the model of ordinary identifiers: those of the smallest hashes of doc_id.
SAMPLE = 500
#: Runs of token characters shorter than this are not judged by the models.
SHORTEST = 20
PLACEHOLDER = "[SECRET]"

#: The base patterns, the least lengths, and the kinds in their order.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_HEX_BYTE, _TOKEN_BYTE = np.zeros(256, bool), np.zeros(256, bool)
_HEX_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_TOKEN_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_=-"]] = True

#: Character classes of the models: 26 + 26 + 10 + 5, and one for a string's ends.
_CLASS = np.full(128, 67, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"):
    _CLASS[ord(_c)] = _i
_N = 68


@dataclass
class Markov:
    """ratio[a, b, c]: log-likelihood ratio, random against ordinary, of c after a and b; a run is a secret when its mean exceeds least."""

    ratio: np.ndarray
    least: float

    def score(self, run: str) -> float:
        c = np.concatenate([[67, 67], _CLASS[np.frombuffer(run.encode(), np.uint8)]])
        return float(self.ratio[c[:-2], c[1:-1], c[2:]].mean())


#: Kind of each symbol: lower case, upper case, digit, other, end.
_KIND = np.repeat(np.arange(5), [26, 26, 10, 5, 1])


def _table(strings: list[str]) -> np.ndarray:
    """Log probabilities of a character by the two before it, backed by the one before, and that by its kind alone."""
    three, two = np.zeros((_N, _N, _N)), np.zeros((_N, _N))
    for s in strings:
        c = np.concatenate([[67, 67], _CLASS[np.frombuffer(s.encode(), np.uint8)]])
        np.add.at(three, (c[:-2], c[1:-1], c[2:]), 1)
        np.add.at(two, (c[1:-1], c[2:]), 1)
    member = np.eye(5)[_KIND]
    kinds = member.T @ two @ member + 0.5
    zero = (kinds / kinds.sum(axis=1, keepdims=True) / member.sum(axis=0))[_KIND][:, _KIND]
    one = two + 20 * zero
    one /= one.sum(axis=1, keepdims=True)
    mixed = three + 10 * one[None]
    return np.log(mixed / mixed.sum(axis=2, keepdims=True))


def labelled(words: list[str], n: int = 3000, seed: int = 17) -> tuple[list[str], list[str]]:
    """Random strings over the alphabets that keys use, and identifiers put together from ordinary words."""
    draw = np.random.Generator(np.random.PCG64(seed))
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = (letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789+/", letters.upper() + "0123456789", letters + "0123456789", "0123456789abcdef", letters + letters.upper() + "0123456789_-")
    random = []
    for i in range(n):
        own = alphabets[i % len(alphabets)]
        random.append("".join(own[j] for j in draw.integers(len(own), size=draw.integers(SHORTEST, 65))))
    words = words or ["value", "index", "count", "name", "user", "table", "get", "data", "list", "type", "file", "state"]
    ordinary = []
    joins = ("_", "-", "/", "", "camel", "_")
    for i in range(n):
        how = joins[i % len(joins)]
        some, size = [], 0
        while size < SHORTEST:
            some.append(words[draw.integers(len(words))])
            size += len(some[-1])
        text = "".join([some[0], *(w[:1].upper() + w[1:] for w in some[1:])]) if how == "camel" else how.join(some)
        ordinary.append(text.upper() if i % 11 == 0 else text + str(draw.integers(1, 3000)) if i % 3 == 0 else text)
    return random, ordinary


def train(words: list[str]) -> Markov:
    """Models from one half of the words, and a threshold from strings of the other half, between its two kinds."""
    random, ordinary = labelled(words[::2])
    ratio = _table(random) - _table(ordinary)
    model = Markov(ratio, 0.0)
    random, ordinary = labelled(words[1::2], 1500, 18)
    high, low = np.quantile([model.score(s) for s in ordinary], 0.998), np.quantile([model.score(s) for s in random], 0.02)
    return Markov(ratio, float(max(0.0, high, (high + low) / 2)))


def learn(docs: DataFrame) -> Markov:
    """The model whose ordinary words are those of at most SAMPLE documents; the driver gets distinct words, not texts."""
    ids = [r[0] for r in docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    if not ids:
        return train([])
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])[A-Za-z][a-z]{2,14}(?![A-Za-z0-9])"), 0))
    got = docs.where(F.col("doc_id").isin(ids)).select(F.explode(words).alias("w")).select(F.lower("w").alias("w")).distinct().orderBy("w").collect()
    return train([r[0] for r in got])


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Where runs of at least `least` within one text begin; a run that goes on past a text's end is cut there."""
    border = offsets[(offsets > 0) & (offsets < len(mask))]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    first[border], last[border - 1] = mask[border], mask[border - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin[end - begin >= least]


def spans_of(text: str, model: Markov | None) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, secret's start, secret's end) in code points, in order of start and kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            out.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= ACCESS_LEAST:
            out.append((m.start(), 1, m.end(), m.start(), m.end()))
    for m in HEX.finditer(text):
        out.append((m.start(), 2, m.end(), m.start(), m.end()))
    if model is not None:
        base = [(s[0], s[2]) for s in out]
        for m in _TOKEN.finditer(text):
            run = m.group()
            if any(a < m.end() and m.start() < b for a, b in base) or not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
                continue
            if model.score(run) > model.least:
                out.append((m.start(), 3, m.end(), m.start(), m.end()))
    return sorted(out)


def _suspects(texts: pa.Array) -> np.ndarray:
    """Numbers of the texts that can hold a span, found on bytes."""
    data, offsets = text_buffers(texts)
    sign = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    at = np.concatenate([sign, _runs(_HEX_BYTE[data], offsets, HEX_LEAST), _runs(_TOKEN_BYTE[data], offsets, ACCESS_LEAST)])
    return np.unique(np.searchsorted(offsets, at, side="right") - 1)


def scan(docs: DataFrame, model: Markov) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, secret_start, secret_end>> of every row of docs(doc_id, text).

    Places are code points of the whole text, ends exclusive.  Runs of letters, digits and + / _ = - that base
    patterns don't touch are secrets when the mean log-likelihood ratio says so.  Null and empty texts have no
    spans; null and repeated doc_ids are scanned row by row; an empty table gives none; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.ratio.astype(np.float32), model.least))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret_start", pa.int64()), ("secret_end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Markov(*held.value)
        for part in steps(batches):
            found = [[] for _ in range(part.num_rows)]
            for i in _suspects(part["text"]):
                found[i] = [{"kind": KINDS[k], "start": a, "end": b, "secret_start": c, "secret_end": d} for a, k, b, c, d in spans_of(part["text"][int(i)].as_py(), own)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found, kind)], ["doc_id", "spans"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, secret_start: long, secret_end: long>>")


def redacted(docs: DataFrame, model: Markov) -> DataFrame:
    """docs, all columns, with every secret in text replaced by PLACEHOLDER (of an assignment its value alone); n_chars, if there, is that of the new text.

    Null and empty texts stay as they are; every row stays, repeats and null doc_ids too; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.ratio.astype(np.float32), model.least))
    names = docs.columns

    def clean(text: str, own: Markov) -> str:
        out, at = [], 0
        for _, _, _, a, b in sorted(spans_of(text, own), key=lambda s: (s[3], s[4])):
            if a < at:  # it overlaps what is gone already
                at = max(at, b)
                continue
            out += [text[at:a], PLACEHOLDER]
            at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Markov(*held.value)
        for part in steps(batches):
            texts = part["text"].to_pylist()
            sizes = part["n_chars"].to_pylist() if "n_chars" in names else None
            for i in map(int, _suspects(part["text"])):
                changed = clean(texts[i], own)
                if sizes is not None and changed != texts[i]:
                    sizes[i] = len(changed)
                texts[i] = changed
            columns = [pa.array(texts, part.schema.field(n).type) if n == "text" else pa.array(sizes, part.schema.field(n).type) if n == "n_chars" else part[n] for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    docs = documents(spark, sf_dir)
    found = scan(docs, learn(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
