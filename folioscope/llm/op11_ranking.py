"""Ranked lexical search: posting blocks with maximum impacts, and Block-Max WAND over segments of documents.

A segment is an inverted index of some megabytes of text, made by one task from rows it has read.  A term's postings lie in
blocks of BLOCK documents, compressed: gaps of document numbers and counts at the byte width that the block needs.
Of each block the first and last number and the largest impact are kept outside, so that it can be passed over as it is.

WAND looks for the next document whose lists could lift it to the threshold (the pivot), and Block-Max WAND tests it
with the maxima of the blocks it would fall in, by pointers that move without decompression.  Here both tests are made for many
documents at a time: bounds by cell (CELL document numbers in a row), then lists that no document needs to
be in alone (their maxima together stay below the threshold), then each document by what is known of it and block maxima
of what is not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, only, staged, steps, trim
from .shingles import Words

K = 10
#: Postings of a block; documents of a cell.
BLOCK, CELL = 128, 64
#: Bytes of text and documents of a segment, about; a longer text is a segment of its own.
SEGMENT_BYTES, SEGMENT_DOCS = 16 << 20, 1 << 16
#: Items, and bytes of their texts, that are searched for in one pass.
ITEMS, ITEM_BYTES = 512, 8 << 20
#: Documents of a first window, where there is no threshold yet.
FIRST_DOCS = 512

#: Bytes that end terms; A-Z counts as a-z.
NOT_TERMS = np.ones(256, bool)
NOT_TERMS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 32

#: What is known of a block: document numbers, largest impact, where it begins, postings, bytes of a gap and of a count.
HEAD = np.dtype([("first", "<i4"), ("last", "<i4"), ("top", "<i4"), ("at", "<i4"), ("count", "<i2"), ("gap", "u1"), ("times", "u1")])
INDEX = "segment long, term string, df long, heads binary, postings binary"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of texts in order: their bytes end to end, the length of each, and how many each text has."""
    words = Words(texts, NOT_TERMS)
    return _FOLDED[words.data[~NOT_TERMS[words.data]]], words.end - words.start, np.diff(words.of)


def _strings(body: np.ndarray, lengths: np.ndarray) -> pa.LargeStringArray:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (10**9 * tf) // (1000 * tf + 8 * m)


def norm(n: np.ndarray, count: int, total: int) -> np.ndarray:
    """m of documents of n terms, of `count` documents with `total` terms."""
    return 25 + (75 * n * count) // total


def _widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(values, starts)
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def compressed(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of postings sorted by (term, doc): heads, bytes, and where each term's first head and first byte are, with the ends last."""
    fresh = np.concatenate([[True], term[1:] != term[:-1]])
    starts = np.flatnonzero(fresh)
    rank = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
    begins = np.flatnonzero(rank % BLOCK == 0)
    count = np.diff(np.append(begins, len(term)))
    gap = np.diff(doc, prepend=0)
    gap[begins] = 0
    heads = np.zeros(len(begins), HEAD)
    heads["first"], heads["last"], heads["count"] = doc[begins], doc[begins + count - 1], count
    heads["top"] = np.maximum.reduceat(impact(tf, m), begins)
    wide = [_widths(gap, begins), _widths(tf - 1, begins)]
    heads["gap"], heads["times"] = wide
    at = np.concatenate([[0], np.cumsum(count * (wide[0] + wide[1]))])
    out = np.zeros(at[-1], np.uint8)
    number = np.arange(len(term)) - np.repeat(begins, count)
    for values, width, base in ((gap, wide[0], at[:-1]), (tf - 1, wide[1], at[:-1] + count * wide[0])):
        own = np.repeat(width, count)
        place = np.repeat(base, count) + number * own
        for lane in range(4):
            some = own > lane
            if not some.any():
                break
            out[place[some] + lane] = (values[some] >> (8 * lane)) & 0xFF
    first = np.append(np.searchsorted(begins, starts), len(begins))
    heads["at"] = at[:-1] - np.repeat(at[first[:-1]], np.diff(first))
    return heads, out, first, at[first]


class Builder:
    """Rows of the index from steps of documents, a segment at a time."""

    def __init__(self, count: int, total: int):
        self.count, self.total = count, total
        self.task, self.segments = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.body, self.lengths, self.n, self.bytes = [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        body, lengths, n = terms(texts)
        self.ids.append(ids)
        self.body.append(body)
        self.lengths.append(lengths)
        self.n.append(n)
        self.bytes += len(body)
        if self.bytes >= SEGMENT_BYTES or sum(map(len, self.n)) >= SEGMENT_DOCS:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        ids, n = pa.concat_arrays(self.ids), np.concatenate(self.n)
        lengths = np.concatenate(self.lengths)
        coded = _strings(np.concatenate(self.body), lengths).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        order = pc.array_sort_indices(ids).to_numpy()  # ascending, nulls last
        place = np.zeros(len(n), np.int64)
        place[order] = np.arange(len(n))
        key, tf = np.unique(code * len(n) + np.repeat(place, n), return_counts=True)
        names, ids, n = coded.dictionary, ids.take(pa.array(order)), n[order]
        segment = (self.task << 24) + self.segments
        self.segments += 1
        self.clear()
        m = norm(n, self.count, self.total)
        known = ids.null_count
        # the segment's documents are a row without a term: their ids, and how many terms each has
        yield self.rows(segment, [None], [len(n) - known], [n.astype("<i8").tobytes()], [ids.fill_null(0).to_numpy().astype("<i8").tobytes()])
        if not len(key):
            return
        term, doc = key // len(n), key % len(n)
        heads, data, first, at = compressed(term, doc, tf, m[doc])
        df = np.bincount(term, minlength=len(names))
        part = 1 << 14
        for a in range(0, len(names), part):
            b = min(a + part, len(names))
            own = [pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends[a : b + 1] - ends[a]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[ends[a] : ends[b]]))]) for ends, raw in ((first * HEAD.itemsize, heads.view(np.uint8)), (at, data))]
            yield self.rows(segment, names[a:b].cast(pa.string()), df[a:b], *own)
        trim()

    @staticmethod
    def rows(segment: int, names, df, heads, postings) -> pa.RecordBatch:
        names = names if isinstance(names, pa.Array) else pa.array(names, pa.string())
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        columns = [pa.array(np.full(len(names), segment)), names, pa.array(df), *[x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for x in (heads, postings)]]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], ["segment", "term", "df", "heads", "postings"])


class Segment:
    """A segment's documents and the lists of the terms that are asked for."""

    def __init__(self, ids: np.ndarray, known: int, n: np.ndarray, count: int, total: int):
        self.ids, self.known = ids, known
        self.m = norm(n, count, total)
        self.cells = -(-len(n) // CELL)
        self.number: dict[str, int] = {}
        self.heads: list[np.ndarray] = []
        self.postings: list[bytes] = []
        self.tops: list[int] = []
        self.bounds: list[np.ndarray] = []
        self.read: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []

    def add(self, term: str, heads: bytes, postings: bytes) -> None:
        h = np.frombuffer(heads, HEAD)
        self.number[term] = len(self.heads)
        self.heads.append(h)
        self.postings.append(postings)
        self.tops.append(int(h["top"].max()))
        bound = np.zeros(self.cells, np.int64)  # a cell's largest block maximum
        low, high = h["first"] // CELL, h["last"] // CELL
        span = high - low + 1
        np.maximum.at(bound, np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum()), np.repeat(h["top"], span))
        self.bounds.append(bound)
        self.read.append({})

    def blocks(self, i: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and impacts of some blocks of list i, decompressed once."""
        known, out = self.read[i], []
        for j in which.tolist():
            got = known.get(j)
            if got is None:
                h = self.heads[i][j]
                count, at = int(h["count"]), int(h["at"])
                gaps = np.frombuffer(self.postings[i], f"<u{h['gap']}", count, at)
                tf = np.frombuffer(self.postings[i], f"<u{h['times']}", count, at + count * int(h["gap"])).astype(np.int64) + 1
                doc = int(h["first"]) + np.cumsum(gaps, dtype=np.int64)
                got = known[j] = doc, impact(tf, self.m[doc])
            out.append(got)
        if len(out) == 1:
            return out[0]
        return np.concatenate([d for d, _ in out]), np.concatenate([x for _, x in out])

    def search(self, weights: list[tuple[int, int]], best: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
        """best (-score, 1 for a null id else 0, id), ascending, with this segment's documents; weights: (list, weight times repeats)."""
        weights = [(i, w) for i, w in weights if w > 0]
        if not weights:
            return best
        bounds = sum(w * self.bounds[i] for i, w in weights)
        order = np.argsort(-bounds, kind="stable")  # windows of cells of falling bounds, each four times as large as the one before
        at, size = 0, FIRST_DOCS // CELL * (1 if len(best) < k else 8)
        while at < self.cells:
            least = -best[-1][0] if len(best) >= k else 1
            own = order[at : at + size]
            own = own[bounds[own] >= least]
            if not len(own):
                break
            alive = np.zeros(self.cells, bool)
            alive[own] = True
            best = self._cells(weights, alive, best, k)
            at, size = at + size, 4 * size
        return best

    def _cells(self, weights: list[tuple[int, int]], alive: np.ndarray, best: list, k: int) -> list:
        """search() over the documents of some cells."""
        least = -best[-1][0] if len(best) >= k else 1
        # lists by ascending maximum: those whose maxima together are below the threshold can't lift a document alone
        order = sorted(weights, key=lambda x: x[1] * self.tops[x[0]])
        aside, reach = 0, 0
        while aside < len(order) and reach + order[aside][1] * self.tops[order[aside][0]] < least:
            reach += order[aside][1] * self.tops[order[aside][0]]
            aside += 1
        seen = np.concatenate([[0], np.cumsum(alive)])
        score = np.zeros(self.cells * CELL, np.int64)
        for i, w in order[aside:]:
            h = self.heads[i]
            which = np.flatnonzero(seen[h["last"] // CELL + 1] > seen[h["first"] // CELL])
            if len(which):
                doc, value = self.blocks(i, which)
                score[doc] += w * value
        score.reshape(-1, CELL)[~alive] = 0
        doc = np.flatnonzero(score)
        value, cell = score[doc], doc // CELL
        left = sum((w * self.bounds[i] for i, w in order[:aside]), np.zeros(self.cells, np.int64))
        for i, w in reversed(order[:aside]):
            keep = value + left[cell] >= least
            doc, value, cell = doc[keep], value[keep], cell[keep]
            if not len(doc):
                return best
            left = left - w * self.bounds[i]
            h = self.heads[i]
            block = np.searchsorted(h["last"], doc)
            inside = block < len(h)
            inside[inside] &= h["first"][block[inside]] <= doc[inside]
            if inside.any():
                other, add = self.blocks(i, np.unique(block[inside]))
                at = np.minimum(np.searchsorted(other, doc), len(other) - 1)
                value = value + np.where(other[at] == doc, w * add[at], 0)
        keep = np.flatnonzero(value >= least)
        keep = keep[np.lexsort((doc[keep], -value[keep]))[:k]]
        return sorted([*best, *[(-int(v), int(d >= self.known), int(self.ids[d])) for v, d in zip(value[keep], doc[keep])]])[:k]


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Of docs(text): documents with a term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = total = 0
        for part in steps(batches):
            n = np.diff(Words(part["text"], NOT_TERMS).of)
            some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], ["some", "total"])

    row = only(docs, text="string").mapInArrow(count, "some long, total long").agg(F.sum("some"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def build(docs: DataFrame, count: int, total: int) -> DataFrame:
    """The index of docs(doc_id, text), staged, without a shuffle: each task makes segments of what it reads.

    A segment has one row for each of its terms, and one without a term for its documents.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Builder(count, total)
        for part in steps(batches):
            yield from own.add(part["doc_id"], part["text"])
        yield from own.close()

    return staged(only(docs, doc_id="long", text="string").mapInArrow(make, INDEX), "postings")


def _answers(chosen: DataFrame, asked, k: int, count: int, total: int) -> DataFrame:
    """item, null_id, doc_id, score: k documents of each item and task, of the staged rows of an index.  asked: broadcast weights of each item's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = asked.value
        best: list[list] = [[] for _ in items]
        number, segment = None, None

        def close() -> None:
            if segment is not None:
                of = segment.number
                for q, weights in enumerate(items):
                    best[q] = segment.search([(of[t], w) for t, w in weights if t in of], best[q], k)

        for batch in batches:
            for s, term, df, heads, postings in zip(*[batch[c].to_pylist() for c in ("segment", "term", "df", "heads", "postings")]):
                if s != number:  # the row without a term comes first
                    close()
                    number, segment = s, Segment(np.frombuffer(postings, "<i8"), df, np.frombuffer(heads, "<i8"), count, total)
                else:
                    segment.add(term, heads, postings)
        close()
        rows = [(q, null, None if null else i, -s) for q, own in enumerate(best) for s, null, i in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item", "null_id", "doc_id", "score"])

    ordered = chosen.repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())
    return ordered.mapInArrow(run, "item long, null_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items(item_id, text) its k best of docs(doc_id, text) by impacts, scores above 0.

    Every document counts and is looked for, whole; nothing is capped.  Items come to the driver in blocks of ITEMS (and ITEM_BYTES);
    for each block the postings of its terms are picked from the index and every task answers all of the block's items
    over its segments, keeping the threshold it has reached from segment to segment; Spark ranks what tasks give.
    Equal scores go by ascending doc_id, null last.  Null texts have no terms; rows that repeat a doc_id are documents of
    their own.  Items with a null id or text, or without a known term, have no rows; of rows that repeat an item_id the first text in order
    counts.  Empty tables give none; other columns are ignored.
    """
    spark = docs.sparkSession
    count, total = statistics(docs)
    wanted = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text"))
    parts: list[DataFrame] = []
    index = build(docs, count, total) if count else None
    block: list[tuple[int, str]] = []

    def flush() -> None:
        body, lengths, n = terms(pa.array([t for _, t in block], pa.string()))
        names = _strings(body, lengths).to_pylist()
        ends = np.cumsum(n)
        repeats = [{} for _ in block]
        for q, (a, b) in enumerate(zip(ends - n, ends)):
            for t in names[a:b]:
                repeats[q][t] = repeats[q].get(t, 0) + 1
        few = spark.createDataFrame([(t,) for t in sorted(set(names))], "term string")
        chosen = staged(index.join(F.broadcast(few), "term", "left_semi").select(*index.columns).unionByName(index.where("term is null")), "asked-postings")
        df = {r["term"]: r["df"] for r in chosen.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * d + 1))) for t, d in df.items()}
        asked = spark.sparkContext.broadcast([[(t, r * weight[t]) for t, r in own.items() if t in weight] for own in repeats])
        found = _answers(chosen, asked, k, count, total)
        order = Window.partitionBy("item").orderBy(F.desc("score"), "null_id", "doc_id")
        ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], "item long, item_id long")
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(F.broadcast(ids), "item")
        parts.append(staged(top.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked"))
        asked.destroy()
        discard(chosen)
        block.clear()

    size = 0
    for row in wanted.toLocalIterator() if count else ():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if len(block) == ITEMS or size > ITEM_BYTES:
            flush()
            size = 0
    if block:
        flush()
    if index is not None:
        discard(index)
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return spark.read.schema(parts[0].schema).parquet(*[p._staged_at for p in parts])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL
), g AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, t, count(*) AS r FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY t),
s AS (SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN f USING (t), g GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
