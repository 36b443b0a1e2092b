"""Quality: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

The features cos(w x + b), w normal and b uniform, approximate a Gaussian kernel over standardised statistics of a text.  Each
task sums its part of the normal equations; Spark adds them up, and the driver solves a system of FEATURES unknowns,
whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, only, scratch, staged, steps
from .op10_language import held_out
from .shingles import Words, mixed

#: Random features, and the kernel's width in standard deviations times the root of the number of statistics.
FEATURES, WIDTH = 256, 1.0
#: Ridge penalty for each labelled row; standardised statistics are cut at so many deviations.
PENALTY, FARTHEST = 1e-5, 4.0
#: Bins of raw scores for the calibration, and the range they cover.
BINS, LOW, HIGH = 4096, -1.0, 2.0
#: Features are rounded to this fraction, so that sums of products are exact and don't depend on their order.
FRACTION = 4096.0

STATISTICS = (
    "log_bytes", "lower", "upper", "digits", "space", "lines", "stops", "marks", "symbols", "high_bytes", "exclaiming", "same_three",
    "log_words", "word_bytes", "word_spread", "long_words", "short_words", "capitals", "shouted", "with_symbol", "ends_odd",
    "unlike_words", "top_word", "again_pairs", "again_threes", "again_lines", "line_words", "entropy",
)


def _class(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_UPPER, _LOWER, _DIGIT = (_class(bytes(range(a, b + 1))) for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39)))
_SPACE, _STOP, _MARK, _SYMBOL, _EXCLAIM = (_class(c) for c in (b" \t\r\n\v\f", b".", b",;:'\"()?-", b"#$%&*+/<=>@[\\]^_`{|}~", b"!"))
_HIGH = _class(bytes(range(0x80, 0x100)))
_FEED = _class(b"\n")


def _repeats(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many different keys it has, and how often the most frequent comes."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(mixed(key ^ mixed(doc.astype(np.uint64) + np.uint64(1))), kind="stable")
    d, k = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
    count = np.diff(np.append(first, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, d[first], count)
    return np.bincount(d[first], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text, all finite; null counts as empty."""
    words, lines = Words(texts, folded=False), Words(texts, separators=_FEED)
    data, offsets = words.data, words.offsets
    n, size = len(offsets) - 1, np.diff(offsets)

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)

    same = np.zeros(len(data), bool)
    if len(data) > 2:
        same[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & ~_SPACE[data[2:]]
    count = np.diff(words.of)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc, values, n) / some

    mean = of_words(length)
    spread = np.sqrt(np.maximum(of_words(length**2) - mean**2, 0))
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data] | _EXCLAIM[data])])
    in_upper, in_symbol = upper[words.end] - upper[words.start], symbol[words.end] - symbol[words.start]
    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    hashes = words.hashes()
    unlike, most = _repeats(words.doc, hashes, n)
    again = []
    for k in (2, 3):
        width = max(0, len(hashes) - k + 1)
        whole = np.flatnonzero(words.doc[:width] == words.doc[len(hashes) - width :])
        key = sum((hashes[j : j + width] * np.uint64(2 * j + 0x9E3779B1) for j in range(k)), np.zeros(width, np.uint64))[whole]
        groups = np.maximum(count - k + 1, 0)
        again.append(1 - _repeats(words.doc[whole], key, n)[0] / np.maximum(groups, 1) * (groups > 0) - (groups == 0))
    rows = np.diff(lines.of)
    other_lines = _repeats(lines.doc, lines.hashes(), n)[0]
    kinds = np.bincount(np.repeat(np.arange(n), size) * 256 + data, minlength=256 * n).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(kinds * np.log2(np.maximum(kinds, 1e-12))).sum(axis=1)
    columns = [
        np.log1p(size), share(_LOWER[data]), share(_UPPER[data]), share(_DIGIT[data]), share(_SPACE[data]), share(_FEED[data]), share(_STOP[data]), share(_MARK[data]), share(_SYMBOL[data]), share(_HIGH[data]), share(_EXCLAIM[data]), share(same),
        np.log1p(count), np.log1p(mean), np.log1p(spread), of_words(length > 12), of_words(length <= 2), of_words(in_upper > 0), of_words((in_upper > 1) & (2 * in_upper > length)), of_words(in_symbol > 0), of_words(_SYMBOL[last] | _EXCLAIM[last]),
        unlike / some, most / some, *again, 1 - other_lines / np.maximum(rows, 1) - (rows == 0), np.log1p(count / np.maximum(rows, 1)), entropy,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Quality:
    """mean, deviation: of the statistics; weights: of the random features and a constant; points, values: the calibration."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    points: np.ndarray
    values: np.ndarray


def fourier(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """FEATURES random features and a constant of each row of statistics, rounded to FRACTION."""
    draw = np.random.Generator(np.random.PCG64(1_618_033))
    w = draw.normal(0, 1 / (WIDTH * len(mean) ** 0.5), (len(mean), FEATURES))
    b = draw.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / deviation, -FARTHEST, FARTHEST)
    return np.round(np.concatenate([np.cos(z @ w + b), np.ones((len(x), 1))], axis=1) * FRACTION) / FRACTION


def solved(products: np.ndarray, targets: np.ndarray, rows: float) -> np.ndarray:
    """Ridge weights; the constant isn't penalised."""
    penalty = np.full(len(targets), PENALTY * max(rows, 1.0) * FEATURES)
    penalty[-1] = 1e-9
    return np.linalg.solve(products + np.diag(penalty), targets)


def isotonic(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to the shares good / all_ by weighted squares, by pooling neighbours that decrease."""
    blocks: list[list[float]] = []
    for g, n in zip(good.tolist(), all_.tolist()):
        blocks.append([g, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.zeros(0), *[np.full(k, g / n) for g, n, k in blocks]])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x (statistics of the whole text) of every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            x = statistics(part["text"]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))], ["doc_id", "x"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(STATISTICS))


def learn(measures: DataFrame, labels: DataFrame) -> Quality:
    """A model from measured(doc_id, x) and labels(doc_id, quality 0/1), of all labelled rows that are given.

    A doc_id that labels repeat counts as good if most of its rows say so (a tie: good); of rows of measures that repeat a doc_id the
    first in order counts.  Null ids and null labels don't count.  Calibration is by scores of rows that a model fitted on
    the other half has not seen.  With one kind of label only, or none, every score is the share of good rows (no label: 0.5).
    """
    wide = len(STATISTICS)
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.when(F.col("quality") > 0, 1.0).otherwise(0.0)) >= 0.5).cast("int").alias("good"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half")
    rows = staged(measures.where(F.col("doc_id").isNotNull()).join(own, "doc_id").groupBy("doc_id", "good").agg(F.min("x").alias("x")).select("good", half, "x"), "labelled-measures")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, wide + 2))
        for batch in batches:
            x = np.round(_matrix(batch["x"]) * FRACTION) / FRACTION
            good = batch["good"].to_numpy()
            sums += [[len(x), good.sum(), *x.sum(axis=0)], [0, 0, *(x**2).sum(axis=0)]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(wide + 2)), pa.array(sums[0]), pa.array(sums[1])], ["i", "s", "q"])

    got = np.array(sorted(map(tuple, rows.mapInArrow(moments, "i long, s double, q double").groupBy("i").agg(F.sum("s"), F.sum("q")).collect())), float).reshape(-1, 3)
    if not len(got) or got[1, 1] in (0, got[0, 1]):
        share = 0.5 if not len(got) or not got[0, 1] else got[1, 1] / got[0, 1]
        return Quality(np.zeros(wide), np.ones(wide), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, share))
    total = got[0, 1]
    mean = got[2:, 1] / total
    deviation = np.sqrt(np.maximum(got[2:, 2] / total - mean**2, 0)) + 1e-3

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, good, side = fourier(_matrix(batch["x"]), mean, deviation), batch["good"].to_numpy(), batch["half"].to_numpy()
            for h in (0, 1):
                part = z[side == h]
                sums[h] += part.T @ np.concatenate([part, good[side == h, None]], axis=1)
        h, i, j = np.nonzero(sums)
        keep = (i <= j) & (sums[h, i, j] != 0)
        h, i, j = h[keep], i[keep], j[keep]
        for a in range(0, len(h), 32768):
            b = a + 32768
            yield pa.RecordBatch.from_arrays([pa.array(h[a:b]), pa.array(i[a:b]), pa.array(j[a:b]), pa.array(sums[h[a:b], i[a:b], j[a:b]])], ["h", "i", "j", "v"])

    parts = np.zeros((2, FEATURES + 1, FEATURES + 2))
    for r in rows.mapInArrow(products, "h long, i long, j long, v double").groupBy("h", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        parts[r["h"], r["i"], r["j"]] = r["v"]
    square, target = parts[:, :, :-1], parts[:, :, -1]
    square = square + np.transpose(np.triu(square, 1), (0, 2, 1))
    weights = [solved(square[s].sum(axis=0), target[s].sum(axis=0), square[s].sum(axis=0)[-1, -1]) for s in ([0], [1], [0, 1])]
    held = measures.sparkSession.sparkContext.broadcast((mean, deviation, weights))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, deviation, weights = held.value
        sums = np.zeros((BINS, 2))
        for batch in batches:
            z, side = fourier(_matrix(batch["x"]), mean, deviation), batch["half"].to_numpy()
            raw = np.where(side == 0, z @ weights[1], z @ weights[0])  # by the model of the other half
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            sums += np.stack([np.bincount(at, batch["good"].to_numpy(), BINS), np.bincount(at, minlength=BINS)], axis=1)
        some = np.flatnonzero(sums[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some, 0]), pa.array(sums[some, 1])], ["bin", "good", "n"])

    bins = np.array(sorted(map(tuple, rows.mapInArrow(tally, "bin long, good double, n double").groupBy("bin").agg(F.sum("good"), F.sum("n")).collect())), float)
    discard(rows)
    return Quality(mean, deviation, weights[2], LOW + (bins[:, 0] + 0.5) * (HIGH - LOW) / BINS, isotonic(bins[:, 1], bins[:, 2]))


def scores(measures: DataFrame, model: Quality) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 is likelier), predicted (1 from 0.5 on) of every row of measured(doc_id, x)."""
    held = measures.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            raw = fourier(_matrix(batch["x"]), own.mean, own.deviation) @ own.weights
            score = np.round(np.clip(np.interp(raw, own.points, own.values), 0, 1), 6)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return measures.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def judged(docs: DataFrame, labels: DataFrame, teaches) -> DataFrame:
    """doc_id, score, predicted of every row of docs(doc_id, text); the rows whose doc_id `teaches` is true for, where labelled, teach.

    Texts are read once, for their statistics (whole texts; null and empty ones are all zeros and get a score like any other), which are
    staged.  Null and repeated doc_ids are scored row by row; an empty table gives none; other columns are ignored.
    """
    with scratch() as kept:
        measures = staged(measured(docs), "measures")
        kept.append(measures)
        model = learn(measures.where(teaches(F.col("doc_id"))), labels)
    return scores(measures, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = judged(documents(spark, sf_dir), labels, lambda i: ~held_out(i))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
