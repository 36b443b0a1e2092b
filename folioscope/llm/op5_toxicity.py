"""Toxicity: cumulative-link ordinal regression over sparse text features, fitted here on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, only, staged, steps, trim
from .shingles import NOT_LETTERS, Words

#: Labelled documents that the fit uses at most, those of the smallest hashes of doc_id.
SAMPLE = 12_000
#: Features considered and kept at most.
CONSIDERED, KEPT = 20_000, 1024
#: Prefix lengths in bytes that are features beside whole words.
PREFIXES = (4, 5, 6)
GRADES = 4
#: Least likelihood-ratio statistic of a feature: chance alone gives less for all but a few of the features considered.
#: A feature is also at least 50 times as frequent in toxic documents.
TELLING = 20
_SALTS = np.random.Generator(np.random.PCG64(99)).integers(1 << 63, size=len(PREFIXES) + 1, dtype=np.uint64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of text and hash of every feature that occurs (words and their prefixes), and the words of each text.

    The last bit of a hash is 0 for a word and 1 for a prefix.
    """
    words = Words(texts, NOT_LETTERS)
    one = np.uint64(1)
    doc, hashes = [words.doc], [(words.hashes() ^ _SALTS[0]) & ~one]
    for k, salt in zip(PREFIXES, _SALTS[1:]):
        long = np.flatnonzero(words.end - words.start > k)
        doc.append(words.doc[long])
        hashes.append((words.hashes(words.start[long], words.start[long] + k) ^ salt) | one)
    return np.concatenate(doc), np.concatenate(hashes), np.diff(words.of)


class Finder:
    """Places of hashes in a sorted table of hashes, quick where most are absent."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(table >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the table, and where."""
        if not len(self.table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.table, hashes[some]), len(self.table) - 1)
        ok = self.table[at] == hashes[some]
        return some[ok], at[ok]


def rows_of(texts: pa.Array, finder: Finder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features by (text, column): value 1 + log(1 + occurrences in 100 words), occurrences; and words of each text."""
    doc, hashes, words = features(texts)
    which, column = finder(hashes)
    width = max(1, len(finder.table))
    pair, n = np.unique(doc[which] * width + column, return_counts=True)
    row, column = pair // width, pair % width
    return row, column, 1 + np.log1p(100 * n / np.maximum(words[row], 1)), words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """P(grade >= k) = sigmoid(w x - thresholds[k - 1]) with one w for all, thresholds ascending."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        return _sigmoid(eta[:, None] - self.thresholds[None])


def likelihood(x: np.ndarray, grade: np.ndarray, share: np.ndarray, weights: np.ndarray, free: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The penalised negative log-likelihood of grades, and its gradient by weights and free (first threshold, logs of the gaps)."""
    k, at = len(free), np.arange(len(x))
    gaps = np.exp(free[1:])
    theta = free[0] + np.concatenate([[0], np.cumsum(gaps)])
    above = _sigmoid((x @ weights)[:, None] - theta[None])
    full = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1)
    p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
    slope = full * (1 - full)
    low, high = slope[at, grade], slope[at, grade + 1]
    gradient = x.T @ ((high - low) / p * share) + penalty * weights
    d_theta = np.zeros(k)
    np.add.at(d_theta, grade[grade > 0] - 1, (low / p * share)[grade > 0])
    np.add.at(d_theta, grade[grade < k], -(high / p * share)[grade < k])
    d_free = np.concatenate([[d_theta.sum()], [gaps[j] * d_theta[j + 1 :].sum() for j in range(k - 1)]])
    return float(-(share * np.log(p)).sum() + penalty / 2 * (weights**2).sum()), np.concatenate([gradient, d_free])


def fit(x: np.ndarray, grade: np.ndarray, times: np.ndarray | None = None, grades: int = GRADES, rounds: int = 1500, rate: float = 0.1, penalty: float = 1e-7, positive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest penalised likelihood, by Adam on all rows.

    times: how often each row counts; positive: weights are kept at 0 or above.
    """
    k = grades - 1
    share = np.ones(len(x)) / len(x) if times is None else times / times.sum()
    weights = np.zeros(x.shape[1])
    # thresholds: the first, then logs of the gaps
    free = np.concatenate([[2.0], np.full(k - 1, 0.0)])
    moment, square = np.zeros(len(weights) + k), np.zeros(len(weights) + k)
    for t in range(1, rounds + 1):
        _, g = likelihood(x, grade, share, weights, free, penalty)
        moment = 0.9 * moment + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        step = rate * moment / (1 - 0.9**t) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
        weights = weights - step[: len(weights)]
        if positive:
            weights = np.maximum(weights, 0)
        free -= step[len(weights) :]
    gaps = np.exp(free[1:])
    return weights, free[0] + np.concatenate([[0], np.cumsum(gaps)])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """A model from docs(doc_id, text) and labels(doc_id, toxic 0/1); at most `sample` labelled documents are used, one text (the first in order) of each.

    The labels say toxic or not; grades 1 .. GRADES - 1 of toxic documents come from how many different words and
    prefixes they use that clean documents hardly do (by terciles).  Features are those frequent in toxic documents (counted in
    Spark, so only CONSIDERED of them come to the driver), screened by log odds.  A doc_id that labels repeat is toxic if any of its
    rows says so; null labels and null doc_ids don't count; other columns are ignored.  Without both kinds of label, or
    any telling feature, the model finds nothing toxic.
    """
    docs = only(docs, doc_id="long", text="string")
    nothing = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([6.0, 7.0, 8.0]))
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    own = staged(own, "labelled")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            doc, hashes, _ = features(part["text"])
            order = np.lexsort((doc, hashes))
            doc, hashes = doc[order], hashes[order]
            fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])])[: len(doc)]
            key, n = np.unique(hashes[fresh], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    toxic = own.where("toxic = 1")
    counts = toxic.mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 5")
    table = np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(CONSIDERED).collect()], np.int64).view(np.uint64))
    if not len(table):
        return nothing
    held = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value)
        for part in steps(batches):
            row, column, _, _ = rows_of(part["text"], finder)
            kind = part["toxic"].to_numpy()
            # one more column, -1, counts the documents
            key = np.concatenate([kind[row].astype(np.int64) * (1 << 32) + column + 1, kind.astype(np.int64) * (1 << 32)])
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 32), pa.array((key & 0xFFFFFFFF) - 1), pa.array(n)], ["toxic", "at", "n"])

    of = np.zeros((2, len(table) + 1))
    for r in own.mapInArrow(count, "toxic long, at long, n long").groupBy("toxic", "at").agg(F.sum("n").alias("n")).collect():
        of[min(1, r["toxic"]), r["at"] + 1] = r["n"]
    totals, (c, t) = of[:, 0], of[:, 1:]
    if not totals.all():
        return nothing
    odds = np.log((t + 0.5) / (totals[1] - t + 0.5)) - np.log((c + 0.5) / (totals[0] - c + 0.5))
    # likelihood-ratio statistic of the table (toxic or not) x (with the feature or without); TELLING is about 5 in a million
    cells = np.array([t, totals[1] - t, c, totals[0] - c])
    share = totals[1] / totals.sum()
    means = np.array([(t + c) * share, (cells[1] + cells[3]) * share, (t + c) * (1 - share), (cells[1] + cells[3]) * (1 - share)])
    z = 2 * (cells * np.log(np.maximum(cells, 1e-12) / np.maximum(means, 1e-12))).sum(axis=0)
    telling = np.flatnonzero((odds > 2) & (z > TELLING) & (c * totals[1] <= 0.02 * t * totals[0]))
    telling = np.sort(telling[np.argsort(-z[telling], kind="stable")][:KEPT])
    if not len(telling):
        return nothing
    told = docs.sparkSession.sparkContext.broadcast(table[telling])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(told.value)
        for part in steps(batches):
            row, column, value, _ = rows_of(part["text"], finder)
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = [pa.array([x[a:b] for a, b in zip(at[:-1], at[1:])], kind) for x, kind in ((column.astype(np.int32), pa.list_(pa.int32())), (value, pa.list_(pa.float64())))]
            some = pa.RecordBatch.from_arrays([part["doc_id"], part["toxic"], *lists], ["doc_id", "toxic", "columns", "vals"])
            yield some.filter(pa.array((np.diff(at) > 0) | (part["toxic"].to_numpy() > 0)))

    kept = own.mapInArrow(gather, "doc_id long, toxic int, columns array<int>, vals array<double>").orderBy("doc_id").collect()
    zeros = int(totals[0]) - sum(r["toxic"] == 0 for r in kept)
    x = np.zeros((len(kept) + 1, len(telling)))
    for i, r in enumerate(kept):
        x[i, r["columns"]] = r["vals"]
    # a prefix that one word accounts for would only catch other words by chance
    there = (x[:-1] > 0).astype(np.float64)
    word = (table[telling] & np.uint64(1)) == 0
    explained = (there.T @ there[:, word]).max(axis=1, initial=0) >= 0.9 * there.sum(axis=0)
    telling, x = telling[word | ~explained], x[:, word | ~explained]
    is_toxic = np.array([r["toxic"] > 0 for r in kept])
    amount = (x[:-1] > 0).sum(axis=1)
    cut = np.quantile(amount[is_toxic], [i / (GRADES - 1) for i in range(1, GRADES - 1)])
    grade = np.where(is_toxic, 1 + np.searchsorted(cut, amount), 0)
    # features were screened for odds above 1, so no weight speaks against; the last row stands for all clean documents without any telling feature
    weights, thresholds = fit(x, np.append(grade, 0), np.append(np.ones(len(kept)), zeros), positive=True)
    discard(own)
    del x, there, kept
    trim()
    return Ordinal(table[telling], weights, thresholds)


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs with severity (the expected grade, 0 to GRADES - 1), grade (thresholds passed) and toxic (grade 1 or more).

    docs(doc_id, text) may have other columns, which are dropped.  Null and empty texts have no features.  Null and
    repeated doc_ids are scored row by row; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*held.value)
        finder = Finder(own.hashes)
        for part in steps(batches):
            row, column, value, _ = rows_of(part["text"], finder)
            eta = np.bincount(row, own.weights[column] * value, part.num_rows) if len(row) else np.zeros(part.num_rows)
            p = own.probabilities(eta)
            grade = (p >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.round(p.sum(axis=1), 6)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], ["doc_id", "severity", "grade", "toxic"])

    return only(docs, doc_id="long", text="string").mapInArrow(score, "doc_id long, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of docs, all its columns, whose text isn't toxic; decided in the pass that reads them, without a join.

    Null and empty texts stay; rows that repeat, and null doc_ids, are judged row by row; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.hashes, model.weights, model.thresholds))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*held.value)
        finder = Finder(own.hashes)
        for part in steps(batches):
            row, column, value, _ = rows_of(part["text"], finder)
            eta = np.bincount(row, own.weights[column] * value, part.num_rows) if len(row) else np.zeros(part.num_rows)
            yield part.filter(pa.array(own.probabilities(eta)[:, 0] < 0.5))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return severity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
