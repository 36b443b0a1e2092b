"""Exact top-k by inner product, pruned by segment means and deviations from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

SCALE = 256
K = 5
EVERY = 50
#: Queries of one broadcast block: with vectors of 1,000 components under 70 MB.
QUERY_BLOCK = 8192
#: Candidates handled at once in a task.
CANDIDATE_BLOCK = 1024
LEVELS = (1, 4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row sqrt(m) * mean and sqrt(m) * deviation of every segment (m: its length).

    The inner product of two such rows bounds that of the vectors from above: in each segment
    <q, x> = m mean mean + <q - mean, x - mean>, and the second term is at most m deviation deviation.
    So |q|^2 + |x|^2 - 2 * bound is a lower bound of their squared distance.
    """
    edges = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    parts = []
    for a, b in zip(edges[:-1], edges[1:]):
        own = x[:, a:b]
        mean = own.mean(axis=1)
        parts += [mean * np.sqrt(b - a), np.sqrt(((own - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(parts, axis=1)


class Best:
    """The k best (score, then smaller id) so far of each query."""

    def __init__(self, queries: int, k: int):
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates in any order."""
        k = self.scores.shape[1]
        touched = np.unique(query)
        q = np.concatenate([query, np.repeat(touched, k)])
        i = np.concatenate([ids, self.ids[touched].reshape(-1)])
        s = np.concatenate([scores, self.scores[touched].reshape(-1)])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, touched)
        take = first[:, None] + np.arange(k)
        self.scores[touched], self.ids[touched] = s[take], i[take]


def search_block(queries: np.ndarray, query_ids: np.ndarray, best: Best, x: np.ndarray, ids: np.ndarray, levels=LEVELS, known: list[np.ndarray] | None = None) -> int:
    """Score a block of candidates against all queries; pairs whose bound is below the query's k-th best are left out.

    known: the queries' statistics at each level, if they have been made already.
    Returns the number of pairs whose exact product was needed.  Values are integers below 2^24 in size, so float64
    products are exact for up to 32 components of the largest size, and checked by the caller.
    """
    kth = best.scores[:, -1]
    alive: tuple[np.ndarray, np.ndarray] | None = None
    for level, n in enumerate(levels):
        if n > max(1, x.shape[1]):
            break
        fq, fx = statistics(queries, n) if known is None else known[level], statistics(x, n)
        slack = 1e-9 * np.sqrt((fq**2).sum(1).max(initial=0) * (fx**2).sum(1).max(initial=0)) + 1e-6
        if alive is None:
            alive = np.nonzero(fq @ fx.T + slack >= kth[:, None])
        else:
            q, c = alive
            if len(q) * 4 > len(queries) * len(x):  # most are alive: one product of matrices is the cheaper way to the same bounds
                bound = (fq @ fx.T)[q, c]
            else:
                bound = np.einsum("ij,ij->i", fq[q], fx[c])
            ok = bound + slack >= kth[q]
            alive = q[ok], c[ok]
    q, c = alive
    own = query_ids[q] == ids[c]
    q, c = q[~own], c[~own]
    if len(q) * 8 > len(queries) * len(x):
        scores = (queries @ x.T)[q, c]
    else:
        scores = np.einsum("ij,ij->i", queries[q], x[c])
    better = scores >= kth[q]
    q, c, scores = q[better], c[better], scores[better]
    if len(q):
        best.add(q, ids[c], scores)
    return len(better)


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id, v: components floor(256 x), of the rows that take part (neither null nor with null or non-finite components)."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` components; shorter vectors count as zero beyond their end, longer ones aren't needed there."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i, : min(width, b - a)] = flat[a : a + min(width, b - a)]
    return out


def top_k(embeddings: DataFrame, is_query, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k rows of the highest integer inner product.

    Queries come to the driver in blocks of query_block vectors; one block at a time is broadcast, answered and staged.
    Every task takes all its rows against the block and gives k rows a query, which Spark reduces to k.  All queries
    meet all rows; nothing is sampled.  Ties go to the smaller vec_id; fewer than k rows give all there are.  Vectors of unlike
    length: the shorter counts as zero beyond its end.  Rows that repeat a vec_id all count as candidates, and a
    query's own id never does; a repeated query id is one query (the first in order of its values).  An empty table
    gives no rows.  Where products can reach 2^53, the sums are done in Python's integers; a component beyond long's range counts as the nearest
    end of it, and so does a score.
    """
    spark = embeddings.sparkSession
    rows = scaled(embeddings.select("vec_id", "embedding"))
    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts, ids, vectors = [], [], []
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def flush() -> None:
        """One block's answer, staged; its broadcast goes before the next one is made."""
        width = max(map(len, vectors))
        q = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            q[i, : len(v)] = v
        block = spark.sparkContext.broadcast((np.asarray(ids, np.int64), q))
        best = _against(rows, block, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(staged(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top-k"))
        block.destroy()
        ids.clear()
        vectors.clear()

    for row in asked.toLocalIterator():
        ids.append(row["vec_id"])
        vectors.append(row["v"])
        if len(ids) == query_block:
            flush()
    if ids:
        flush()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(parts[0].schema).parquet(*[p._staged_at for p in parts])


def _against(rows: DataFrame, block, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = block.value
        best, large = Best(len(queries), k), float(np.abs(queries).max(initial=0))
        exact: dict[int, list] = {}
        known = [statistics(queries, n) for n in LEVELS if n <= max(1, queries.shape[1])]
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
                part = batch.slice(at, CANDIDATE_BLOCK)
                x = _matrix(part["v"], queries.shape[1])
                ids = part["vec_id"].to_numpy()
                top = float(np.abs(x).max(initial=0))
                if large * top * queries.shape[1] < 2**53:
                    search_block(queries, query_ids, best, x, ids, known=known)
                else:
                    whole = np.array([[int(c) for c in r] for r in x], object).reshape(x.shape)
                    for i, q in enumerate(queries):
                        own = np.array([int(c) for c in q], object)
                        got = [(max(-(2**63), min(2**63 - 1, int(s))), int(n)) for s, n in zip(whole @ own, ids) if n != query_ids[i]]
                        exact[i] = sorted([*exact.get(i, []), *got], key=lambda t: (-t[0], t[1]))[:k]
        out = [(i, int(n), int(s)) for i, (r, m) in enumerate(zip(best.scores, best.ids)) for s, n in zip(r, m) if s > -np.inf]
        out += [(i, n, s) for i, got in exact.items() for s, n in got]
        if out:
            q, n, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[list(q)]), pa.array(n, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
