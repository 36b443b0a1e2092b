"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Bands are as long as 512 bins allow with a miss of one in a million at the threshold (56 of 9 for 0.85, 73 of 7 for
0.8).  Long bands matter: documents that share a passage and little else meet in far fewer buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linking
from .common import documents, steps
from .shingles import mixed, set_hash, sets

BINS_LOG2 = 9

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1 << 63, size=1 << BINS_LOG2, dtype=np.uint64) | np.uint64(1)
#: DONORS[attempt, bin]: the bin that an empty bin asks in that attempt, the same for every document.
_DONORS: list[np.ndarray] = []


def donors(attempts: int) -> np.ndarray:
    if not _DONORS or len(_DONORS[0]) < attempts:
        tries = np.arange(1 << (attempts - 1).bit_length(), dtype=np.uint64)[:, None] + np.uint64(1)
        _DONORS[:] = [(mixed(_SEEDS[None] * tries) >> np.uint64(64 - BINS_LOG2)).astype(np.int16)]
    return _DONORS[0][:attempts]


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """2^BINS_LOG2 bins of the smallest hash in each, from ascending distinct hashes; an empty bin takes a full one's value.

    Hashes are dealt by their top bits, so each bin's smallest comes first in order.  Densification is optimal in
    Shrivastava's sense: an empty bin asks bins by a hash of its own number and of the attempt until one is full.
    """
    bins = (hashes >> np.uint64(64 - BINS_LOG2)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out, full = np.zeros(1 << BINS_LOG2, np.uint64), np.zeros(1 << BINS_LOG2, bool)
    out[bins[first]] = hashes[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    attempts = 4 * len(full) // len(first) + 4
    while len(empty):
        asked = donors(attempts)[:, empty]
        ok = full[asked]
        at = ok.argmax(axis=0)
        done = ok[at, np.arange(len(empty))]
        out[empty[done]] = out[asked[at[done], np.flatnonzero(done)]]
        empty = empty[~done]
        attempts *= 2
    return out


def band_keys(signature: np.ndarray, count: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    own = mixed(signature[: count * rows] ^ _SEEDS[: count * rows]).reshape(count, rows)
    return mixed((own * _SEEDS[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(count, dtype=np.uint64))


def signatures(docs: DataFrame, size: int, count: int, rows: int) -> DataFrame:
    """Of docs(node, text): node, n_shingles, content (hash of the whole set; null: empty set), keys (band keys), and the sketch, a bit of every bin, in w0, w1, ..."""
    words = [f"w{i}" for i in range((1 << BINS_LOG2) // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            number, content, keys, bits = [], [], [], []
            for own in sets(part["text"], size):
                number.append(len(own))
                if not len(own):
                    content.append(None)
                    keys.append(None)
                    bits.append(np.zeros(len(words), np.int64))
                    continue
                bins = one_permutation(own)
                content.append(set_hash(own))
                keys.append(band_keys(bins, count, rows).view(np.int64))
                bits.append(np.packbits(mixed(bins ^ _SEEDS) >> np.uint64(63) > 0).view(np.int64))
            sketch = np.asarray(bits, np.int64).reshape(-1, len(words))
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(number, pa.int64()), pa.array(content, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *[pa.array(c) for c in sketch.T]], ["node", "n_shingles", "content", "keys", *words])

    return docs.mapInArrow(run, "node long, n_shingles long, content binary, keys array<long>" + "".join(f", {w} long" for w in words))


def classified(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """near_duplicates with two more columns, own_text and group_id (see linking.classified)."""
    found = linking.classified(docs, lambda table: signatures(table, size, *linking.bands(part / whole, 1 << BINS_LOG2)), size, part, whole)
    return found.select("doc_id", "n_shingles", F.col("class_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "own_text", "group_id")


def near_duplicates(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text).

    Words are runs of other than ASCII white space, A-Z lower-cased; a document's set is its distinct shingles
    of `size` words (fewer words: one shingle of all).  Documents with whole * intersection >= part * union are
    linked; component_id is the smallest doc_id in reach.  kept: doc_id = component_id.
    Equal sets are joined by their content hash (two 64-bit sums and the size) before anything else, so a group of
    copies is one node afterwards.  Texts without words have an empty set and stay alone.  A row with a null doc_id
    takes no part and has null component_id and kept = true.  Equal rows get equal answers; rows of one doc_id with unlike
    texts are documents of their own, each with its own n_shingles and component.  An empty table gives
    none; other columns are ignored.
    """
    return classified(docs, size, part, whole).drop("own_text", "group_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, part=85, whole=100)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e2.b FROM r JOIN e2 ON r.y = e2.a),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m ON m.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
