"""Language ID: a byte convolutional network (filters of several widths, max pooling, softmax), trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, only, staged, steps, text_buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Training documents of each language at most (those of the smallest hashes), and windows of each, spread over the whole text;
#: windows that hold fewer bytes than LEAST (the ends of texts, short texts) don't teach.
SAMPLE, SAMPLE_WINDOWS, LEAST = 300, 6, 32
#: Languages that are learned at most, those of the most documents (ties: by name), and training documents of all together; with
#: more languages than TRAINING / SAMPLE each has a smaller share of them.
LANGUAGES, TRAINING = 256, 20_000
STEPS, BATCH, RATE = 400, 64, 0.02

#: Symbols: 0 beyond the text, 1-26 ASCII letters of either case, then digits, white space, other ASCII, and each byte from 0x80 its own.
SYMBOLS = 158
_SYMBOL = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _SYMBOL[_b] = _b - 0x80 + 30 if _b >= 0x80 else ord(_c.lower()) - 96 if _c.isalpha() else 27 if _c.isdigit() else 28 if _c.isspace() else 29


@dataclass
class Network:
    """filters[w]: (width, SYMBOLS, FILTERS); bias: (widths, FILTERS); out: (widths * FILTERS + 1, languages)."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray

    def pairs(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width the table of its first two symbols together, and that of the rest."""
        made = []
        for f in self.filters:
            first = (f[0][:, None] + f[1][None]).reshape(-1, FILTERS)
            rest = None if len(f) == 2 else f[2] if len(f) == 3 else (f[2][:, None] + f[3][None]).reshape(-1, FILTERS)
            made.append((first.astype(np.float32), None if rest is None else rest.astype(np.float32)))
        return made


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of every text in rows of WINDOW, and where each text's rows begin, with the end last; empty texts have none."""
    data, offsets = text_buffers(texts)
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-size // WINDOW))])
    rows = np.zeros(first[-1] * WINDOW, np.int64)
    rows[np.repeat(first[:-1] * WINDOW - offsets[:-1], size) + np.arange(len(data))] = _SYMBOL[data]
    return rows.reshape(-1, WINDOW), first


def probabilities(net: Network, rows: np.ndarray, tables=None) -> np.ndarray:
    """One row of language probabilities for each window."""
    tables = tables or net.pairs()
    out = np.zeros((len(rows), len(net.languages)))
    for at in range(0, len(rows), 64):
        own = rows[at : at + 64]
        two = own[:, :-1] * SYMBOLS + own[:, 1:]
        pooled = []
        for width, (first, rest) in zip(WIDTHS, tables):
            n = WINDOW - width + 1
            value = first[two[:, :n]]
            if width == 3:
                value += rest[own[:, 2:]]
            elif width == 4:
                value += rest[two[:, 2:]]
            pooled.append(value.max(axis=1))
        x = np.maximum(np.concatenate(pooled, axis=1) + net.bias.reshape(-1), 0)
        z = x @ net.out[:-1] + net.out[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[at : at + 64] = z / z.sum(axis=1, keepdims=True)
    return out


def slopes(state: list[np.ndarray], own: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of windows and its gradients by state = [*filters, bias, out]; they reach the filters through each pool's largest place."""
    filters, bias, out = state[:-2], state[-2], state[-1]
    pooled, places = [], []
    for w, f in zip(WIDTHS, filters):
        n = WINDOW - w + 1
        value = sum(f[j][own[:, j : j + n]] for j in range(w))
        place = value.argmax(axis=1)
        places.append(place)
        pooled.append(np.take_along_axis(value, place[:, None], axis=1)[:, 0])
    raw = np.concatenate(pooled, axis=1) + bias.reshape(-1)
    x = np.maximum(raw, 0)
    z = x @ out[:-1] + out[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    p = z / z.sum(axis=1, keepdims=True)
    loss = float(-np.log(p[np.arange(len(y)), y]).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    dx = (p @ out[:-1].T) * (raw > 0)
    found = []
    for i, (w, place) in enumerate(zip(WIDTHS, places)):
        g = np.zeros_like(filters[i])
        d = dx[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):
            np.add.at(g[j], (np.take_along_axis(own, place + j, axis=1), np.arange(FILTERS)[None]), d)
        found.append(g)
    return loss, [*found, dx.sum(axis=0).reshape(bias.shape), np.concatenate([x.T @ p, p.sum(axis=0, keepdims=True)])]


def train(rows: np.ndarray, target: np.ndarray, languages: list[str], seed: int = 3) -> Network:
    """Adam on the cross-entropy of windows."""
    draw = np.random.Generator(np.random.PCG64(seed))
    k = len(languages)
    filters = [draw.normal(0, 0.3, (w, SYMBOLS, FILTERS)) for w in WIDTHS]
    bias, out = np.zeros((len(WIDTHS), FILTERS)), np.concatenate([draw.normal(0, 0.2, (len(WIDTHS) * FILTERS, k)), np.zeros((1, k))])
    state = [*filters, bias, out]
    moment, square = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    for t in range(1, STEPS + 1):
        pick = draw.integers(len(rows), size=BATCH)
        _, steepest = slopes(state, rows[pick], target[pick])
        for q, g, m, s in zip(state, steepest, moment, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            q -= RATE * (1 - 0.7 * t / STEPS) * m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Network(languages, filters, bias, out)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from docs(doc_id, text, lang): at most `sample` documents of each language, SAMPLE_WINDOWS windows of each.

    Rows with null text or lang don't count; of rows that repeat doc_id and lang the first text in order does.  None
    where nothing is left to learn from.  The LANGUAGES of the most documents are learned, of TRAINING documents at most in
    all, so what is broadcast and what the driver gets doesn't grow with the number of languages or documents; rarer
    languages are never predicted, nor is one whose texts all are under LEAST bytes.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # about twice as many ids as are wanted pass the threshold of their language's size, so no task ranks a whole language
    sizes = usable.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.desc("n"), "of").limit(LANGUAGES)
    sizes = staged(sizes, "language-sizes")
    sample = min(sample, max(1, TRAINING // max(1, sizes.count())))
    sizes = F.broadcast(sizes)
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = usable.select("doc_id", "lang").join(sizes, F.col("lang") == F.col("of")).where(uniform * F.col("n") < 2 * sample + 20).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(uniform, "doc_id")
    ids = staged(some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("doc_id", "lang"), "language-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches):
            rows, first = windows(part["text"])
            keys, langs, own = [], [], []
            for i, lang in enumerate(part["lang"].to_pylist()):
                n = first[i + 1] - first[i]
                for r in np.unique(np.linspace(0, max(0, n - 2), SAMPLE_WINDOWS).astype(int)) if n else []:
                    row = rows[first[i] + r]
                    if (row > 0).sum() >= LEAST:
                        keys.append(part["doc_id"][i].as_py())
                        langs.append(lang)
                        own.append(row.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(own, pa.binary())], ["doc_id", "lang", "w"])

    texts = usable.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = texts.select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, lang string, w binary").orderBy("doc_id", "lang", "w").collect()
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    rows = np.stack([np.frombuffer(r["w"], np.uint8) for r in got]).astype(np.int64)
    number = {x: i for i, x in enumerate(languages)}
    return train(rows, np.array([number[r["lang"]] for r in got]), languages)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs(doc_id, text), from all windows of the whole text.

    score: the mean probability of the predicted language over the windows, by their bytes.  Null texts and those
    without any letter: 'und' and 0.  Without a network all are 'und'.  Null and repeated doc_ids are predicted row
    by row; an empty table gives no rows; other columns are never read.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        tables = own.pairs() if own else None
        for part in steps(batches):
            n = part.num_rows
            lettered = pc.fill_null(pc.match_substring_regex(part["text"], r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, scores = ["und"] * n, np.zeros(n)
            if own:
                rows, first = windows(part["text"])
                p = probabilities(own, rows, tables) * (rows > 0).sum(axis=1, keepdims=True)
                total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
                mean = total[first[1:]] - total[first[:-1]]
                mean /= np.maximum(mean.sum(axis=1, keepdims=True), 1e-12)
                best = mean.argmax(axis=1)
                names = [own.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
                scores = np.where(lettered, np.clip(np.round(mean[np.arange(n), best], 6), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, net).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score")
