"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Tokens (runs of letters, of digits or of one mark) fall into rows by hash, words in capitals into rows of
their own. Each row has a sparse random index vector; a row's word vector is the sum of the index
vectors of its neighbours in all texts. A document is the mean and the spread of its tokens' vectors. A network with one
hidden layer is trained on labelled documents, and its probabilities are calibrated with a temperature on rows that it wasn't
trained on. By the loss on the same rows it is decided whether the network also sees how often a vector returns within a few
places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WHITE, joined_bytes, slices
from palimpsest.llm.toxicity import sigmoid

#: Rows of words (letters that aren't all capitals), and of each other kind: words in capitals, digits, marks.
WORD_ROWS, ROWS_PER_KIND = 65_536, 4096
ROWS = WORD_ROWS + 3 * ROWS_PER_KIND
#: Bytes of text that are counted at a time.
SLICE = 2_000_000
DIM = 32
NONZERO = 4
REACH = 2
#: Places over which tokens that return are counted.
RETURNS = 3
WIDTH = 2 * DIM + 1 + RETURNS
HIDDEN = 32
#: Most labelled rows that are learned from, chosen by a hash of their ids.
TRAIN_ROWS = 8000

_GROUP = np.full(256, 3, np.uint8)
_GROUP[97:123] = _GROUP[65:91] = _GROUP[0x80:] = 1
_GROUP[48:58] = 2
_GROUP[[*WHITE]] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_RANDOM = np.random.default_rng(5)
_BYTE_HASH = _RANDOM.integers(1, 2**63, 256, np.uint64)
_BYTE_HASH[65:91] = _BYTE_HASH[97:123]
_PLACE_HASH = _RANDOM.integers(1, 2**63, 32, np.uint64) | np.uint64(1)
# A copy, as a view would keep the whole order in the driver and in each worker.
_SPOT = np.argsort(_RANDOM.random((ROWS, DIM)), axis=1)[:, :NONZERO].astype(np.int8)
_SIGN = _RANDOM.choice([-1.0, 1.0], (ROWS, NONZERO))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each token of all texts, and the first token of each text (with their number at the end)."""
    a, starts = joined_bytes(texts)
    g = _GROUP[a]
    new = np.empty(len(a), bool)
    new[:1] = True
    new[1:] = (g[1:] != g[:-1]) | ((g[1:] == 3) & (a[1:] != a[:-1]))
    run = np.flatnonzero(new)
    kind = g[run]
    if not len(run):
        return np.empty(0, np.int64), np.zeros(len(starts), np.int64)
    length = np.diff(np.append(run, len(a)))
    place = np.arange(len(a)) - np.repeat(run, length)
    h = np.add.reduceat(_BYTE_HASH[a] * _PLACE_HASH[np.minimum(place, 31)], run)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h >> np.uint64(40)).astype(np.int64)
    capitals = (np.add.reduceat(_UPPER[a], run) == length) & (length > 1)
    other = np.where(kind == 2, length, np.where(kind == 3, a[run].astype(np.int64) * 4 + np.minimum(length, 3), h)) % ROWS_PER_KIND
    rows = np.where((kind == 1) & ~capitals, h % WORD_ROWS, WORD_ROWS + other + ROWS_PER_KIND * np.where(kind == 1, 0, kind.astype(np.int64) - 1))
    keep = kind != 0
    return rows[keep], np.concatenate(([0], np.cumsum(keep)))[np.searchsorted(run, starts)]


def context_sums(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, v0, v1, ...): the sum of the index vectors of each row's neighbours, over all texts. Each
    task adds up a table of fixed size before anything is shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIM)
        for b in it:
            for s, z in slices(_lengths(b.column(0)), SLICE):
                rows, first = tokens(b.column(0)[s:z].to_pylist())
                text = np.repeat(np.arange(z - s, dtype=np.int32), np.diff(first))
                for reach in range(1, REACH + 1):
                    same = np.flatnonzero(text[reach:] == text[:-reach])
                    x, y = rows[same], rows[same + reach]
                    for own, other in ((x, y), (y, x)):
                        for k in range(NONZERO):
                            total += np.bincount(own * DIM + _SPOT[other, k], _SIGN[other, k], ROWS * DIM)
        table = total.reshape(ROWS, DIM)
        used = np.flatnonzero(np.abs(table).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(table[used, d]) for d in range(DIM))], names)

    names = ["row", *(f"v{d}" for d in range(DIM))]
    found = docs.select(text_col).mapInArrow(batches, "row int, " + ", ".join(f"v{d} double" for d in range(DIM)))
    return found.groupBy("row").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM)))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of length 1 (0 for rows that no text has), without their common direction. The
    table has a fixed number of rows, whatever the number of documents."""
    sums = context_sums(docs, text_col).toArrow()
    out = np.zeros((ROWS, DIM))
    found = sums.column("row").to_numpy()
    for d in range(DIM):
        out[found, d] = np.round(sums.column(f"v{d}").to_numpy())
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    found = np.sort(found)
    if len(found):
        out[found] -= out[found].mean(axis=0)
    return out.astype(np.float32)


def features_of(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Means and spreads of the tokens' vectors, the logarithm of their number, and the shares of tokens that have the
    vector of the token one, two, ... places before; without a token zeros."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    rows, first = tokens(texts)
    n = np.diff(first)
    has = np.flatnonzero(n)
    if len(has):
        v = vectors[rows]
        mean = np.add.reduceat(v, first[has], axis=0, dtype=np.float64) / n[has, None]
        square = np.add.reduceat(v * v, first[has], axis=0, dtype=np.float64) / n[has, None]
        text = np.repeat(np.arange(len(texts)), n)
        again = [np.bincount(text[k:][(rows[k:] == rows[:-k]) & (text[k:] == text[:-k])], minlength=len(texts)) for k in range(1, RETURNS + 1)]
        share = np.stack(again, axis=1)[has] / n[has, None]
        out[has] = np.hstack([mean, np.sqrt(np.maximum(square - mean**2, 0)), np.log1p(n[has, None]), share])
    return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x[:, : len(self.center)] - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def _train(x: np.ndarray, y: np.ndarray, epochs: int, decay: float, rng: np.random.Generator) -> Network:
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z, t, width = (x - center) / scale, y.astype(float), x.shape[1]
    params = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(t)), max(1, len(t) // 256)):
            h = np.tanh(z[batch] @ params[0] + params[1])
            g = (sigmoid(h @ params[2] + params[3]) - t[batch]) / len(batch)
            gh = g[:, None] * params[2] * (1 - h * h)
            grads = [z[batch].T @ gh + decay * params[0], gh.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            step += 1
            for k, gr in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                params[k] -= 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(center, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 30, decay: float = 1e-3, seed: int = 9) -> Network:
    """Train on four fifths of the rows, once with and once without the shares of returning tokens (the last RETURNS features);
    the rest of the rows, by their loss at the best temperature, choose between the two. Fewer than ten rows or one label
    alone give a constant."""
    rng = np.random.default_rng(seed)
    width = x.shape[1] if x.ndim == 2 and x.size else WIDTH
    if len(y) < 10 or len(set(y.tolist())) < 2:
        odds = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), odds, 1.0)
    order = rng.permutation(len(y))
    rest, train = order[: len(y) // 5], order[len(y) // 5 :]
    ways = []
    for columns in (width - RETURNS, width):
        net = _train(x[train, :columns], y[train], epochs, decay, np.random.default_rng(seed))
        own, truth = net.logits(x[rest]), y[rest]

        def loss(temperature: float, own: np.ndarray = own, truth: np.ndarray = truth) -> float:
            p = np.clip(sigmoid(own / temperature), 1e-9, 1 - 1e-9)
            return float(-(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean())

        net.temperature = min(np.geomspace(0.25, 8, 101).tolist(), key=loss)
        ways.append((loss(net.temperature), columns, net))
    return min(ways, key=lambda w: w[:2])[2]


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, text_col: str = "text", limit: int = TRAIN_ROWS) -> Network:
    """Fit on the texts of docs (doc_id, text) that at most limit rows of labels (doc_id, label 0 or 1) cover, chosen by
    a hash of doc_id. Only their features come to the driver."""
    chosen = labels.where(F.col("label").isin(0, 1)).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    rows = docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a, z in slices(_lengths(b.column(1)), 1_000_000):
                x = features_of(b.column(1)[a:z].to_pylist(), vectors)
                features = pa.ListArray.from_arrays(np.arange(z - a + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], b.column(2)[a:z], features], ["doc_id", "label", "features"])

    found = rows.select("doc_id", "text", F.col("label").cast("int")).mapInArrow(batches, "doc_id long, label int, features array<float>")
    # Of rows that agree in id one is learned from.
    found = found.groupBy("doc_id", "label").agg(F.min("features").alias("features")).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x = found.column("features").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    return fit(x.astype(np.float64), found.column("label").to_numpy().astype(np.int64))


def _lengths(texts: pa.Array) -> list[int]:
    return pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()


def score(docs: DataFrame, net: Network, vectors: np.ndarray, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs plus score (0 to 1) and predicted (1 from the threshold on). Every row is scored, null
    and empty texts as texts without a token, repeated rows alike; a score that equals the threshold is predicted 1, and an
    empty table gives no rows. Columns of these names in docs are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    spot = kept.index(text_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a, z in slices(_lengths(b.column(spot)), 1_000_000):
                part = b.slice(a, z - a)
                p = net.probability(features_of(part.column(spot).to_pylist(), vectors).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return docs.select(*kept).mapInArrow(batches, f"{schema}score double, predicted int")
