"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A window of a few words is the bag of its words' character n-grams (hashed, word ends included).
Their embeddings are averaged and go into a linear softmax; embeddings and softmax are trained
together. A text is as toxic as its worst window, so one insult counts in a long text as well. In
training, a toxic text teaches through the window that looks worst so far, a clean text
through several of its worst ones. Once trained, a softmax over an average is an average of one number
for each n-gram, which is what texts are scored with. Misspellings share n-grams with known words.
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

ORDERS = (3, 4, 5)
TABLE_BITS = 18
DIM = 8
WINDOW = 4
#: Most labelled rows of each label that are learned from, in the order of a hash of their ids, and most bytes of their
#: texts: a text with which all before it would pass the bytes is left out, so that the driver's share is bounded.
TRAIN_ROWS, TRAIN_BYTES = {1: 900, 0: 1500}, 24_000_000

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[*WHITE]] = True


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the window of each, and the first window of each text (with
    the number of windows at the end). A text without a word has no window."""
    a, starts = joined_bytes(texts, lower=True)
    a, starts = np.concatenate((np.full(1, 10, np.uint8), a)), starts + 1  # the first text has a blank before it, too
    white = _IS_WHITE[a]
    a = np.where(white, np.uint8(32), a).astype(np.uint32)
    begins = ~white & np.concatenate(([True], white[:-1]))
    begins_before = np.concatenate(([0], np.cumsum(begins)))
    first_word = begins_before[starts]
    per_text = -(-np.diff(first_word) // WINDOW)
    first_window = np.concatenate(([0], np.cumsum(per_text)))
    text_of_word = np.repeat(np.arange(len(texts)), np.diff(first_word))
    number = np.arange(first_word[-1]) - first_word[text_of_word]
    window_of_word = (first_window[text_of_word] + number // WINDOW).astype(np.int32)
    whites = np.concatenate(([0], np.cumsum(white)))
    codes, owners = [], []
    for n in ORDERS:
        m = len(a) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ a[k : k + m]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        at = np.flatnonzero(whites[n - 1 : n - 1 + m] == whites[1 : m + 1])  # no white space inside
        codes.append((h[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS))
        owners.append(window_of_word[begins_before[at + 2] - 1])
    if not codes:
        return np.empty(0, np.uint32), np.empty(0, np.int32), first_window
    return np.concatenate(codes), np.concatenate(owners), first_window


@dataclass
class Model:
    """weight: what each n-gram adds to the log odds, averaged in a window; the log odds of
    a text are slope * worst window + shift, and `shift_empty` for a text without a word."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    shift_empty: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        codes, owner, first = windows(texts)
        out = np.full(len(texts), self.shift_empty)
        n = int(first[-1])
        if n:
            each = np.bincount(owner, self.weight[codes], n) / np.maximum(np.bincount(owner, minlength=n), 1) + self.bias
            has = np.flatnonzero(np.diff(first))
            out[has] = self.slope * np.maximum.reduceat(each, first[has]) + self.shift
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _worst(each: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """The count worst windows of each text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((-each, text))
    rank = np.arange(len(order)) - first[text[order]]
    return order[rank < count]


def fit(texts: list[str | None], labels: np.ndarray, prevalence: float | None = None, rounds: int = 12, steps: int = 10, seed: int = 3) -> Model:
    """Train embeddings and softmax together. One label alone, or no text, gives a constant model.
    prevalence: share of label 1 among all labelled rows, if texts is a sample balanced by label."""
    y = np.asarray(labels, np.int64)
    size = 1 << TABLE_BITS
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if prevalence is None else float(np.log(max(prevalence, 1e-4) / max(1 - prevalence, 1e-4)))
    # The n-grams stay in pieces of about a million bytes of text, so that no round needs room for all at once.
    chunks, first = [], np.zeros(1, np.int64)
    for a, z in slices([len(t or "") for t in texts], 1_000_000):
        codes, owner, own = windows(texts[a:z])
        chunks.append((codes, owner, int(first[-1]), int(own[-1])))
        first = np.concatenate((first, own[1:] + first[-1]))
    count = int(first[-1])
    if len(set(y.tolist())) < 2 or not count:
        return Model(np.zeros(size, np.float32), 0.0, 0.0, base, base)
    rng = np.random.default_rng(seed)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(first))
    window_y = y[text_of]
    per_window = np.concatenate([np.maximum(np.bincount(owner, minlength=n), 1) for _, owner, _, n in chunks])
    # Start: an n-gram's first coordinate is its log odds of occurring in texts of either label.
    seen = [np.zeros(size), np.zeros(size)]
    for label, text in zip(y, texts, strict=True):
        seen[label][np.unique(windows([text])[0])] += 1
    odds = np.log((seen[1] + 1) / (y.sum() + 2)) - np.log((seen[0] + 1) / (len(y) - y.sum() + 2))
    emb = rng.normal(0, 0.05, (size, DIM)).astype(np.float32)
    emb[:, 0] = np.clip(odds, -2, 2)
    soft = rng.normal(0, 0.05, (DIM, 2)).astype(np.float32)
    soft[0] = [-1, 1]
    bias = np.zeros(2, np.float32)
    sums = [np.full(x.shape, 1e-6, np.float32) for x in (emb, soft, bias)]
    for _ in range(rounds):
        weight = emb @ (soft[:, 1] - soft[:, 0])
        each = np.concatenate([np.bincount(owner, weight[codes], n) for codes, owner, _, n in chunks]) / per_window
        worst = _worst(each, first, 6)
        one = np.zeros(count, bool)
        one[_worst(each, first, 1)] = True
        chosen = worst[(window_y[worst] == 0) | one[worst]]
        place = np.full(count, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        hits = []
        for codes, owner, at, n in chunks:
            spot = place[at : at + n][owner]
            hits.append((spot[spot >= 0], codes[spot >= 0]))
        bag, ids = (np.concatenate(x) for x in zip(*hits, strict=True))
        target = window_y[chosen]
        share = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((target == 0).sum(), 1)).astype(np.float32)
        lengths = per_window[chosen].astype(np.float32)[:, None]
        used = np.unique(ids)
        local = np.searchsorted(used, ids)
        for _ in range(steps):
            rows = emb[used]
            mean = np.stack([np.bincount(bag, rows[local, d], len(chosen)) for d in range(DIM)], 1).astype(np.float32) / lengths
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), target] -= 1
            p *= share[:, None]
            g_mean = (p @ soft.T) / lengths
            g_rows = np.stack([np.bincount(local, g_mean[bag, d], len(used)) for d in range(DIM)], 1).astype(np.float32) + 1e-7 * rows
            grads = [g_rows, mean.T @ p, p.sum(axis=0)]
            sums[0][used] += g_rows**2
            emb[used] -= 0.15 * g_rows / np.sqrt(sums[0][used])
            for k, x in ((1, soft), (2, bias)):
                sums[k] += grads[k] ** 2
                x -= 0.05 * grads[k] / np.sqrt(sums[k])
    weight = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    out = Model(weight, float(bias[1] - bias[0]), 1.0, 0.0, base)
    # Calibrate the worst window's log odds on the same texts, with the labels' true shares.
    x = np.concatenate([out.logits(texts[a:z]) for a, z in slices([len(t or "") for t in texts], 1_000_000)])
    true = float(y.mean()) if prevalence is None else prevalence
    w = np.where(y == 1, true / y.mean(), (1 - true) / (1 - y.mean())) / len(y)
    slope, shift = 1.0, 0.0
    for _ in range(200):
        p = sigmoid(slope * x + shift)
        g, h = w * (p - y), np.maximum(w * p * (1 - p), 1e-9)
        a = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(a, [(g * x).sum() + 1e-3 * slope, g.sum() + 1e-3 * shift])
        slope, shift = slope - 0.5 * step[0], shift - 0.5 * step[1]
    out.slope, out.shift = float(max(slope, 1e-3)), float(shift)
    return out


def learn_from(docs: DataFrame, labels: DataFrame, limits: dict[int, int] | None = None) -> Model:
    """Fit on the texts of docs (doc_id, text) that labels (doc_id, label 0 or 1) covers: at most
    limits[label] rows of each label, by a hash of doc_id, with their whole texts, up to TRAIN_BYTES in all: a text that doesn't fit any
    more is left out and the next ones are tried. Of rows that agree in id one is learned from. An empty table gives a constant
    model."""
    limits = limits or TRAIN_ROWS
    labels = labels.where(F.col("label").isin(0, 1)).select("doc_id", "label").distinct()
    shares = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    chosen = None
    for label, most in limits.items():
        some = labels.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    # Lengths first: at most the rows of limits come to the driver, which takes texts in order as long as they fit, leaving out longer ones.
    sizes = docs.select("doc_id", F.xxhash64("text").alias("own"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    sizes = sizes.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("own", "bytes")).alias("s"))
    sizes = sizes.select("doc_id", "label", "s.own", "s.bytes", F.xxhash64("doc_id").alias("place"))
    left, taken = TRAIN_BYTES, []
    for r in sorted(sizes.collect(), key=lambda r: (r["place"], str(r["doc_id"]), r["label"])):
        if r["bytes"] <= left:
            left -= r["bytes"]
            taken.append((r["doc_id"], r["label"], r["own"]))
    wanted = docs.sparkSession.createDataFrame(taken, sizes.select("doc_id", "label", "own").schema)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own")).join(F.broadcast(wanted), ["doc_id", "own"])
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "label"])
    total = sum(shares.values())
    return fit(rows["text"].to_list(), rows["label"].to_numpy(np.int64), shares.get(1, 0) / total if total else None)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs but the text, plus score (0 to 1) and predicted (1 from the threshold on).
    Null and empty texts, and texts of white space, have the score of the labels' overall odds. Repeated rows are scored alike; a score
    that equals the threshold is predicted 1; an empty table gives no rows. Columns of these names in docs are replaced."""
    kept = [c for c in docs.columns if c not in (text_col, "score", "predicted")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column(len(kept))), 0).to_pylist()
            out = [np.empty(0)]
            for a, z in slices(lengths, 2_000_000):
                out.append(sigmoid(model.logits(b.column(len(kept))[a:z].to_pylist())))
            p = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return docs.select(*kept, text_col).mapInArrow(batches, f"{schema}score double, predicted int")
