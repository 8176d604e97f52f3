"""Language identification with hyperdimensional profiles.

Each letter has a random +1/-1 vector. A letter trigram's vector binds (multiplies) the letters'
vectors, the first rolled by two places and the second by one; a text's vector bundles (adds)
those of its trigrams. A language's prototype bundles its training texts, each scaled to its number
of trigrams, and a document gets the language whose prototype has the largest cosine with it.
A prototype is a sum over trigram counts, so training is one count by language and trigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices

DIM = 1024
#: Letter classes: 0 is whatever is not a letter, 1 to 26 are a to z, the rest share other letters.
CLASSES = 64


@lru_cache(1)
def _letter_of() -> np.ndarray:
    """Class of each code point; letters beyond the basic plane share one."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([cp for cp in range(0x110000) if chr(cp).isalpha()], np.int64)
    out[letters] = 27 + letters * 2654435761 % 2**32 % (CLASSES - 27)
    out[letters[letters > 0xFFFF]] = CLASSES - 1
    out[97:123] = np.arange(1, 27)
    return out


def trigrams(text: str | None) -> np.ndarray:
    """Codes of a text's letter trigrams; words are framed by one non-letter. No letter: none."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letter_of()[points]
    c = np.concatenate((np.zeros(1, np.uint8), c, np.zeros(1, np.uint8))).astype(np.int32)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]  # runs of non-letters count once
    if len(c) < 3:
        return np.empty(0, np.int32)
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """The bound vectors of trigram codes, one in each row."""
    letters = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (CLASSES, dim))
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    return first[codes // CLASSES**2] * second[codes // CLASSES % CLASSES] * letters[codes % CLASSES]


def trigram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, code, n): trigrams of all texts whose language is given. At most CLASSES^3 codes
    a language, added up in each batch before they are shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            totals: dict[str, np.ndarray] = {}
            for a, z in slices([1] * b.num_rows, 512):
                codes: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(b.column(0)[a:z].to_pylist(), b.column(1)[a:z].to_pylist(), strict=True):
                    codes.setdefault(lang, []).append(trigrams(text))
                for lang, some in codes.items():
                    total = totals.setdefault(lang, np.zeros(CLASSES**3, np.int64))
                    total += np.bincount(np.concatenate(some), minlength=CLASSES**3)
            for lang, total in totals.items():
                known = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), pa.array(known.astype(np.int32)), pa.array(total[known])], ["lang", "code", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(batches, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, one row each, of length 1. The counts come to the
    driver: their number is bounded by languages x trigram codes, not by documents."""
    counts = trigram_counts(docs, text_col, lang_col).toArrow()
    langs, rows = sorted(pc.unique(counts.column("lang")).to_pylist()), []
    for lang in langs:
        part = counts.filter(pc.equal(counts.column("lang"), lang))
        n, codes = part.column("n").to_numpy().astype(np.float64), part.column("code").to_numpy()
        total = np.zeros(dim)
        for a in range(0, len(n), 1024):
            total += n[a : a + 1024] @ vectors(codes[a : a + 1024], dim)
        rows.append(total / max(np.linalg.norm(total), 1e-12))
    return langs, np.array(rows, np.float32).reshape(len(rows), dim)


def identify(docs: DataFrame, profiles: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs plus lang_pred and score (cosine, cut to 0..1). Null texts and texts
    without a letter, and all texts if no language was learned, get `und` and 0. Ties go to the
    language that sorts first. Columns of these names in docs are replaced."""
    langs, proto = profiles
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    spot = names.index(text_col)
    dim = proto.shape[1] if len(langs) else DIM

    def judge(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes = [trigrams(t) for t in texts]
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        sizes = np.array([len(c) for c in codes])
        if not langs or not sizes.sum():
            return pred.tolist(), score
        used = np.zeros(CLASSES**3, bool)
        for c in codes:
            used[c] = True
        place = np.cumsum(used) - 1
        known = np.flatnonzero(used)
        flat = np.repeat(np.arange(len(texts)), sizes) * len(known) + place[np.concatenate(codes)]
        counts = np.bincount(flat, minlength=len(texts) * len(known)).reshape(len(texts), -1).astype(np.float32)
        docs_v = np.zeros((len(texts), dim), np.float32)
        for a in range(0, len(known), 2048):  # vectors of a few trigrams at a time
            docs_v += counts[:, a : a + 2048] @ vectors(known[a : a + 2048], dim)
        cos = (docs_v @ proto.T) / np.maximum(np.linalg.norm(docs_v, axis=1, keepdims=True), 1e-12)
        best = cos.argmax(axis=1)
        has = sizes > 0
        pred[has] = np.array(langs, object)[best[has]]
        score[has] = np.clip(cos[np.arange(len(texts)), best][has], 0, 1)
        return pred.tolist(), score

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a, z in slices([1] * b.num_rows, 256):
                part = b.slice(a, z - a)
                pred, score = judge(part.column(spot).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(batches, f"{schema}, lang_pred string, score double")
