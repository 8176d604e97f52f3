"""Quality rules: base counts, and divergence from language references.

References are histograms of character classes and of common words, one pair for each language,
counted over all documents. A document is measured by its Jensen-Shannon distance to each language's
pair; the nearest counts. Short documents are not judged by their histograms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import WHITE, materialize, slices

#: Words that make up at least this share of a language's words are its common words: at most 1 / SHARE each.
SHARE = 0.002
#: Least code points in words, and least words, for the two histograms to count.
MIN_CHARS, MIN_WORDS = 40, 20
#: Distances (0 to 1) from which a document is not kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.5

#: Character classes of bytes: lower case, upper case, digit, sentence marks, other marks, white space, beyond ASCII.
CLASS_NAMES = ("lower", "upper", "digit", "sentence", "mark", "white", "beyond")
_CLASS = np.full(256, 4, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[0xC0:] = 0, 1, 2, 6
_CLASS[[*b".,;:'-"]] = 3
_CLASS[[*WHITE]] = 5
_IS_CLASS = (_CLASS[:, None] == np.arange(len(CLASS_NAMES))).astype(np.int64)
_IS_CLASS[0x80:0xC0] = 0  # bytes that go on with a character
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[[*b"#*$%&|<>"]] = 1
_BLANK = WHITE.decode()


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words in windows of width words that occur twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, width):
        span = int(ids.max()) + 1
        if int(key.max()) > (2**62) // span:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * span + ids[k : n + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    mark = np.zeros(n + width, np.int64)
    hits = np.flatnonzero(counts[inverse] > 1)
    np.add.at(mark, hits, 1)
    np.add.at(mark, hits + width, -1)
    return int((np.cumsum(mark) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _plain(word: bytes) -> bytes:
    """A word as it is looked up: A-Z lower-cased, sentence marks at its ends removed."""
    return word.strip(b".,;:!?\"'()").lower()


def reference_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, kind, item, n): kind `class` for character classes, `word` for words, over all texts whose
    language is given. Counted in each task first; counters are handed on when they are large."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            out = [(lang, "word", w.decode("utf-8", "replace"), n) for lang, c in words.items() for w, n in c.items()]
            out += [(lang, "class", CLASS_NAMES[i], int(n)) for lang, h in classes.items() for i, n in enumerate(h) if n]
            words.clear()
            classes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "kind", "item", "n"])

        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for b in it:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if not data:
                    continue
                raw = Counter(data.split())
                own = words.setdefault(lang, Counter())
                for w, n in raw.items():
                    own[_plain(w)] += n
                classes[lang] = classes.get(lang, 0) + np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _IS_CLASS
                if sum(map(len, words.values())) > 300_000:
                    yield rows()
        if classes:
            yield rows()

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.mapInArrow(batches, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


class References:
    """Reference histograms: for each language the shares of the character classes, and of the common
    words of any language with all other words last."""

    def __init__(self, counts: DataFrame, share: float = SHARE) -> None:
        counts = materialize(counts, "reference-counts")
        totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
        self.langs = sorted({lang for lang, _ in totals})
        least = {lang: max(1, share * totals.get((lang, "word"), 0)) for lang in self.langs}
        limit = F.lit(None).cast("double")
        for lang, n in least.items():
            limit = F.when(F.col("lang") == lang, F.lit(float(n))).otherwise(limit)
        # At most 1 / share words a language, by the definition of a common word.
        common = [(r["lang"], r["item"], r["n"]) for r in counts.where((F.col("kind") == "word") & (F.col("n") >= limit)).collect()]
        known = sorted({w for _, w, _ in common if w})
        self.place = {w.encode(): i for i, w in enumerate(known)}
        self.classes = np.zeros((len(self.langs), len(CLASS_NAMES)))
        for r in counts.where("kind = 'class'").collect():
            self.classes[self.langs.index(r["lang"]), CLASS_NAMES.index(r["item"])] = r["n"]
        self.words = np.zeros((len(self.langs), len(known) + 1))
        for r in counts.where((F.col("kind") == "word") & F.col("item").isin(known)).collect() if known else []:
            self.words[self.langs.index(r["lang"]), self.place[r["item"].encode()]] = r["n"]
        for i, lang in enumerate(self.langs):
            self.words[i, -1] = totals.get((lang, "word"), 0) - self.words[i].sum()
        self.classes /= np.maximum(self.classes.sum(axis=1, keepdims=True), 1)
        self.words /= np.maximum(self.words.sum(axis=1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence, base 2) of p to each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def measure(docs: DataFrame, refs: References, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance (both
    null under the minimum length or without references), base_failed, kept. Null texts have no
    words and fail the base rules. Every row gives one row, repeated rows equal ones, an empty table none; of languages
    at an equal distance none is preferred, as only the distance counts. Extra columns are not carried."""

    def judge(doc_id: int | None, text: str) -> tuple:
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        classes = hist @ _IS_CLASS
        n, chars = len(words), len(text) - int(classes[5])
        repeat = repeated_words(ids)
        failed = n < 10 or 100 * repeat > 20 * n
        by_char = by_word = None
        if len(refs.langs) and chars >= MIN_CHARS:
            near = js_distance(classes / classes.sum(), refs.classes)
            by_char = float(near.min())
            if n >= MIN_WORDS:
                get, other = refs.place.get, len(refs.place)
                spot = np.array([get(_plain(w), other) for w in seen], np.int64)
                shares = np.bincount(spot[ids], minlength=other + 1) / n
                by_word = float(js_distance(shares, refs.words).min())
        kept = not failed and (by_char is None or by_char < MAX_CHAR_DISTANCE) and (by_word is None or by_word < MAX_WORD_DISTANCE)
        return doc_id, n, chars, int(hist @ _SYMBOLS), duplicate_lines(text), repeat, by_char, by_word, failed, kept

    kinds = [*[pa.int64()] * 6, pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a, z in slices([1] * b.num_rows, 1000):
                rows = [judge(i, t or "") for i, t in zip(b.column(0)[a:z].to_pylist(), b.column(1)[a:z].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(batches, schema)
