"""Document fingerprints: quartile bucket digests.

Byte triplets taken from a sliding window are hashed into buckets and counted; each bucket's code is
the quartile its count falls in. The digest is the length code (two hex digits) and the bucket
codes (two bits each). The difference of two digests is bounded, so likeness runs from 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import partitions

BUCKETS = 512
#: Offsets of the triplets in the window.
TRIPLETS = ((0, 1, 3), (0, 2, 5), (0, 4, 7))
#: Difference a bucket (0 to 3, on average) at which likeness reaches 0, and the weight of the length codes.
FULL = 1.0
LENGTH_WEIGHT = 1 / 64


def quartile_codes(data: bytes) -> np.ndarray:
    """Length code, then the quartile (0 to 3) of each bucket. Fewer bytes than a triplet spans: all 0. The length code stops at 255,
    so texts of about 2.4 MB and more share one."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for salt, (i, j, k) in enumerate(TRIPLETS, 1):
        n = len(a) - k
        if n > 0:
            h = (a[i : i + n] << 16 | a[j : j + n] << 8 | a[k : k + n]) * np.uint32(0x9E3779B1) + np.uint32(salt * 0x7FEB352D & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            counts += np.bincount((h * np.uint32(0x846CA68B)) >> np.uint32(23), minlength=BUCKETS)
    q = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))
    codes = np.zeros(BUCKETS + 1, np.uint8)
    codes[0] = min(255, round(12 * np.log2(len(data) + 1)))
    for at in (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1):
        codes[1:] += counts > q[at]
    return codes


def encode(codes: np.ndarray) -> str:
    body = codes[1:].reshape(-1, 4)
    packed = body[:, 0] << 6 | body[:, 1] << 4 | body[:, 2] << 2 | body[:, 3]
    return f"{codes[0]:02x}{packed.astype(np.uint8).tobytes().hex()}"


def decode(digest: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    body = (raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return np.concatenate((raw[:1], body.ravel()))


def code_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 minus the bounded difference: 1 for equal digests, 0 from the bound on."""
    buckets = np.abs(a[1:].astype(np.int16) - b[1:]).mean() / FULL
    return float(max(0.0, 1.0 - buckets - abs(int(a[0]) - int(b[0])) * LENGTH_WEIGHT))


def fingerprint(text: Column) -> Column:
    """Digest of a text column; null counts as empty."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda t: encode(quartile_codes((t or "").encode("utf-8", "surrogatepass"))))

    return digest(text)


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two columns of digests; null where either is null."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else code_likeness(decode(p), decode(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


def _ordered(docs: DataFrame) -> DataFrame:
    """(part, guest, doc_id, text), dealt out by ranges of doc_id and sorted. The first row of each range
    also goes, as a guest, to the range before it, so that each row's successor is in its task;
    the range before the first is the last. What comes to the driver is one number a range."""
    spark = docs.sparkSession
    n = partitions(spark)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []

    def part_of(s: pd.Series) -> np.ndarray:
        return np.searchsorted(np.array(cuts), s.fillna(-(2**62)).to_numpy(np.float64), side="right")

    @F.pandas_udf("int")
    def part(s: pd.Series) -> pd.Series:
        return pd.Series(part_of(s)).astype("int32")

    low = docs.groupBy(part("doc_id").alias("part")).agg(F.min(F.coalesce("doc_id", F.lit(-(2**62)))).alias("low")).orderBy("part").collect()
    before = {r["low"]: low[i - 1]["part"] for i, r in enumerate(low)}

    @F.pandas_udf("array<int>")
    def places(s: pd.Series) -> pd.Series:
        own = part_of(s)
        ids = s.fillna(-(2**62)).astype("int64")
        return pd.Series([[int(p), before[i]] if i in before else [int(p)] for p, i in zip(own, ids, strict=True)])

    dealt = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("guest", "part"))
    return dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", "text")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last floor(n/4) code points are
    replaced by the first as many (or all) of the next row's text by ascending id; after the
    last row comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty. Null ids come first;
    rows that agree in id are ordered by text. A table of one row follows itself; an empty
    table gives no rows. Extra columns are not carried."""

    def row(doc_id: int | None, text: str, codes: np.ndarray, after: str, after_codes: np.ndarray) -> tuple:
        cut = len(text) // 4
        edited = (text[: len(text) - cut] + after[:cut]).encode("utf-8", "surrogatepass")
        changed = quartile_codes(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), encode(codes), encode(changed), code_likeness(codes, changed), code_likeness(codes, after_codes)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose successor is still to come: part, id, text, codes
        for b in it:
            rows = []
            for part, guest, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = text or ""
                if guest and last is None:
                    continue
                codes = quartile_codes(text.encode("utf-8", "surrogatepass"))
                if last is not None and last[0] == part:
                    rows.append(row(*last[1:], text, codes))
                last = None if guest else (part, doc_id, text, codes)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    rows = _ordered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("part", "guest", "doc_id", "text").mapInArrow(batches, schema)
