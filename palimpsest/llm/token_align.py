"""Cross-tokenizer alignment: two tokenizations of a text meet where tokens of both end at the same byte.

The ends of both are sorted lists. The shorter one drives a galloping search: from where the end before it (of a block, for
many at once) came to lie in the longer list, steps double until they are past the end sought, and a binary search finds its
rank between. Ends found in both lists cut the tokens into groups; the ranks of a token's begin and end are the range of
tokens of the other list that overlap it.

Neither tokenizer has a token across a space between two visible characters of ASCII, so a text is encoded in segments cut there,
and a worker encodes equal segments once.

The links of a document, as distinct pairs of ids and how often each occurs, are written packed beside its other results, so texts
are encoded once. How many documents hold a pair is counted from there, each task adding up what it reads first. Pairs are
sent to all tasks from the most frequent on, at most SENT of them; the documents' other pairs are joined with their counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm.common import materialize, partitions, slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: The most pairs of ids whose counts are sent to all tasks, 17 bytes each.
SENT = 2_000_000
#: Distinct pairs that a task holds before it hands on what it counted.
HELD = 2_000_000
#: Segments that a worker may hold when it begins a run of texts.
MET = 700_000
#: Bytes of text that are encoded at a time.
SLICE = 3 << 20
#: Ends between two that are searched for from the begin of the list.
BLOCK = 64

#: A space before which A begins a token and B a piece, whatever stands around.
_CUT = re.compile("(?<=[!-~]) (?=[!-~])")

_kept: dict[str, Segments] = {}


def byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible characters of Latin-1 stand for themselves, the other
    bytes, in order, for the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Tokenizers:
    """Both tokenizers, as they are sent to tasks, and the bytes of their entries by id."""

    a_json: str
    b_model: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    name: str = field(init=False)

    def __post_init__(self) -> None:
        self.name = hashlib.sha256(self.a_json.encode() + self.b_model).hexdigest()

    def opened(self) -> Segments:
        """Once a worker."""
        if self.name not in _kept:
            _kept[self.name] = Segments(self)
        return _kept[self.name]


def load(a_path: str = BYTE_BPE, b_path: str = PIECES) -> Tokenizers:
    """Read both on the driver; their size is that of the vocabularies."""
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    a, to_byte = Tokenizer.from_str(a_json), byte_level()
    special = {t["content"] for t in json.loads(a_json).get("added_tokens", [])}
    a_bytes = [b""] * a.get_vocab_size()
    for token, i in a.get_vocab().items():
        a_bytes[i] = token.encode() if token in special else bytes(to_byte[c] for c in token)
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for i in range(b.vocab_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokenizers(a_json, b.serialized_model_proto(), a_bytes, b_bytes)


def ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each number of short, how many of long are less. Both are ascending."""
    out = np.zeros(len(short), np.int64)
    if len(short):
        out[::BLOCK] = _gallop(short[::BLOCK], long, np.zeros(-(-len(short) // BLOCK), np.int64))
        out = _gallop(short, long, np.repeat(out[::BLOCK], BLOCK)[: len(short)])
    return out


def _gallop(sought: np.ndarray, long: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The ranks of sought in long, none of which is below its begin."""
    n = len(long)
    low, high = begin.copy(), begin.copy()  # the rank is in low..high once found is past it
    step, live = 1, np.flatnonzero(low < n)
    live = live[long[low[live]] < sought[live]]
    while len(live):  # long[low] < sought
        ahead = np.minimum(low[live] + step, n)
        high[live] = ahead
        inside = ahead < n
        less = np.zeros(len(live), bool)
        less[inside] = long[ahead[inside]] < sought[live[inside]]
        live = live[less]
        low[live] = high[live]
        step *= 2
    live = np.flatnonzero(high - low > 1)
    while len(live):  # long[low] < sought <= long[high]
        middle = (low[live] + high[live]) >> 1
        less = long[middle] < sought[live]
        low[live[less]] = middle[less]
        high[live[~less]] = middle[~less]
        live = live[high[live] - low[live] > 1]
    return high


def overlaps(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From ascending ends of two tokenizations of the same bytes: places (in short, in long) of ends in both, and of each pair of
    tokens whose bytes overlap."""
    rank = ranks(short, long)
    equal = long[rank] == short  # the last ends are equal, so every rank is a place
    first = np.concatenate(([0], rank[:-1] + equal[:-1]))
    count = rank - first + 1
    left = np.repeat(np.arange(len(short)), count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + first[left]
    common = np.flatnonzero(equal)
    return common, rank[common], left, right


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as bytes, those of equal weight together, which suits compression."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1).T.copy().view("<u8").ravel().astype(np.int64)


@dataclass
class Aligned:
    """Results of a run of texts: a row each, with the keys of its distinct pairs (id of A times the size of B, plus id of B), ascending,
    and how often each occurs."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sha: list[str]
    keys: list[np.ndarray]
    times: list[np.ndarray]


class Encoded:
    """Ids of segments by one tokenizer: all of them in one array, where each segment's begin and end, and whether they give it back."""

    def __init__(self, table: list[bytes]) -> None:
        self.table, self.ids, self.cuts, self.sound = table, np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)

    def add(self, ids: list[list[int]], wanted: list[bytes]) -> None:
        ends = self.cuts[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        sound = [b"".join([self.table[t] for t in x]) == w for x, w in zip(ids, wanted, strict=True)]
        self.ids = np.concatenate((self.ids, np.array(list(chain.from_iterable(ids)), np.int64)))
        self.cuts, self.sound = np.concatenate((self.cuts, ends)), np.concatenate((self.sound, np.array(sound, bool)))

    def of_texts(self, segment: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has) of texts that are segments in a row, text telling whose each is."""
        sizes = np.diff(self.cuts)[segment]
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.cuts[segment] - (np.cumsum(sizes) - sizes), sizes)]
        return ids, np.bincount(text, sizes, texts).astype(np.int64)


class Segments:
    """The segments that a worker has met lately, and their ids by both tokenizers."""

    def __init__(self, known: Tokenizers) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(known.a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=known.b_model)
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # the next number
        self.sides = Encoded(self.known.a_bytes), Encoded(self.known.b_bytes)

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
        """Places of the texts that both tokenizers give back, and for each tokenizer their ids and how many each text has."""
        if len(self.number) > MET:
            self.clear()
        number, met = self.number, len(self.number)
        of_text = [list(map(number.__getitem__, _CUT.split(t))) if t else [] for t in texts]
        new = list(islice(number, met, None))
        if new:
            spaced = [" " + s for s in new]
            wanted = [s.encode() for s in spaced]
            batch = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
            self.sides[0].add([e.ids for e in batch(spaced, add_special_tokens=False)], wanted)
            self.sides[1].add(self.b.encode(new, num_threads=1), wanted)
        sizes = np.fromiter(map(len, of_text), np.int64, len(texts))
        segment = np.fromiter(chain.from_iterable(of_text), np.int64, sizes.sum())
        text = np.repeat(np.arange(len(texts)), sizes)
        faults = np.bincount(text, ~(self.sides[0].sound & self.sides[1].sound)[segment], len(texts))
        fine = (sizes > 0) & (faults == 0)
        keep = fine[text]
        text = (np.cumsum(fine) - 1)[text[keep]]
        return np.flatnonzero(fine).tolist(), [side.of_texts(segment[keep], text, int(fine.sum())) for side in self.sides]


def align(texts: list[str | None], known: Tokenizers) -> Aligned:
    n, size_b = len(texts), len(known.b_bytes)
    sound, encoded = known.opened().encode(texts)
    n_a, n_b, n_groups, n_links = (np.zeros(n, np.int64) for _ in range(4))
    out = Aligned(n_a, n_b, n_groups, n_links, [""] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n)
    if not sound:
        return out
    place = np.array(sound)
    sides = []
    for (ids, counts), table in zip(encoded, (known.a_bytes, known.b_bytes), strict=True):
        lengths = np.array(list(map(len, table)), np.int64)
        sides.append((counts, ids, np.cumsum(lengths[ids]), np.repeat(np.arange(len(sound)), counts)))
    (count_a, id_a, end_a, doc_a), (count_b, id_b, end_b, doc_b) = sides
    n_a[place], n_b[place] = count_a, count_b
    last_a, last_b = np.zeros(len(id_a), bool), np.zeros(len(id_b), bool)
    links = []
    # Ends run on from text to text, alike on both sides, so all texts whose list of A is the shorter are one search, and the others another.
    for a_drives in (True, False):
        texts_now = (count_a <= count_b) == a_drives
        at_a, at_b = np.flatnonzero(texts_now[doc_a]), np.flatnonzero(texts_now[doc_b])
        if not len(at_a):
            continue
        if a_drives:
            i, j, left, right = overlaps(end_a[at_a], end_b[at_b])
        else:
            j, i, right, left = overlaps(end_b[at_b], end_a[at_a])
        last_a[at_a[i]] = last_b[at_b[j]] = True
        links.append((at_a[left], at_b[right]))
    left, right = (np.concatenate(x) for x in zip(*links, strict=True))
    n_groups[place] = np.bincount(doc_a, last_a, len(sound)).astype(np.int64)
    n_links[place] = np.bincount(doc_a[left], minlength=len(sound))
    span = len(known.a_bytes) * size_b
    key, times = np.unique(doc_a[left] * span + id_a[left] * size_b + id_b[right], return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(sound) + 1) * span)
    # Groups are written A tokens first; a token's place in that order follows from the tokens of the other side before it.
    group_ends_a, group_ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    place_a = np.arange(len(id_a)) + np.concatenate(([0], group_ends_b[:-1]))[np.cumsum(last_a) - last_a]
    place_b = np.arange(len(id_b)) + group_ends_a[np.cumsum(last_b) - last_b]
    written = np.empty(len(id_a) + len(id_b), object)
    inner, end_of_a, end_of_b = _written(max(len(known.a_bytes), size_b))
    written[place_a] = np.where(last_a, end_of_a[id_a], inner[id_a])
    written[place_b] = np.where(last_b, end_of_b[id_b], inner[id_b])
    cut = np.concatenate(([0], np.cumsum(count_a + count_b))).tolist()
    for k, i in enumerate(place.tolist()):
        out.sha[i] = hashlib.sha256(b"".join(written[cut[k] : cut[k + 1]].tolist())[:-1]).hexdigest()
        out.keys[i], out.times[i] = key[cuts[k] : cuts[k + 1]] - k * span, times[cuts[k] : cuts[k + 1]]
    return out


_decimals: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _written(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in decimal with what follows them inside a group's list, after its A tokens, and after its B tokens."""
    if size not in _decimals:
        _decimals[size] = tuple(np.array([b"%d%c" % (i, mark) for i in range(size)], object) for mark in b",|;")
    return _decimals[size]


def aligned(docs: DataFrame, known: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys binary, times binary) for each row, written out."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i, j in slices(pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist(), SLICE):
                s = b.slice(i, j - i)
                x = align(s.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links, x.sha)), pa.array(map(pack, x.keys), pa.binary()), pa.array(map(pack, x.times), pa.binary())],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "times"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(batches, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"), "aligned")


def pair_counts(found: DataFrame) -> DataFrame:
    """(key, n): how many rows of (keys) hold each pair."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

        key = n = np.zeros(0, np.int64)
        for b in it:
            new, times = np.unique(np.concatenate([np.zeros(0, np.int64), *map(unpack, b.column(0).to_pylist())]), return_counts=True)
            both, inverse = np.unique(np.concatenate([key, new]), return_inverse=True)
            key, n = both, np.bincount(inverse, np.concatenate([n, times]), len(both)).astype(np.int64)
            if len(key) > HELD:
                yield rows()
                key = n = np.zeros(0, np.int64)
        yield rows()

    counted = found.select("keys").mapInArrow(batches, "key long, n long")
    return counted.repartition(partitions(found.sparkSession), "key").groupBy("key").agg(F.sum("n").alias("n"))


def best_pairs(counts: DataFrame, size_b: int) -> DataFrame:
    """(key, n, best): whether no pair of the same A id is in more rows. One row an A id is sent to all tasks."""
    a = F.expr(f"key div {size_b}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, known: Tokenizers, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row. Null and empty texts, and those that either
    tokenizer doesn't give back byte by byte, have no tokens: zeros and ''. Repeated rows and ids stay and count once each; a null id
    is an id. Other columns are not read, whatever their names; an empty table gives no rows."""
    spark = docs.sparkSession
    found = aligned(docs, known, id_col, text_col)
    counts = materialize(best_pairs(materialize(pair_counts(found), "pairs"), len(known.b_bytes)), "pairs")
    # Pairs that as many rows hold as 2 ** power or more are sent, with the least power for which they are few enough.
    power, total = 64, 0
    for r in sorted(counts.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("power")).count().collect(), key=lambda r: -r["power"]):
        total += r["count"]
        if total > SENT:
            break
        power = r["power"]
    frequent = counts.where(F.floor(F.log2("n") + 1e-9) >= power)
    few = frequent.toArrow().sort_by("key") if power < 64 else counts.limit(0).toArrow()
    sent = spark.sparkContext.broadcast(tuple(few.column(c).to_numpy() for c in ("key", "n", "best")))
    kind = found.schema["doc_id"].dataType.simpleString()

    def held(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = sent.value[0]
        at = np.minimum(np.searchsorted(own, keys), max(len(own) - 1, 0))
        return at, (own[at] == keys if len(own) else np.zeros(len(keys), bool))

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = sent.value
        for b in it:
            n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, (keys, times) in enumerate(zip(b.column(7).to_pylist(), b.column(8).to_pylist(), strict=True)):
                keys, times = unpack(keys), unpack(times)
                at, met = held(keys)
                n_best[i], count_sum[i] = (times[met] * best[at[met]]).sum(), (times[met] * n[at[met]]).sum()
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(n_best), pa.array(count_sum)], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    def others(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row, keys, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, times = unpack(keys), unpack(times)
                rare = ~held(keys)[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rare.sum(), row, np.int64)), pa.array(keys[rare]), pa.array(times[rare])], ["row", "key", "times"])

    rows = found.mapInArrow(summed, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if total > SENT:
        rest = found.select("row", "keys", "times").mapInArrow(others, "row long, key long, times long")
        rest = rest.join(counts.where(F.floor(F.log2("n") + 1e-9) < power).hint("merge"), "key")
        more = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        rows = rows.join(more.hint("merge"), "row", "left")
        rows = rows.withColumns({"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
