"""SentencePiece encoding and decoding over a relational lattice of pieces.

Texts are cut into words where no piece can go across: before a blank (written as the lower block mark), and between
characters that stand beside each other in no piece. The distinct words of all texts are one table. Their substrings of
bounded length are exploded and joined by equality to the piece table; the matches, grouped by word, are the edges of its
lattice, and a fold over them (a higher-order aggregate) gives the word's pieces: for a BPE table the merge of the adjacent
pair of best score until none is left (leftmost on ties), whose result a path of best score isn't; for a unigram table
the Viterbi path. Characters without a piece become byte pieces.

Texts are numbered by words once: a task writes them in chunks of about CHUNK bytes, a word being its place among the common
words (at most COMMON, sent to all tasks) or among those of its chunk that aren't common. Each distinct word is folded once;
ids of words that aren't common come to their chunks by joins. Words beyond LONG characters have the same lattice; their merges are
folded with a heap in Arrow tasks, as the aggregate takes a word's length squared.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import materialize, partitions, shared_dir, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: The most words whose ids are sent to all tasks; rarer ones are joined.
COMMON = 500_000
#: Characters of a word from which its merges are folded with a heap, and of the parts that longer words are exploded in.
LONG, PART = 40, 256
#: Edges are numbers: (begin * SPAN + length) << BITS | number, number being a piece's place by score. Numbers from CHARS on
#: are single characters, by code point.
SPAN_BITS, BITS, CHARS = 6, 22, 1 << 21
SPAN = 1 << SPAN_BITS
#: Words that a task counts before it hands on those that it met often enough, FREQUENT times or more.
HELD, FREQUENT = 600_000, 3
#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK = 2 << 20

_kept: dict[str, object] = {}


@dataclass
class Pieces:
    """The piece table: id and score of each piece, ids of the byte pieces, and the fold to use. words is a regular
    expression of the words of a text; order has the pieces by score, the best first, ties the places of equal scores, late
    the places of those that merges reach after a piece that isn't better."""

    table: dict[str, tuple[int, float]]
    byte_ids: list[int]
    as_bytes: list[bytes]
    fold: str = "merge"
    longest: int = field(init=False)
    words: str = field(init=False)
    order: list[str] = field(init=False)
    ties: list[tuple[int, int]] = field(init=False)
    late: list[int] = field(init=False)

    def __post_init__(self) -> None:
        if any(BLANK in p.lstrip(BLANK) for p in self.table):
            raise ValueError("a piece goes across a blank")
        self.longest = max(map(len, self.table), default=1)
        self.order = sorted(self.table, key=lambda p: (-self.table[p][1], self.table[p][0]))
        if self.longest >= SPAN or len(self.order) >= CHARS:
            raise ValueError("pieces too long or too many")
        scores = [self.table[p][1] for p in self.order]
        begins = [i for i in range(len(scores)) if not i or scores[i] != scores[i - 1]]
        self.ties = [(a, z) for a, z in zip(begins, [*begins[1:], len(scores)], strict=True) if z - a > 1]
        if self.fold == "merge" and len(self.ties) > 16:
            raise ValueError("too many pieces of equal score")
        self.late = late_pieces(self.order, self.ties) if self.fold == "merge" else []
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                group[c] = c = group[group[c]]
            return c

        for p in self.table:
            for a, b in zip(p, p[1:]):
                if a != BLANK:
                    group[root(a)] = root(b)
        runs: dict[str, list[str]] = {}
        for c in group:
            runs.setdefault(root(c), []).append(c)
        runs.pop(BLANK, None)
        classes = "".join(f"[{re.escape(''.join(sorted(cs)))}]+|" for cs in sorted(runs.values(), key=lambda cs: (-len(cs), cs)))
        self.words = f"{BLANK}*(?:{classes}[^{BLANK}])|{BLANK}+"


def late_pieces(order: list[str], ties: list[tuple[int, int]]) -> list[int]:
    """Places of the pieces whose last merge, where their own text is merged, isn't behind all merges before it. In a word
    that holds none of them, merges come in the order of rank: what a merge makes possible is behind it."""
    rank = {p: i for i, p in enumerate(order)} | {order[i]: a for a, z in ties for i in range(a, z)}
    late = []
    for number, p in enumerate(order):
        edges = {(a, z): rank[p[a:z]] for a in range(len(p)) for z in range(a + 2, len(p) + 1) if p[a:z] in rank}
        merged: list[int] = []
        if len(p) > 2 and len(heap_merge(len(p), edges, merged)) == 1 and max(merged[:-1]) >= merged[-1]:
            late.append(number)
    return late


def fold_of(model: bytes) -> str:
    """The fold of a serialized model, by the model_type (field 3) of its trainer_spec (field 2); without one it is unigram."""

    def number(data: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0
        while at < len(data):
            tag, at = number(data, at)
            if tag & 7 == 0:
                value, at = number(data, at)
            else:
                size, at = number(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
                value, at = data[at : at + size], at + size
            yield tag >> 3, value

    kind = 1
    for spec in (x for k, x in fields(model) if k == 2):
        kind = next((x for k, x in fields(spec) if k == 3), kind)
    if kind not in (1, 2):
        raise ValueError("neither a unigram nor a BPE model")
    return "viterbi" if kind == 1 else "merge"


def load(path: str = MODEL) -> Pieces:
    """Read a model's piece table on the driver; its size is that of the vocabulary."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    table, byte_ids, as_bytes = {}, [0] * 256, []
    for i in range(m.vocab_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            as_bytes.append(bytes([value]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            as_bytes.append(b"")
        else:
            table[piece] = (i, m.get_score(i))
            as_bytes.append(piece.replace(BLANK, " ").encode())
    return Pieces(table, byte_ids, as_bytes, fold_of(m.serialized_model_proto()))


def name_of(word: str) -> str:
    """What a word is joined by: itself, or for a long one the digest of its bytes after a NUL, which begins no word of more
    than one character."""
    return word if len(word) <= LONG else "\0" + hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()


def cut(text: str, find: Callable[[str], list[str]]) -> list[str]:
    """Words of a text, with a blank before it as the model has it."""
    return find(BLANK + text.replace(" ", BLANK))


def frequent_words(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """(name, word, n): words that a task met FREQUENT times, from all texts; word is null where the name is the word. n tells
    which words are worth sending to all tasks and nothing else, so rarer words of a task needn't be dealt out for it."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pieces.words, re.S).findall
        counts: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            words = [w for w, n in counts.items() if n >= FREQUENT]
            names = list(map(name_of, words))
            own = [None if w == x else w for w, x in zip(words, names, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(own, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["name", "word", "n"])
            counts.clear()
            return out

        for b in it:
            for text in b.column(0):
                if text.is_valid:
                    counts.update(cut(text.as_py(), find))
                    if len(counts) > HELD:
                        yield rows()
        yield rows()

    found = docs.where(F.length(text_col) > 0).select(text_col).mapInArrow(batches, "name string, word string, n long")
    return found.repartition(partitions(docs.sparkSession), "name").groupBy("name").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, number, score). The empty piece stands for itself in every word, so that words without a piece stay."""
    rows = [("", -1, 0.0), *((p, number, pieces.table[p][1]) for number, p in enumerate(pieces.order))]
    return spark.createDataFrame(pa.table([pa.array(c) for c in zip(*rows, strict=True)], ["piece", "number", "score"]))


def lattice(words: DataFrame, pieces: Pieces, known: DataFrame | None = None) -> DataFrame:
    """(name, n, size, edges): those substrings of a word of (name, word, n) that are pieces, as edges; for a unigram table
    structs of edge and score. Merges need none of single characters. Words stay where they are; what is sent to all tasks
    is the vocabulary. known is its written piece_table, or else one is made."""
    word = F.coalesce("word", "name")
    size = F.length(word)
    parts = words.select("name", "n", size.alias("size"), word.alias("word"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(PART))).alias("base"))
    parts = parts.select("name", "n", "size", "base", F.expr(f"substring(word, base + 1, {PART + pieces.longest})").alias("part"))
    begins = parts.select("*", F.explode(F.expr(f"sequence(0, least({PART}, size - base) - 1)")).alias("i"))
    shortest = 2 if pieces.fold == "merge" else 1
    lengths = F.expr(f"case when size - base - i >= {shortest} then sequence({shortest}, least({pieces.longest}, size - base - i)) else array() end")
    spans = begins.select("*", F.explode(F.when(F.col("base") + F.col("i") == 0, F.concat(F.array(F.lit(0)), lengths)).otherwise(lengths)).alias("k"))
    spans = spans.select("name", "n", "size", (F.col("base") + F.col("i")).cast("long").alias("i"), "k", F.expr("substring(part, i + 1, k)").alias("piece"))
    found = spans.join(F.broadcast(piece_table(words.sparkSession, pieces) if known is None else known), "piece")
    edge = F.when(F.col("k") > 0, F.shiftleft(F.col("i") * SPAN + F.col("k"), BITS).bitwiseOR(F.col("number")))
    if pieces.fold != "merge":
        edge = F.when(edge.isNotNull(), F.struct(edge.alias("edge"), "score"))
    # Grouping sorts the edges: a hash ahead of the name spares comparing names, most of which begin alike.
    groups = found.groupBy(F.xxhash64("name").alias("hash"), "name")
    return groups.agg(F.min("n").alias("n"), F.min("size").alias("size"), F.collect_list(edge).alias("edges")).drop("hash")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once. A column of a projection below would be put into a lambda as an expression
    and worked out at each of its calls."""
    return F.get(F.transform(F.array(value), body), 0)


def _of(keys: Column, values: Column, begin: Column, end: Column) -> Column:
    """The value of an edge, null if there is none."""
    return F.get(values, (F.array_position(keys, end + begin * (SPAN - 1)) - 1).cast("int"))


def fold_merge(keys: Column, numbers: Column, ties: list[tuple[int, int]]) -> Column:
    """Ends of the spans of a word, 0 first: adjacent spans are merged along edges, best score first, leftmost on ties."""

    def step(ends: Column, _: Column) -> Column:
        def without(best: Column) -> Column:
            k = (best % SPAN).cast("int")
            return F.when(best.isNull(), ends).otherwise(F.concat(F.slice(ends, F.lit(1), k), F.slice(ends, k + 2, F.size(ends))))

        joined = F.transform(F.sequence(F.lit(1), F.size(ends) - 2), lambda k: _of(keys, ranks, F.get(ends, k - 1), F.get(ends, k + 1)) * SPAN + k)
        return _let(F.array_min(F.when(F.size(ends) > 2, joined)), without)

    def fold(given: Column) -> Column:
        nonlocal ranks
        ranks = given
        return F.aggregate(times, F.sequence(F.lit(0).cast("long"), F.col("size").cast("long")), step)

    ranks = numbers
    times = F.when(F.col("size") > 1, F.sequence(F.lit(2), "size")).otherwise(F.array().cast("array<int>"))
    return _let(F.transform(numbers, lambda x: _rank(x, ties)), fold)


def fold_in_order(edges: Column, ties: list[tuple[int, int]]) -> Column:
    """What fold_merge gives for words of at most LONG characters without late pieces: there the edges need to be gone through
    only once, by rank and place. Bit i of the state is set where a span ends at i or begins there."""

    one = F.lit(1).cast("long")

    def step(bounds: Column, edge: Column) -> Column:
        begin = F.shiftright(edge, SPAN_BITS).bitwiseAND(F.lit(SPAN - 1)).cast("int")
        k = edge.bitwiseAND(F.lit(SPAN - 1)).cast("int")

        def merged(window: Column) -> Column:
            # Its ends are bounds, and there is one more between them.
            pair = (F.bit_count(window) == 3) & (window.bitwiseAND(one) == one) & (window >= F.call_function("shiftleft", one, k))
            mid = window - F.call_function("shiftleft", one, k) - 1
            return F.when(pair, bounds - F.call_function("shiftleft", mid, begin)).otherwise(bounds)

        window = F.call_function("shiftright", bounds, begin).bitwiseAND(F.call_function("shiftleft", F.lit(2).cast("long"), k) - 1)
        return _let(window, merged)

    ranked = F.transform(edges, lambda e: F.shiftleft(_rank(e.bitwiseAND(F.lit((1 << BITS) - 1)), ties), 2 * SPAN_BITS).bitwiseOR(F.shiftright(e, BITS)))
    start = F.call_function("shiftleft", F.lit(2).cast("long"), F.col("size")) - 1
    ends = F.sequence(F.lit(0).cast("long"), F.col("size").cast("long"))
    return _let(F.aggregate(F.sort_array(ranked), start, step), lambda bounds: F.filter(ends, lambda i: F.call_function("shiftright", bounds, i.cast("int")).bitwiseAND(one) == one))


def _rank(number: Column, ties: list[tuple[int, int]]) -> Column:
    """The place of the first of the pieces of equal score."""
    for a, z in ties:
        number = F.when((number >= a) & (number < z), F.lit(a).cast("long")).otherwise(number)
    return number


def fold_viterbi(keys: Column, scores: Column, longest: int, unknown: float) -> Column:
    """Ends of the spans of the path of the best sum of scores, 0 first. A character without a piece is an edge of its own."""

    def step(nodes: Column, j: Column) -> Column:
        def come(k: Column) -> Column:
            own = _of(keys, scores, j - k, j)
            s = F.when(k == 1, F.coalesce(own, F.lit(unknown))).otherwise(own)
            return F.struct((F.get(nodes, (j - k).cast("int"))["best"] + s).alias("best"), (j - k).alias("back"))

        ways = F.transform(F.sequence(F.lit(1).cast("long"), F.least(j, F.lit(longest).cast("long"))), come)
        return F.concat(nodes, F.array(F.array_max(F.filter(ways, lambda x: x["best"].isNotNull()))))

    def path(nodes: Column) -> Column:
        def back(ends: Column, _: Column) -> Column:
            return F.when(F.get(ends, 0) == 0, ends).otherwise(F.concat(F.array(F.get(nodes, F.get(ends, 0).cast("int"))["back"]), ends))

        return F.aggregate(F.sequence(F.lit(1), "size"), F.array(F.col("size").cast("long")), back)

    start = F.array(F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("back"))).cast("array<struct<best:double,back:bigint>>")
    return _let(F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("size").cast("long")), start, step), path)


def _numbers(ends: Column, keys: Column, numbers: Column) -> Column:
    """Numbers of the spans between ends."""

    def one(k: Column) -> Column:
        begin, end = F.get(ends, k - 1), F.get(ends, k)
        char = CHARS + F.ascii(F.substring("name", begin.cast("int") + 1, F.lit(1)))
        return F.when(end - begin == 1, char).otherwise(_of(keys, numbers, begin, end)).cast("int")

    return F.transform(F.sequence(F.lit(1), F.size(ends) - 1), one)


def heap_merge(n: int, edges: dict[tuple[int, int], int], merged: list[int] | None = None) -> list[tuple[int, int]]:
    """Spans of a word of n characters, merged along edges ((begin, end) to rank): best rank first, leftmost on ties. merged
    gets the ranks of the merges, one by one."""
    after, before = list(range(1, n + 1)), list(range(-1, n))  # ends of spans; begin of the span before
    live = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := edges.get((i, i + 2))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, mid, end = heapq.heappop(heap)
        if not live[i] or after[i] != mid or mid >= n or not live[mid] or after[mid] != end:
            continue
        live[mid] = False
        if merged is not None:
            merged.append(r)
        after[i] = end
        if end < n:
            before[end] = i
            if (r := edges.get((i, after[end]))) is not None:
                heapq.heappush(heap, (r, i, end, after[end]))
        if (p := before[i]) >= 0 and (r := edges.get((p, end))) is not None:
            heapq.heappush(heap, (r, p, i, end))
    return [(i, after[i]) for i in range(n) if live[i]]


def _fold_long(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """(name, n, numbers) of long words of (name, n, size, edges, word)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {x: a for a, z in pieces.ties for x in range(a, z)}
        for b in it:
            for at in range(b.num_rows):
                word, edges = b.column(2)[at].as_py(), b.column(3)[at].values.to_numpy()
                begin, size, number = (edges >> BITS) // SPAN, (edges >> BITS) % SPAN, edges & ((1 << BITS) - 1)
                found = dict(zip(zip(begin.tolist(), (begin + size).tolist()), number.tolist()))
                spans = heap_merge(len(word), {s: rank.get(x, x) for s, x in found.items()})
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 1], b.column(1)[at : at + 1], pa.array([[CHARS + ord(word[a]) if z - a == 1 else found[a, z] for a, z in spans]], pa.list_(pa.int32()))], ["name", "n", "numbers"])

    return rows.select("name", "n", "word", "edges").mapInArrow(batches, "name string, n long, numbers array<int>")


def encode_words(words: DataFrame, pieces: Pieces, long: bool | None = None, known: DataFrame | None = None) -> list[DataFrame]:
    """(name, n, numbers) of words (name, word, n), each once: short words, and long ones where they are folded apart. long
    tells that all words are short or all long, known is as in lattice. Words that are dealt out by name stay so."""
    merge, unknown = pieces.fold == "merge", min((s for _, s in pieces.table.values()), default=0.0) - 10.0
    edges = F.col("edges") if merge else F.col("edges.edge")

    def numbers_of(keys: Column) -> Column:
        def given(numbers: Column) -> Column:
            if merge:
                # Ties count only between pieces that such a word can hold.
                late = set(pieces.late)
                ties = [(a, z) for a, z in pieces.ties if sum(len(pieces.order[i]) > 1 and i not in late for i in range(a, z)) > 1]
                ends = fold_in_order(edges, ties)
                if pieces.late:
                    ends = F.when(F.exists(numbers, lambda x: x.isin(pieces.late)), fold_merge(keys, numbers, pieces.ties)).otherwise(ends)
            else:
                ends = fold_viterbi(keys, F.col("edges.score"), pieces.longest, unknown)
            return _let(ends, lambda x: _numbers(x, keys, numbers))

        return _let(F.transform(edges, lambda e: e.bitwiseAND(F.lit((1 << BITS) - 1))), given)

    folded = _let(F.transform(edges, lambda e: F.shiftright(e, BITS)), numbers_of).alias("numbers")
    if not merge:
        return [lattice(words, pieces, known).select("name", "n", folded)]
    out = []
    if not long:
        out.append(lattice(words.where("word IS NULL"), pieces, known).select("name", "n", folded))
    if long is not False:
        apart = words.where("word IS NOT NULL")
        out.append(_fold_long(lattice(apart, pieces, known).hint("merge").join(apart.select("name", "word"), "name"), pieces))
    return out


def common_words(docs: DataFrame, pieces: Pieces, most: int, text_col: str = "text", known: DataFrame | None = None) -> Broadcast:
    """Names and numbers of at most `most` words, as an Arrow stream for all tasks, the most frequent first."""
    counts = materialize(frequent_words(docs, pieces, text_col), "frequent-words")
    # Steps of a thousandth beyond ten thousand, so that few counts come to the driver and the last step taken is known to fit.
    step = F.when(F.col("n") <= 10_000, F.col("n")).otherwise(10_001 + F.floor(F.log(F.col("n") / 10_000) / math.log(1.001)))
    total, least = 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    chosen = counts.where(F.lit(False) if least is None else step >= least).repartition(partitions(docs.sparkSession), "name")
    tables = [x.toArrow() for x in encode_words(chosen, pieces, known=known)]
    table = pa.concat_tables([x.cast(tables[0].schema) for x in tables]).sort_by([("n", "descending"), ("name", "ascending")])
    table = table.select(["name", "numbers"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return docs.sparkSession.sparkContext.broadcast(sink.getvalue())


def _plain_ids(pieces: Pieces) -> np.ndarray:
    """Id of each number, -1 for characters that are no piece."""
    out = np.full(CHARS + 0x110000, -1, np.int32)
    out[: len(pieces.order)] = [pieces.table[p][0] for p in pieces.order]
    for p, (i, _) in pieces.table.items():
        if len(p) == 1:
            out[CHARS + ord(p)] = i
    return out


def ids_of(numbers: np.ndarray, offsets: np.ndarray, pieces: Pieces, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the numbers of words that begin at offsets, and where the ids of each begin; characters that are no piece give
    the ids of their bytes."""
    found = plain[numbers]
    odd = found < 0
    if not odd.any():
        return found, offsets
    spelt = [[pieces.byte_ids[v] for v in chr(x - CHARS).encode("utf-8", "surrogatepass")] for x in numbers[odd].tolist()]
    sizes = np.ones(len(found), np.int64)
    sizes[odd] = list(map(len, spelt))
    ids = np.repeat(found, sizes)
    ids[np.repeat(odd, sizes)] = np.concatenate(spelt)
    return ids, np.concatenate(([0], np.cumsum(sizes)))[offsets]


def _of_common(common: Broadcast, what: str, make: Callable[[pa.Table], object]) -> object:
    """What is made of the common words; a worker keeps what it had last."""
    tag = what + hashlib.md5(common.value).hexdigest()
    if tag not in _kept:
        _kept.clear()
        _kept[tag] = make(pa.ipc.open_stream(common.value).read_all())
    return _kept[tag]


class Places(dict):
    """Places of the common words by name. Other words get -1, -2 and so on when they are first asked for."""

    def __init__(self, names: list[str]) -> None:
        super().__init__(zip(names, range(len(names)), strict=True))
        self.others: list[str] = []
        self.alike: list[str] = []

    def __missing__(self, word: str) -> int:
        if (name := name_of(word)) != word and name in self:
            self.alike.append(word)
            place = self[name]
        else:
            self.others.append(word)
            place = -len(self.others)
        self[word] = place
        return place

    def forget(self) -> None:
        for word in (*self.others, *self.alike):
            del self[word]
        self.others, self.alike = [], []


def chunks(rows: DataFrame, pieces: Pieces, common: Broadcast, check: bool) -> DataFrame:
    """(chunk, rows, places, names, words) of rows whose last column is the text: the other columns of a chunk's texts, the number
    of words of each and, with check, the digest of what it should decode to; places of their words, packed; and names
    of the words that aren't common, with the word where it isn't the name. Numbers of chunks hold for one run: write the result."""
    kept = rows.schema.fields[:-1]
    more = [T.StructField("size", T.IntegerType())] + [T.StructField("sha", T.BinaryType())] * check
    text = T.ArrayType(T.StringType())
    schema = T.StructType().add("chunk", "long").add("rows", T.ArrayType(T.StructType([*kept, *more]))).add("places", "binary").add("names", text).add("words", text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pack = re.compile(pieces.words, re.S).findall, zstandard.ZstdCompressor(level=3).compress
        places = _of_common(common, "places", lambda t: Places(t.column("name").to_pylist()))
        places.forget()
        number = TaskContext.get().partitionId() << 32
        for b in it:
            for a, z in slices([n or 0 for n in pc.binary_length(b.column(len(kept))).to_pylist()], CHUNK):
                part, words, sizes, shas = b.slice(a, z - a), [], [], []
                for t in part.column(len(kept)).to_pylist():
                    found = cut(t, find) if t else []
                    words += found
                    sizes.append(len(found))
                    if check:
                        shas.append(hashlib.sha256((t or "").replace(BLANK, " ").encode("utf-8", "surrogatepass")).digest())
                own = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                names = list(map(name_of, places.others))
                full = [None if w == x else w for w, x in zip(places.others, names, strict=True)]
                places.forget()
                columns = [*part.columns[:-1], pa.array(sizes, pa.int32()), *([pa.array(shas, pa.binary())] if check else [])]
                held = pa.StructArray.from_arrays(columns, [f.name for f in (*kept, *more)])
                # Bytes of equal weight lie together, which packs better.
                packed = pack(own.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())
                lists = [pa.array([x], pa.list_(pa.string())) for x in (names, full)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays([0, len(held)], held), pa.array([packed], pa.binary()), *lists], schema.names)
                number += 1

    return rows.mapInArrow(batches, schema)


def patches(texts: DataFrame, pieces: Pieces, known: DataFrame | None = None) -> DataFrame:
    """(chunk, patch): for each word of a chunk that isn't common, its place and then its numbers."""
    n = partitions(texts.sparkSession)
    used = texts.select("chunk", F.posexplode(F.arrays_zip("names", "words")).alias("at", "x")).select("chunk", "at", "x.names", "x.words").toDF("chunk", "at", "name", "word")
    found = None
    for long in (False, True):
        here = used.where("word IS NOT NULL" if long else "word IS NULL")
        words = here.select("name", *["word"] * long).repartition(n, "name").groupBy("name").agg(*[F.min("word").alias("word")] * long, F.lit(0).cast("long").alias("n"))
        if not long:
            words = words.withColumn("word", F.lit(None).cast("string"))
        for coded in encode_words(words, pieces, long, known):
            rows = here.select("chunk", "at", "name").repartition(n, "name").hint("merge").join(coded, "name")
            rows = rows.select("chunk", F.concat(F.array("at"), "numbers").alias("numbers"))
            found = rows if found is None else found.unionByName(rows)
    return found.groupBy("chunk").agg(F.collect_list("numbers").alias("patch"))


def by_chunk(texts: DataFrame) -> DataFrame:
    """texts, written to the shared folder in buckets of their chunks: a join by chunk deals out the other side alone. The catalog
    has the table only until it is read here; the files stay."""
    spark = texts.sparkSession
    name = f"palimpsest_chunks_{uuid.uuid4().hex}"
    writer = texts.write.format("parquet").bucketBy(partitions(spark), "chunk").option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """Text of ids: pieces and bytes joined, without the blank before the text."""
    text = b"".join(map(pieces.as_bytes.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", check: bool = False, common: int = COMMON) -> DataFrame:
    """All columns of docs but the text, plus ids (array of int); null and empty texts have no ids. With check, the ids
    are decoded at once, and decoded_sha256 and exact (decoding gives the text, with the
    lower block mark as a blank) are added. Columns of these names in docs are replaced. Repeated rows all stay. common is the
    most words whose ids are sent to all tasks: it decides how ids come to the texts, not which."""
    kept = [c for c in docs.columns if c not in (text_col, "ids", "decoded_sha256", "exact")]
    inner = [f"c{i}" for i in range(len(kept))]  # names of its own, whatever those of docs are
    # Written once: otherwise the driver holds the vocabulary's rows in each plan that joins them.
    known = materialize(piece_table(docs.sparkSession, pieces), "pieces")
    sent = common_words(docs, pieces, common, text_col, known)
    rows = docs.select(*(F.col(f"`{c}`").alias(i) for i, c in zip(inner, kept, strict=True)), F.col(f"`{text_col}`").alias("text"))
    texts = by_chunk(chunks(rows, pieces, sent, check))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, plain = zstandard.ZstdDecompressor().decompress, _plain_ids(pieces)

        def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
            """Ids of lists of numbers, and where those of each begin."""
            offsets = lists.offsets.to_numpy()
            return ids_of(lists.flatten().to_numpy(), offsets - offsets[0], pieces, plain)

        ids, begins = _of_common(sent, "ids", lambda t: flat(t.column("numbers").combine_chunks()))
        n = len(begins) - 1
        for b in it:
            for at in range(b.num_rows):
                held, patch = b.column(0).slice(at, 1).flatten(), b.column(2).slice(at, 1).flatten()
                places = np.frombuffer(unpack(b.column(1)[at].as_py()), np.uint8).reshape(4, -1).T.copy().view("<i4")[:, 0].astype(np.int64)
                columns = dict(zip((f.name for f in held.type), held.flatten(), strict=True))
                values, starts, sizes = ids, begins[:-1].astype(np.int64), np.diff(begins)
                if len(patch):
                    heads, cells = patch.offsets.to_numpy() - patch.offsets[0].as_py(), patch.flatten().to_numpy()
                    order = np.empty(len(patch), np.int64)
                    order[cells[heads[:-1]]] = np.arange(len(patch))
                    other, ends = ids_of(np.delete(cells, heads[:-1]), heads - np.arange(len(heads)), pieces, plain)
                    values = np.concatenate((ids, other))
                    starts = np.concatenate((starts, len(ids) + ends[:-1][order]))
                    sizes = np.concatenate((sizes, np.diff(ends)[order]))
                places[places < 0] = n - 1 - places[places < 0]
                length = sizes[places]
                word_ends = np.concatenate(([0], np.cumsum(length)))
                coded = values[np.repeat(starts[places] - word_ends[:-1], length) + np.arange(word_ends[-1])]
                ends = word_ends[np.concatenate(([0], np.cumsum(columns["size"].to_numpy())))]
                more = []
                if check:
                    cells = coded.tolist()
                    back = [hashlib.sha256(decode_ids(cells[a:z], pieces).encode("utf-8", "surrogatepass")) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    same = [x.digest() == y for x, y in zip(back, columns["sha"].to_pylist(), strict=True)]
                    more = [pa.array([x.hexdigest() for x in back], pa.string()), pa.array(same, pa.bool_())]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(coded, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(columns[c] for c in inner), lists, *more], names)

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if check:
        schema = schema.add("decoded_sha256", "string").add("exact", "boolean")
    names = schema.names
    joined = texts.select("chunk", "rows", "places").hint("merge").join(patches(texts, pieces, known), "chunk", "left")
    out = joined.select("rows", "places", "patch").mapInArrow(batches, schema)
    return out.select(*(F.col(i).alias(c) for i, c in zip(inner, kept, strict=True)), *out.columns[len(kept) :])


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of rows plus the decoded text; null ids give an empty text."""
    kept = [c for c in rows.columns if c != text_col]
    spot = kept.index(ids_col)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a, z in slices([1] * b.num_rows, 500):
                part = b.slice(a, z - a)
                texts = [decode_ids(x or [], pieces) for x in part.column(spot).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*kept, text_col])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*kept).schema)
    return rows.select(*kept).mapInArrow(batches, f"{schema}`{text_col}` string")
