"""N-gram Jaccard join: PartEnum signatures of shingle sets, and the components that links connect.

Two sets of n and m shingles, n <= m, whose similarity is 0.8 or more differ in at most (n + m) / 9 shingles, and m <= 5/4 n, so in
at most n // 4. Sets are put into bands of sizes, each four times the one before; a set is in its own band and in that of 5/4 of
its size. In a band the domain of shingles is partitioned by their hashes into groups, and each group into three parts. A
difference of one shingle spoils a group that has shingles in one part alone; a group with more takes two, for after one
difference two of its three parts are still equal. So a group's signatures are the contents of each pair of its parts (empty
ones make no signature), and a set gives those of its groups in order until the groups take more than n // 4 differences to
be spoiled: of two near sets the one that stops first has a group left whose signature both give. A set whose groups
don't suffice is `short`; its candidates are found with groups so fine that each shingle stands alone, which always suffice.

Sets that share a signature are compared by a parity sketch: differing bits never outnumber differing shingles, so pairs with more of
them than near sets may have are discarded. Large groups are cut into chunks and compared in pairs of chunks, and each gives
a spanning forest, not its pairs. What hangs together is then verified by the exact similarity of the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import simhash
from palimpsest.llm.common import materialize, partitions

WORDS = 5
#: Groups of a band for each shingle of its smallest sets, and the least number of groups, so that small sets are seldom short.
GROUPS = (1.1, 64)
#: Sets of a signature that are compared in one chunk; a signature of more is cut.
CHUNK = 1024
#: Lists of sets that a task remembers, so that it hands on equal lists once.
HELD = 200_000
#: The most sets that are sent to all tasks.
BROADCAST = 500_000

_ODD = np.random.default_rng(17).integers(1, 2**63, WORDS + 4, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending: A-Z lower-cased, the whole sequence if it has fewer words, none without a
    word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n)] if n else [], np.uint64)
    hash_of = xxhash.xxh64_intdigest
    w = np.fromiter(map(hash_of, words), np.uint64, n)
    total = np.zeros(n - WORDS + 1, np.uint64)
    for i in range(WORDS):
        total += _mix(w[i : n - WORDS + 1 + i] * _ODD[i])
    return np.unique(_mix(total))


def sketch(own: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in each of at least two bins a shingle, as bits; folded in halves by exclusive or,
    it is that of half the bins."""
    bins = max(64, 1 << int(2 * len(own) - 1).bit_length())
    odd = np.bincount((_mix(own * _ODD[-1]) & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def band_of(n: int) -> int:
    return (n.bit_length() - 1) // 2


def signatures(own: np.ndarray, band: int, groups: tuple[float, int] | None = GROUPS) -> tuple[np.ndarray, bool]:
    """Signatures of a set of four shingles or more in a band, and whether its groups sufficed. groups: as GROUPS, or None for
    groups of one shingle, as good as always."""
    n_groups = max(groups[1], int(groups[0] * 4**band)) if groups else 2**31
    x = _mix(own ^ _ODD[WORDS])
    slot = ((x >> np.uint64(32)) * np.uint64(n_groups) >> np.uint64(32)) * np.uint64(3) + (x & np.uint64(0xFFFF)) % np.uint64(3)
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    new = np.concatenate(([True], slot[1:] != slot[:-1]))
    starts = np.flatnonzero(new)
    content, group = np.add.reduceat(x[order], starts), slot[starts] // np.uint64(3)
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    filled = np.diff(np.concatenate((heads, [len(group)])))
    takes = np.cumsum(np.where(filled == 1, 1, 2))
    need = len(own) // 4 + 1
    last = int(np.searchsorted(takes, need))  # groups before the first with which they take enough
    enough = last < len(heads)
    heads, filled = heads[: last + 1], filled[: last + 1]
    content, group = content[: heads[-1] + filled[-1]], group[: heads[-1] + filled[-1]]
    total, parts = np.add.reduceat(content, heads), np.repeat(filled, filled)
    value = np.where(parts == 3, np.repeat(total, filled) - content, content)
    two = filled == 2
    value, group = np.concatenate((value, total[two])), np.concatenate((group, group[heads[two]]))
    return _mix(value * _ODD[-2] + _mix(group * _ODD[-3] + np.uint64(2 * band + (groups is None)))), enough


def bands_of(n: int) -> list[int]:
    return sorted({band_of(n), band_of(n * 5 // 4)})


def described(own: np.ndarray, groups: tuple[float, int] = GROUPS) -> tuple[bytes, bytes | None, bool]:
    """A set's digest of 128 bits, which stands for it, its sketch, and whether its groups don't suffice (short). Sets of fewer than four
    shingles are near equal ones alone and need neither sketch nor groups."""
    large = len(own) > 3
    short = large and not all(signatures(own, band, groups)[1] for band in bands_of(len(own)))
    return xxhash.xxh3_128_digest(own.tobytes()), sketch(own) if large else None, short


def sets(docs: DataFrame, id_col: str, text_col: str, groups: tuple[float, int] = GROUPS) -> DataFrame:
    """(doc_id, text_hash, n, digest, sketch, short) for each row, written out, the last three as described tells."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = [shingle_set(t.as_py()) for t in b.column(2)]
            digest, drawn, short = zip(*(described(x, groups) for x in own), strict=True) if own else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(map(len, own), pa.int64()), pa.array(digest, pa.binary()), pa.array(drawn, pa.binary()), pa.array(short, pa.bool_())],
                ["doc_id", "text_hash", "n", "digest", "sketch", "short"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(batches, f"doc_id {kind}, text_hash long, n long, digest binary, sketch binary, short boolean"), "sets")


def signed(texts: DataFrame, nodes: DataFrame, groups: tuple[float, int] | None = GROUPS, set_of: Callable[[str | None], np.ndarray] = shingle_set) -> DataFrame:
    """(sig, node): signatures of one text of each node. texts: (doc_id, text_hash, text); nodes: (node, n, digest, head), of four
    shingles or more; set_of gives a text's set."""
    side = nodes.select("head.doc_id", "head.text_hash", "node", "digest")
    side = side.hint("broadcast" if nodes.count() <= BROADCAST else "merge")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for node, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = set_of(text)
                if xxhash.xxh3_128_digest(own.tobytes()) != digest:  # another text of an id and a hash that occur twice
                    continue
                for band in bands_of(len(own)):
                    out.append(signatures(own, band, groups)[0])
                    of.append(np.full(len(out[-1]), node, np.int64))
            sig, node = np.concatenate(out).view(np.int64), np.concatenate(of)
            for a in range(0, len(sig), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + (1 << 16)]), pa.array(node[a : a + (1 << 16)])], ["sig", "node"])

    return texts.join(side, ["doc_id", "text_hash"]).select("node", "digest", "text").mapInArrow(batches, "sig long, node long")


def lists(signed: DataFrame) -> DataFrame:
    """(list, node, size): nodes that share a signature, equal lists once a task or so; written out. size is null in lists of more than
    CHUNK nodes, which pass through without being held."""
    most, remembered = CHUNK, HELD

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def rows(name: int, nodes: np.ndarray, size: int | None) -> pa.RecordBatch:
            n = len(nodes)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, name, np.int64)), pa.array(nodes), pa.array([size] * n, pa.int32())], ["list", "node", "size"])

        def listed(nodes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            name = xxhash.xxh64_intdigest(nodes.tobytes()) - 2**63
            if name not in seen:
                if len(seen) >= remembered:
                    seen.clear()
                seen.add(name)
                yield name, nodes

        def flush(found: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if found:
                sizes = np.array([len(x) for _, x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([k for k, _ in found], np.int64), sizes)), pa.array(np.concatenate([x for _, x in found])), pa.array(np.repeat(sizes, sizes).astype(np.int32))], ["list", "node", "size"])

        sig, held, long = None, np.zeros(0, np.int64), False  # the group that may go on in the next batch
        for b in it:
            keys, nodes = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends = np.concatenate((starts[1:], [len(keys)]))
            many = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys)))
            found: list[tuple[int, np.ndarray]] = []
            for i in many.tolist():
                key, own = int(keys[starts[i]]), nodes[starts[i] : ends[i]]
                if key != sig:
                    if not long and len(held) > 1:
                        found.extend(listed(held))
                    sig, held, long = key, own, False
                elif not long:
                    held = np.unique(np.concatenate((held, own)))
                else:
                    held = own
                if not long:
                    held = np.unique(held)
                    long = len(held) > most
                if long:
                    yield rows(key, held, None)
            yield from flush(found)
        if not long and len(held) > 1:
            yield from flush(list(listed(held)))

    n = partitions(signed.sparkSession)
    dealt = signed.repartition(n, "sig").sortWithinPartitions("sig", "node")
    return materialize(dealt.mapInArrow(batches, "list long, node long, size int"), "lists")


def compared(listed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (u > v) of spanning forests of the pairs in a list whose sizes and sketches don't tell them apart."""
    short = listed.where("size IS NOT NULL").select("list", "node").distinct().withColumn("chunks", F.lit(1))
    long = listed.where("size IS NULL").select("list", "node").distinct()
    long = long.hint("merge").join(long.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "list")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = short.unionByName(long).select("list", "node", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    rows = rows.select("list", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "node", (F.col("chunk") <= F.col("other")).alias("low"))
    rows = rows.hint("merge").join(nodes.select("node", "n", "sketch"), "node").select("list", "c1", "c2", "node", "low", "n", "sketch")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in it:
            found = []
            for list_, c1, c2, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (list_, c1, c2) != at:
                    found.extend(forest(held, at is not None and at[1] != at[2]))
                    at, held = (list_, c1, c2), []
                held.append(row)
            yield _edges(found)
        if held:
            yield _edges(forest(held, at[1] != at[2]))

    n = partitions(nodes.sparkSession)
    dealt = rows.repartition(n, "list", "c1", "c2").sortWithinPartitions("list", "c1", "c2", "node")
    return dealt.mapInArrow(batches, "u long, v long").distinct()


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["u", "v"])


def forest(rows: list[list], across: bool) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of rows (node, low, n, sketch) that may be near; across: only pairs of a low row and
    one that isn't."""
    if len(rows) < 2:
        return []
    rows = sorted(rows, key=lambda r: r[2])
    n = np.array([r[2] for r in rows])
    low = np.array([r[1] for r in rows])
    words = [np.frombuffer(r[3], np.uint64) for r in rows]
    out, label = [], np.arange(len(rows))
    # Rows go by size; those of one width of the sketch, and the next, are compared at the narrower width.
    widths = np.array([len(w) for w in words])
    for width in sorted(set(widths.tolist())):
        own = np.flatnonzero(widths == width)
        others = np.flatnonzero(widths == 2 * width)
        folded = [words[i] for i in own] + [words[i][:width] ^ words[i][width:] for i in others]
        place, table = np.concatenate((own, others)), np.stack(folded)
        size = n[place]
        for i in range(len(own)):
            last = int(np.searchsorted(size, size[i] * 5 // 4, side="right"))
            js = np.arange(i + 1, last)
            js = js[label[place[js]] != label[place[i]]]
            if across:
                js = js[low[place[js]] != low[place[i]]]
            if not len(js):
                continue
            near = np.bitwise_count(table[js] ^ table[i]).sum(axis=1, dtype=np.int64) * 9 <= size[js] + size[i]
            for j in place[js[near]].tolist():
                a, b = int(label[place[i]]), int(label[j])
                if a != b:
                    label[label == b] = a
                    out.append((rows[place[i]][0], rows[j][0]))
    return out


def candidates(texts: DataFrame, nodes: DataFrame, groups: tuple[float, int] = GROUPS, set_of: Callable[[str | None], np.ndarray] = shingle_set) -> DataFrame:
    """Edges (u > v) that connect the two nodes of every near pair, and of others too. texts: (doc_id, text_hash, text); nodes: (node, n,
    digest, sketch, short, head), each set once."""
    large = nodes.where("n > 3")
    shared = lists(signed(texts, large, groups, set_of))
    if not nodes.where("short").isEmpty():
        # Any set near a short one shares a signature of single shingles with it.
        fine = lists(signed(texts, large, None, set_of))
        of_short = fine.hint("merge").join(nodes.where("short").select("node"), "node", "left_semi").select("list").distinct()
        shared = shared.unionByName(fine.hint("merge").join(of_short, "list", "left_semi"))
    return compared(shared, nodes)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[float, int] = GROUPS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: the size of its text's shingle set, and the smallest id that a chain of links
    reaches, itself included.

    Null, empty and blank texts have no shingle and link with nothing. Equal sets are linked, whatever the texts; of repeated rows each
    has its row; rows of an id with other texts are documents that share an id. Rows with a null id link nothing and have a null
    component_id. Other columns are not read, whatever their names; an empty table gives no rows."""
    found = sets(docs, id_col, text_col, groups)
    with_id = found.where("doc_id IS NOT NULL AND n > 0")
    nodes = with_id.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.max("short").alias("short"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    placed = simhash.groups_of(simhash.components(candidates(texts, nodes, groups)))
    member = simhash.components(simhash.similar_links(placed, nodes.select("node", "head"), texts, WORDS))
    member = nodes.select("node", "digest", "head").hint("merge").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = materialize(member.select("digest", "component", "head"), "members")
    least = member.groupBy("component").agg(F.min("head.doc_id").alias("least"))
    of_digest = materialize(member.hint("merge").join(least, "component").select("digest", "least"), "components")
    rows = found.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest"))
    rows = rows.hint("merge").join(of_digest, "digest", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
