"""SimHash near-duplicates: fingerprints, pivot distance tables, linked components.

The search is exact. Two fingerprints at Hamming distance of 3 or less agree in at least two of
five blocks of bits, so each of the ten pairs of blocks is a bucket key. Inside a bucket, a
table of distances to reference fingerprints (pivots) is computed once for each row; by the
triangle inequality a pair whose coordinates differ by more than the limit anywhere can't be
near and is discarded; survivors are verified bit by bit. Large buckets are cut into chunks, and
each pair of chunks is a group of its own, so that no group grows with the data. A group gives
the edges of a spanning forest of its links, not the links themselves.

Texts of a Jaccard similarity of 0.8 differ in about 10 of 64 bits, too many for these blocks. `similar` takes a wide
fingerprint of their shingle sets, 24 lanes of 64 bits; each of its 96 bands of 16 bits is a bucket key. In a bucket pairs are
discarded by their pivot distances and by the bits of two lanes, and what hangs together is verified by the exact similarity
of the shingle sets. Bands and lanes miss a share of the near pairs (at 0.8 between large sets 0.1 % by the odds, of 2,000 pairs of sets
of four and five shingles 93). So the candidates of ngram_join, among which every near pair is, are verified together with those of the bands, and the
result is that of all pairs. Few pairs of unlike texts are told apart by the pivots at so wide a limit; the lanes do it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, partitions, spare

SEED = 42
#: Widths of the five blocks of the 64 bits, from the low end.
BLOCKS = (13, 13, 13, 13, 12)
PIVOTS = 32
#: Rows of a bucket that one chunk holds on average.
CHUNK = 1024
#: Lanes of a wide fingerprint, bits by which two lanes of near texts may differ (also the pivots' limit),
#: and the least similarity of near texts, as a fraction.
LANES, WIDE_BITS, NEAR = 24, 36, (4, 5)
#: Pivots of a wide search.
WIDE_PIVOTS = 4
#: The most nodes in groups that are sent to all executors, about 50 bytes each; more are joined by merging.
BROADCAST = 500_000

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def simhash64(text: str | None, words_per_shingle: int = 3) -> int:
    """Fingerprint of one text; zero if it has no word. Bits set in more than half of the
    XXH64 values of its word shingles, repeats included; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    w, n = words_per_shingle, len(words)
    if n <= w:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(x) + 1 for x in words])
        begins = np.concatenate(([0], ends[: n - w])).tolist()
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[a:b], SEED) for a, b in zip(begins, (ends[w - 1 :] - 1).tolist(), strict=True)]
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((counts * 2 > len(hashes)).ravel(), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row. Null and empty texts have fingerprint 0."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.fromiter((simhash64(t.as_py(), words_per_shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(batches, "doc_id long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints, fixed by a seed."""
    return np.random.default_rng(7).integers(0, 2**64, count, np.uint64, endpoint=False)


def _keys(fp: Column) -> Column:
    """The ten bucket keys of a fingerprint: number of the pair of blocks, and the blocks' bits."""
    low = np.concatenate(([0], np.cumsum(BLOCKS)))
    block = [F.shiftrightunsigned(fp, int(low[i])).bitwiseAND(F.lit((1 << b) - 1)) for i, b in enumerate(BLOCKS)]
    return F.array(
        *(
            F.shiftleft(block[i], 13).bitwiseOR(block[j]).bitwiseOR(F.lit(c << 26))
            for c, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
        )
    )


def _forest(group: np.ndarray, lanes: np.ndarray, node: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger node, smaller node) of a spanning forest of the links inside each group: pairs whose lanes (one column or
    two of 64 bits) differ by max_bits or less. group is sorted; rows of a group are compared with those k places on, k = 1, 2, ..."""
    n, fp = len(lanes), lanes[:, 0]
    refs = pivots(PIVOTS if max_bits <= 3 else WIDE_PIVOTS)
    table = np.bitwise_count(fp[:, None] ^ refs).astype(np.int8)
    last = np.searchsorted(group, group, side="right")  # end of each row's group
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out: list[tuple[int, int]] = []
    rows = np.arange(n)
    for k in range(1, n):
        rows = rows[rows + k < last[rows]]
        if not len(rows):
            break
        left = rows
        for c in range(0, len(refs), 4):  # coordinates in fours; few pairs get past the first
            near = (np.abs(table[left, c : c + 4] - table[left + k, c : c + 4]) <= max_bits).all(axis=1)
            left = left[near]
            if not len(left):
                break
        left = left[np.bitwise_count(lanes[left] ^ lanes[left + k]).sum(axis=1) <= max_bits]
        for i in left.tolist():
            a, b = root(i), root(i + k)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, i + k))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = node[np.array(out)].T
    return np.maximum(x, y), np.minimum(x, y)


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (u > v) that connect the same components as all pairs of nodes within max_bits.
    nodes: (fp long, node long), each fp once. max_bits may be 0 to 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two of five blocks agree only for distances up to 3")
    return bucket_links(nodes.select(F.explode(_keys(F.col("fp"))).alias("bucket"), "node", "fp"), max_bits)


def bucket_links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Edges (u > v) of spanning forests of the near pairs inside buckets. keyed: (bucket, node long, one or more lanes long)."""
    n, lanes = partitions(keyed.sparkSession), keyed.columns[2:]
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64(*lanes), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    pairs = (
        keyed.hint("merge").join(crowded, "bucket")
        .withColumn("chunks", chunks).withColumn("chunk", chunk)
        .select("bucket", *lanes, "node", "chunk", other)
        .select("bucket", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"), "node", *lanes)
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(group: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
            u, v = _forest(group, np.stack(cols[4:], axis=1).view(np.uint64), cols[3], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        kept: list[np.ndarray] | None = None  # rows of the group that may go on in the next batch
        for b in it:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            if not len(cols[0]):
                continue
            change = np.flatnonzero((np.diff(np.stack(cols[:3])) != 0).any(axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            group = np.zeros(len(cols[0]), np.int64)
            group[change] = 1
            group = np.cumsum(group)
            kept = [c[cut:] for c in cols]
            if cut:
                yield edges(group[:cut], [c[:cut] for c in cols])
        if kept is not None and len(kept[0]):
            yield edges(np.zeros(len(kept[0]), np.int64), kept)

    dealt = pairs.repartition(n, "bucket", "c1", "c2").sortWithinPartitions("bucket", "c1", "c2", *lanes)
    return dealt.mapInArrow(batches, "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (u > v).
    Alternates the large-star and small-star rewirings until nothing changes; each round is
    written to the shared folder. A hub's edges are joined with its minimum, never gathered."""
    edges = materialize(edges, "edges")
    mark = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").hint("merge").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.hint("merge").join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        met = Observation()  # tells the edges apart from those of the last round as they are written
        found = small.select("e.u", "e.v").where("u > v").distinct()
        edges = materialize(found.observe(met, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), "edges")
        now = met.get
        if now == mark:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id) for every row: the smallest doc_id that a chain of links
    reaches, itself included. Texts with equal fingerprints are linked, empty ones too. Rows
    with a null id link nothing: their component_id is null. Repeated ids are kept. Extra
    columns are not carried. An empty table gives no rows."""
    found = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    nodes = materialize(found.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    # A doc_id that heads several fingerprints (repeated ids) links them.
    member = components(links(nodes, max_bits))
    heads = nodes.hint("merge").join(member, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    heads = materialize(heads, "components")
    known = found.hint("merge").join(heads, "fp", "left")
    return known.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The set of a text's word shingles as sorted XXH64 values; A-Z are lower-cased. Fewer words are one shingle; no word: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, joined = len(words), b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if n else [], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in words])
    begins = np.concatenate(([0], ends[: n - size])).tolist()
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(joined[a:b], SEED) for a, b in zip(begins, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64))


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """Lanes of 64 bits of a set of shingles: a bit is 1 if set in over half of its hashes, mixed anew for each lane."""
    counts, odd = np.zeros(LANES * 2048, np.int64), _LANE_MIX
    for a in range(0, len(own), 4096):
        h = own[a : a + 4096, None] * odd
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        counts += np.bincount((h.view(np.uint8).reshape(len(h), -1) + _LANE_BYTES).ravel(), minlength=LANES * 2048)
    ones = counts.reshape(-1, 256).astype(np.float32) @ _BITS.astype(np.float32)
    return np.packbits((ones * 2 > len(own)).ravel(), bitorder="little").view(np.uint64)


_LANE_MIX = np.random.default_rng(13).integers(1, 2**63, LANES, np.uint64) * np.uint64(2) + np.uint64(1)
_LANE_BYTES = (np.arange(LANES * 8) * 256).astype(np.int64)


def similar_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all pairs of sets of a Jaccard similarity of NEAR or more."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(n), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    by_column = np.argsort(column, kind="stable")
    holders, ends = rows[by_column], np.cumsum(np.bincount(column, minlength=len(values)))
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    label, out = np.arange(n), []
    for i in range(n - 1):
        if len(out) == n - 1:
            break
        mine = column[offsets[i] : offsets[i + 1]]
        mine = mine[ends[mine] - begins[mine] > 1]
        if not len(mine):
            continue
        shared = np.bincount(np.concatenate([holders[a:z] for a, z in zip(begins[mine].tolist(), ends[mine].tolist(), strict=True)]), minlength=n)
        near = sum(NEAR) * shared >= NEAR[0] * (sizes[i] + sizes)  # shared / (all - shared) >= the fraction
        near[: i + 1] = False
        for j in np.flatnonzero(near & (label != label[i])).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def groups_of(hangs: DataFrame) -> DataFrame:
    """(node, g, c1, c2): nodes of a component, given as (node, component) without its smallest node, share a group. A component
    of many nodes is cut into chunks, and each pair of its chunks is a group."""
    hangs = materialize(hangs.unionByName(hangs.select(F.col("component").alias("node"), "component").distinct()), "hangs")
    size = hangs.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    rows = hangs.hint("merge").join(size, "component").select("node", F.col("component").alias("g"), chunk.alias("chunk"), other)
    return rows.select("node", "g", F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"))


def similar_links(placed: DataFrame, heads: DataFrame, texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """Edges (u > v) that connect the same components as all near pairs inside groups. placed: (node, g, c1, c2); heads: (node,
    head of doc_id and text_hash); texts: (doc_id, text_hash, text), from which the nodes' whole sets are taken."""
    placed = materialize(placed.hint("merge").join(heads, "node").select("head.doc_id", "head.text_hash", "node", "g", "c1", "c2"), "placed")
    side = placed.hint("broadcast" if placed.count() <= BROADCAST else "merge")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges() -> pa.RecordBatch:
            found = np.array([(group[i], group[j]) for i, j in similar_forest(list(sets.values()))] if len(group) > 1 else [], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found.max(axis=1)), pa.array(found.min(axis=1))], ["u", "v"])

        at, group, sets = None, [], {}
        for b in it:
            keys = list(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True))
            for k, (key, node) in enumerate(zip(keys, b.column(3).to_pylist(), strict=True)):
                if key != at:
                    if len(group) > 1:
                        yield edges()
                    at, group, sets = key, [], {}
                if node not in sets:  # a row may be given more than once
                    group.append(node)
                    sets[node] = shingles(b.column(4)[k].as_py(), words_per_shingle)
        yield edges()

    n = partitions(placed.sparkSession)
    dealt = texts.join(side, ["doc_id", "text_hash"]).select("g", "c1", "c2", "node", "text").repartition(n, "g", "c1", "c2").sortWithinPartitions("g", "c1", "c2", "node")
    return dealt.mapInArrow(batches, "u long, v long").distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """(doc_id, text_hash, component) for every row with an id: rows are in one component if a chain of pairs of a Jaccard similarity
    of NEAR or more over word shingles leads from one to the other. Texts of equal sets are near, null, empty and blank ones
    too. Repeated ids are told apart by text_hash, which is that of the text as given. Extra columns are not carried; an
    empty table gives no rows."""
    from palimpsest.llm import ngram_join  # which imports this module

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def fingerprint(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingles(t.as_py(), words_per_shingle) for t in b.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED) for own in sets], np.uint64).view(np.int64)
            lanes = pa.array([wide_fingerprint(own).tobytes() for own in sets], pa.binary())
            digest, sketch, short = zip(*map(ngram_join.described, sets), strict=True) if sets else ((), (), ())
            more = [pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(short, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), lanes, *more], ["doc_id", "text_hash", "node", "lanes", "n", "digest", "sketch", "short"])

    def bands(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for a in range(0, b.num_rows, 1000):
                lanes = np.frombuffer(b"".join(b.column(1)[a : a + 1000].to_pylist()), np.uint64).reshape(-1, LANES)
                keys = lanes.view(np.uint16).astype(np.int32)
                keys += np.arange(keys.shape[1], dtype=np.int32) << 16
                each = [np.repeat(x, keys.shape[1]) for x in (b.column(0)[a : a + 1000].to_numpy(), lanes[:, 0].view(np.int64), lanes[:, 1].view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), *each)], ["bucket", "node", "a", "b"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = materialize(texts.mapInArrow(fingerprint, f"doc_id {kind}, text_hash long, node long, lanes binary, n long, digest binary, sketch binary, short boolean"), "fingerprints")
    each = [F.min(c).alias(c) for c in ("lanes", "n", "digest", "sketch", "short")]
    nodes = materialize(found.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), *each), "nodes")
    keyed = nodes.select("node", "lanes").mapInArrow(bands, "bucket int, node long, a long, b long")
    edges = materialize(bucket_links(keyed, WIDE_BITS), "edges").unionByName(ngram_join.candidates(texts, nodes, set_of=partial(shingles, size=words_per_shingle)))
    member = components(similar_links(groups_of(components(edges)), nodes.select("node", "head"), texts, words_per_shingle))
    return found.select("doc_id", "text_hash", "node").hint("merge").join(member, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of found (doc_id, text_hash, component), with all columns of docs: that of the smallest id, then of
    the smallest hash of its text. Rows with a null id all stay."""
    own, text, place = spare(docs, "own_id", "own_hash", "place")
    heads = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("h")).select(F.col("h.doc_id").alias(own), F.col("h.text_hash").alias(text))
    heads = materialize(heads, "heads")
    rows = docs.where(F.col(id_col).isNotNull()).withColumns({own: F.col(id_col), text: F.xxhash64(text_col)})
    kept = rows.hint("merge").join(heads, [own, text], "left_semi")
    one = Window.partitionBy(own, text).orderBy(F.xxhash64(*docs.columns))
    kept = kept.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """One row of each component of similar texts, with all columns of docs; rows with a null id link nothing and all stay."""
    return one_of_each(docs, similar(docs, id_col, text_col, words_per_shingle), id_col, text_col)
