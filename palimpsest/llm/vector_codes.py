"""Vector code compression: integer k-means of the parts of vectors, with norm-of-sum bounds.

Components are made integers, vectors are cut into equal parts, and the parts at a position share a codebook. A round assigns
each part to its nearest entry and then moves the entries to the means of their parts. The entries of a codebook stand in
groups. For each part and group a row keeps a lower bound of the distance to the group's entries, its own entry left out, and
the round in which the bound was exact (its stamp). All codebooks so far are retained, so a later round lowers the bound by
the net displacement of the entries between the stamp's round and now, the norm of the sum of their moves; that is at most
the sum of the norms, by which bounds that drift round by round are lowered. The distance to the own entry is worked out
anew, and only groups whose bound isn't above it are scanned again. Distances are whole numbers and exact; bounds are rounded
down, so that ties are always scanned.

Rows with their bounds are written to the shared folder each round, and the round before is deleted then. To the driver come
the first vectors and, each round, the sums of each entry: both bounded by the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import forget, materialize, partitions

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Groups of entries of a codebook, with a bound each.
GROUPS = 8
#: The most labels whose sums are sent to all tasks, and the shares into which a label's rows are dealt beyond that.
BROADCAST, SALT = 500_000, 32

_BOUND = np.dtype([("low", "<f4"), ("stamp", "u1")])


def groups_of(entries: int) -> list[tuple[int, int]]:
    """Begin and end of each group of entries."""
    cuts = np.linspace(0, entries, min(GROUPS, entries) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:]))


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all c; exact, as all numbers stay below the limits that codes() checks."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def _down(squares: np.ndarray) -> np.ndarray:
    """Lower bounds of the roots, as 32-bit numbers."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-1))


def first_scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, squared distances, bounds) of parts x in the first round."""
    d2 = _squared(x, entries)
    code, rows = d2.argmin(axis=1), np.arange(len(x))
    best = d2[rows, code]
    rest = d2.astype(np.float64)
    rest[rows, code] = np.inf
    bounds = np.zeros((len(x), len(groups_of(len(entries)))), _BOUND)
    for g, (a, z) in enumerate(groups_of(len(entries))):
        bounds["low"][:, g] = _down(rest[:, a:z].min(axis=1))
    return code, best, bounds


def next_scan(x: np.ndarray, history: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, squared distances, bounds, scanned pairs of row and group) for the last codebook of history (round, entry, component),
    from the codes and bounds of the round before."""
    now, entries, rows = len(history) - 1, history[-1], np.arange(len(x))
    cuts = groups_of(len(entries))
    moves = (history[:-1] - entries).astype(np.float64)
    net = np.sqrt((moves * moves).sum(axis=2))
    net = np.stack([net[:, a:z].max(axis=1) for a, z in cuts], axis=1) * (1 + 1e-12)
    own = entries[code]
    best = ((x - own) * (x - own)).sum(axis=1)
    old, old_best, code = code, best.copy(), code.copy()
    reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-12)
    left = bounds["low"] - net[bounds["stamp"], np.arange(len(cuts))]
    scan = left <= reach[:, None]
    seen = []
    for g, (a, z) in enumerate(cuts):
        at = np.flatnonzero(scan[:, g])
        if not len(at):
            continue
        d2 = _squared(x[at], entries[a:z])
        first = d2.argmin(axis=1)
        least = d2[np.arange(len(at)), first]
        closer = (least < best[at]) | ((least == best[at]) & (first + a < code[at]))
        best[at] = np.where(closer, least, best[at])
        code[at] = np.where(closer, first + a, code[at])
        seen.append((g, a, z, at, d2))
    bounds = bounds.copy()
    # A group that isn't scanned and loses the own entry now has that entry among those it bounds.
    group_of = np.repeat(np.arange(len(cuts)), [z - a for a, z in cuts])
    lost = np.flatnonzero((code != old) & ~scan[rows, group_of[old]])
    bounds["low"][lost, group_of[old[lost]]] = np.minimum(_down(old_best[lost]), np.nextafter(left[lost, group_of[old[lost]]].astype(np.float32), np.float32(-np.inf)))
    bounds["stamp"][lost, group_of[old[lost]]] = now
    for g, a, z, at, d2 in seen:
        rest, inside = d2.astype(np.float64), np.flatnonzero((code[at] >= a) & (code[at] < z))
        rest[inside, code[at[inside]] - a] = np.inf
        bounds["low"][at, g] = _down(rest.min(axis=1))
        bounds["stamp"][at, g] = now
    return code, best, bounds, int(scan.sum())


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """(rows, width) of floor(SCALE * component); shorter vectors are followed by zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def sums(rows: DataFrame, parts: int, entries: int, dtype: str) -> list[tuple[int, int, int, np.ndarray]]:
    """(part, entry, parts assigned, their sum) of each used entry. rows: (x binary, code binary). A task adds up what it reads before
    anything is shuffled."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = total = None
        for b in it:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype).reshape(b.num_rows, parts, -1)
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            if total is None:
                count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, x.shape[2]), np.int64)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p].astype(np.int64))
        if total is not None:
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array([t.tobytes() for t in total[p, e]], pa.binary())], ["part", "entry", "n", "total"])

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], list] = {}
        for b in it:
            for p, e, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = met.setdefault((p, e), [0, 0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(t, np.int64)
        if met:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in met], pa.int32()), pa.array([k[1] for k in met], pa.int32()), pa.array([v[0] for v in met.values()], pa.int64()), pa.array([v[1].tobytes() for v in met.values()], pa.binary())], ["part", "entry", "n", "total"])

    kind = "part int, entry int, n long, total binary"
    found = rows.select("x", "code").mapInArrow(add, kind).repartition(min(16, partitions(rows.sparkSession)), "part", "entry").mapInArrow(merge, kind)
    return [(r["part"], r["entry"], r["n"], np.frombuffer(r["total"], np.int64)) for r in found.collect()]


def codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) for each row whose vector is not null and has no null or non-finite
    component. size is at most 256.

    Codebooks start from the first rows by id and then by vector, null ids last; a table with fewer rows than size has codebooks of
    as many entries, and an empty one gives no rows. Repeated rows all count and get equal codes. A nearest entry is the one of
    the lower index on ties. Vectors shorter than the longest, or of a length that parts doesn't divide, count as followed by
    zeros. Other columns are not read, whatever their names. Numbers so large that squared distances leave 64 bits raise ValueError."""
    spark = rows.sparkSession
    vector = F.col(vector_col)
    # NaN is above infinity in Spark's order.
    fine = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    kept = rows.where(vector.isNotNull() & fine).select(F.col(id_col).alias("key"), F.col(label_col).alias("label"), vector.cast("array<double>").alias("v"))
    facts = kept.agg(F.max(F.size("v")).alias("n"), F.max(F.array_max(F.transform("v", lambda v: F.abs(v)))).alias("top")).first()
    width = -(-(facts["n"] or 0) // parts)
    top = (facts["top"] or 0.0) * SCALE + 2
    if 4 * max(width, 1) * top * top >= 2.0**63:
        raise ValueError("components too large for whole-number distances of 64 bits")
    exact = np.float64 if 4 * max(width, 1) * top * top < 2.0**52 else np.int64
    dtype = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    begin = kept.orderBy(F.col("key").asc_nulls_last(), "v").limit(size).select("v").toArrow().column("v")
    begin = begin.combine_chunks() if begin.num_chunks != 1 else begin.chunk(0)
    entries = len(begin)
    # (round, part, entry, component)
    history = integers(begin, width * parts).reshape(1, entries, parts, width).swapaxes(1, 2)
    kind = rows.select(F.col(id_col).alias("key"), F.col(label_col).alias("label")).schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kind)
    n_groups = len(groups_of(entries))

    def scanned(frame: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = history.astype(exact)
            for b in it:
                for a in range(0, b.num_rows, 4096):
                    s = b.slice(a, 4096)
                    n = s.num_rows
                    if len(books) == 1:
                        whole = integers(s.column(2), width * parts)
                    else:
                        whole = np.frombuffer(b"".join(s.column(2).to_pylist()), dtype).reshape(n, -1)
                        code = np.frombuffer(b"".join(s.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                        bounds = np.frombuffer(b"".join(s.column(4).to_pylist()), _BOUND).reshape(n, parts, n_groups)
                    x = whole.reshape(n, parts, width).astype(exact)
                    new, errors, low = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64), np.zeros((n, parts, n_groups), _BOUND)
                    for p in range(parts):
                        if len(books) == 1:
                            c, d2, low[:, p] = first_scan(x[:, p], books[0, p])
                        else:
                            c, d2, low[:, p], _ = next_scan(x[:, p], books[:, p], code[:, p], bounds[:, p])
                        new[:, p] = c
                        errors += d2.astype(np.int64)
                    if last:
                        yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([c.tobytes().hex() for c in new]), pa.array(errors)], ["key", "label", "code", "error"])
                    else:
                        kept_x = s.column(2) if len(books) > 1 else pa.array([v.tobytes() for v in whole.astype(dtype)], pa.binary())
                        yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), kept_x, pa.array([c.tobytes() for c in new], pa.binary()), pa.array([v.tobytes() for v in low], pa.binary())], ["key", "label", "x", "code", "bounds"])

        return frame.mapInArrow(batches, f"{kinds}, code string, error long" if last else f"{kinds}, x binary, code binary, bounds binary")

    state = kept if entries else None
    for t in range(rounds if entries else 0):
        done = state
        state = materialize(scanned(state, history, False), "codes")
        if t:
            forget(done)
        book = history[-1].copy()
        for p, e, n, total in sums(state, parts, entries, dtype):
            book[p, e] = total // n
        history = np.concatenate([history, book[None]])
    if state is None:
        final = spark.createDataFrame([], f"{kinds}, code string, error long")
    else:
        final = materialize(scanned(state, history, True), "codes")
        if rounds:
            forget(state)
    sha = hashlib.sha256(",".join(map(str, history[-1].ravel().tolist())).encode()).hexdigest()
    out = with_label_errors(final)
    return out.select(F.col("key").alias(id_col), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows (label, error, more) plus label_error, the sum of error over rows of an equal label; nulls are equal. Sums of few labels
    are sent to all tasks; those of many are joined with a label's rows dealt into SALT shares."""
    labels = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")

    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b)

    if labels.count() <= BROADCAST:
        side = F.broadcast(labels.withColumnRenamed("label", "its_label"))
        return rows.join(side, same(F.col("label"), F.col("its_label"))).drop("its_label")
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("key", "code"), F.lit(SALT)).cast("int"))
    side = labels.select(F.col("label").alias("its_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("its_share"))
    return dealt.join(side.hint("merge"), same(F.col("label"), F.col("its_label")) & (F.col("share") == F.col("its_share"))).drop("its_label", "its_share", "share")
