"""Vector codes against a plain k-means over whole numbers."""

import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import vector_codes


def brute(rows, parts=4, size=256, rounds=4):
    kept = [(i, [0.0 if c is None else c for c in v], label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, np.floor(np.array(v + [0.0] * (width * parts - len(v))) * 1024).astype(np.int64), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.stack([r[1] for r in kept]).reshape(len(kept), parts, width)
    book = x[:size].swapaxes(0, 1).copy()

    def assign():
        return np.stack([((x[:, p, None] - book[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in set(at[:, p].tolist()):
                mine = x[at[:, p] == e, p]
                book[p, e] = mine.sum(0) // len(mine)
    at = assign()
    errors = sum(((x[:, p] - book[p][at[:, p]]) ** 2).sum(1) for p in range(parts)).tolist()
    by_label = {}
    for r, e in zip(kept, errors):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], bytes(a.astype(np.uint8)).hex(), e, by_label[r[2]], sha) for r, a, e in zip(kept, at, errors)), key=str)


def rows_of(seed, n, dim, grid=None):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(7)]
    value = (lambda v: round(v * grid) / grid) if grid else (lambda v: v)
    return [(i * 3 % 1009, [value(c + rng.gauss(0, 0.1)) for c in rng.choice(centres)], rng.choice([0, 0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("size,rounds,grid", [(256, 4, None), (5, 4, 8), (16, 6, 4), (300, 0, None)])
def test_codes_by_brute_force(spark, size, rounds, grid):
    rows = rows_of(size, 320, 16, grid)
    got = vector_codes.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5), size=min(size, 256), rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, size=min(size, 256), rounds=rounds)


def test_bounds_hold_and_save_scans():
    rng = np.random.default_rng(3)
    x = rng.integers(-800, 800, (500, 4)).astype(np.float64)
    history = [x[:32]]
    code, _, bounds = vector_codes.first_scan(x, history[0])
    scanned = total = 0
    for _ in range(8):
        history.append(np.stack([np.floor(x[code == e].mean(0)) if (code == e).any() else history[-1][e] for e in range(32)]))
        code, best, bounds, n = vector_codes.next_scan(x, np.stack(history), code, bounds)
        d2 = ((x[:, None] - history[-1][None]) ** 2).sum(2)
        assert (code == d2.argmin(1)).all() and (best == d2.min(1)).all()
        d2[np.arange(500), code] = np.inf
        moved = np.stack([np.sqrt(((h - history[-1]) ** 2).sum(1)) for h in history])
        for g, (a, z) in enumerate(vector_codes.groups_of(32)):
            bound = bounds["low"][:, g] - moved[bounds["stamp"][:, g], a:z].max(1)
            assert (bound <= np.sqrt(d2[:, a:z].min(1))).all()
        scanned, total = scanned + n, total + bounds.size
    assert scanned < 0.7 * total


def test_odd_vectors(spark):
    rows = [(1, [0.5, -0.25, 1.0], 1), (1, [0.5, -0.25, 1.0], 1), (None, [1.0], None), (2, None, 1), (3, [float("nan")], 1), (4, [1.0, None], 1), (5, [float("inf")], 1), (6, [], None), (7, [2.0, 2.0, 2.0, 2.0, 2.0], 2)]
    kind = "vec_id long, embedding array<float>, label int, key int, code string, x string, error int"
    df = spark.createDataFrame([(*r, 1, "c", "x", 2) for r in rows], kind)
    got = vector_codes.codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert vector_codes.codes(df.limit(0)).count() == 0
    assert vector_codes.codes(df.where("vec_id = 6")).count() == 1
    with pytest.raises(ValueError):
        vector_codes.codes(spark.createDataFrame([(1, [1e12] * 4, 1)], "vec_id long, embedding array<double>, label int"))


def test_label_errors_of_many_labels(spark, monkeypatch):
    rows = rows_of(9, 100, 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    few = sorted(map(tuple, vector_codes.codes(df, size=4).collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST", 0)
    assert sorted(map(tuple, vector_codes.codes(df, size=4).collect())) == few
