"""The n-gram join against all pairs of shingle sets."""

import random

import numpy as np
import pyarrow.parquet as pq

from palimpsest.llm import ngram_join


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i in range(len(rows)):
        for j in {j for x in sets[i] for j in holders[x] if j < i}:
            both = len(sets[i] & sets[j])
            if rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((doc_id, len(sets[i]), None if doc_id is None else least[find(i)]) for i, (doc_id, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    """Families of texts with edits about as many as near sets may have, over shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 7, 9, 12, 20, 40, 90, 300, 700]))]
        if rng.random() < 0.3:
            base[1:1] = passage
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
            rows.append((len(rows) * 2, " ".join(copy).upper() if rng.random() < 0.2 else " \n".join(copy)))
    odd = [(None, rows[0][1]), (9001, None), (9003, ""), (9005, " \t\n"), (9007, "one two"), (9009, "One  two"), (9011, "é É"), (9011, "other text of an id"), (9013, rows[1][1]), (9013, rows[1][1])]
    return rows + odd


def test_near_sets_share_a_signature():
    rng = np.random.default_rng(4)
    short = 0
    for trial in range(3000):
        n = int(rng.choice([4, 5, 9, 15, 16, 17, 50, 63, 64, 100, 255, 256, 1000]))
        m = int(rng.integers(n, n * 5 // 4 + 1))
        both = int(np.ceil(4 * (n + m) / 9))  # as few in common as near sets have
        if both > n:
            continue
        pool = rng.integers(0, 2**64, n + m - both, np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
        for groups in (ngram_join.GROUPS, (0.3, 1), None):
            shared = enough = False
            for band in set(ngram_join.bands_of(len(a))) & set(ngram_join.bands_of(len(b))):
                (x, fine_a), (y, fine_b) = (ngram_join.signatures(s, band, groups) for s in (a, b))
                shared, enough = shared or bool(np.isin(x, y).any()), enough or (fine_a and fine_b)
            assert shared or (not enough and groups == (0.3, 1)), (trial, n, m, groups)
            short += not enough
        folded = [np.frombuffer(ngram_join.sketch(s), np.uint64) for s in (a, b)]
        width = min(map(len, folded))
        x, y = (np.bitwise_xor.reduce(f.reshape(-1, width)) for f in folded)
        assert np.bitwise_count(x ^ y).sum() <= n + m - 2 * both
    assert short  # coarse groups don't always suffice


def test_linked_by_brute_force(spark, monkeypatch):
    rows = corpus(6, 90)
    want = brute(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, digest string").repartition(5)
    got = ngram_join.linked(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({r[2] for r in want}) < len(want) - 60
    # Short sets, lists cut into chunks, sets joined rather than sent.
    monkeypatch.setattr(ngram_join, "CHUNK", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST", 0)
    assert sorted(map(tuple, ngram_join.linked(df, groups=(0.3, 1)).collect()), key=str) == want


def test_linked_on_documents(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text")), strict=True))
    got = ngram_join.linked(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert ngram_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert ngram_join.linked(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2
