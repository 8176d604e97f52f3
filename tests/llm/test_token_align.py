"""Token alignment against a plain version over byte ranges."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palimpsest.llm import token_align

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def known():
    return token_align.load()


def brute(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(token_align.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_align.PIECES)
    to_byte = token_align.byte_level()

    def bytes_of_b(i):
        p = b.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode()

    per_doc, counts = [], Counter()
    for doc_id, text in rows:
        links, groups, x, y = [], [], [], []
        if text:
            x = a.encode(" " + text, add_special_tokens=False).ids
            y = b.encode(text)
            bx = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in x]
            by = [bytes_of_b(i) for i in y]
            if not b"".join(bx) == b"".join(by) == (" " + text).encode():
                x, y = [], []
            else:
                ex, ey = np.cumsum([len(t) for t in bx]).tolist(), np.cumsum([len(t) for t in by]).tolist()
                j = 0
                for i in range(len(x)):
                    while ey[j] <= ex[i] - len(bx[i]):
                        j += 1
                    k = j
                    while k < len(y) and ey[k] - len(by[k]) < ex[i]:
                        links.append((x[i], y[k]))
                        k += 1
                cuts, i0, j0 = sorted(set(ex) & set(ey)), 0, 0
                for c in cuts:
                    i1, j1 = ex.index(c, i0) + 1, ey.index(c, j0) + 1
                    groups.append(",".join(map(str, x[i0:i1])) + "|" + ",".join(map(str, y[j0:j1])))
                    i0, j0 = i1, j1
        counts.update(set(links))
        per_doc.append((doc_id, x, y, groups, links))
    most = {}
    for (p, _), n in counts.items():
        most[p] = max(most.get(p, 0), n)
    return sorted(
        ((d, len(x), len(y), len(g), len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for d, x, y, g, k in per_doc), key=str
    )


def odd_rows():
    rng = random.Random(5)
    parts = ["naïve", "  two", "\n\n", "日本語", "😀", "<s>", "</s>", "<|endoftext|>", "<unk>", "12345", "don't", "▁", "\t", "x" * 70, "Ünï", "\x00", "﷽", "ﬁ", "é"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    return [*rows, (None, "null id"), (900, None), (901, ""), (902, " "), (902, "same id"), (902, "same id"), (903, "word " * 20000)]


def test_ranks():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 1), (70, 300), (500, 40), (1000, 1000)):
        short, long = np.unique(rng.integers(0, 2000, n)), np.unique(rng.integers(0, 2000, m))
        assert (token_align.ranks(short, long) == np.searchsorted(long, short)).all()
    assert (token_align.ranks(np.array([5]), np.array([], int)) == 0).all()
    numbers = np.array([0, 1, 2**40])
    assert (token_align.unpack(token_align.pack(numbers)) == numbers).all() and len(token_align.unpack(token_align.pack(numbers[:0]))) == 0


def test_alignments_by_brute_force(spark, known, monkeypatch):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    rows = odd_rows() + list(zip(*(table.slice(0, 40).column(c).to_pylist() for c in ("doc_id", "text")), strict=True))
    want = brute(rows)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, row int, keys string").repartition(3)
    got = token_align.alignments(df, known)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[1] == 0 for r in want) > 3 and sum(r[4] for r in want) > 10000
    for sent in (200, 0):  # the frequent pairs are sent and the others joined; all are joined
        monkeypatch.setattr(token_align, "SENT", sent)
        monkeypatch.setattr(token_align, "HELD", 100)
        assert sorted(map(tuple, token_align.alignments(df, known).collect()), key=str) == want


def test_empty_table(spark, known):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_align.alignments(df, known).count() == 0
    assert token_align.alignments(spark.createDataFrame([(1, None)], "doc_id long, text string"), known).first()["groups_sha256"] == ""
