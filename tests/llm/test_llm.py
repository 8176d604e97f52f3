"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import fingerprint, html_cut, langid, mixing, pieces, quality_net, quality_rules, simhash, toxicity, warc_audit
from palimpsest.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ODD = [(None, "null id", "en", "s"), (1, None, None, None), (2, "", "en", ""), (3, "é" * 5000 + " x", "fr", "s"), (3, "same id", "en", "s"), (4, "twin text here", "en", "s"), (4, "twin text here", "en", "s"), (5, " \n\t ", "de", "s")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, lang string, source string, fp int, score string")


def test_odd_rows(spark, odd):
    for docs, n in ((odd, len(ODD)), (odd.limit(0), 0)):
        assert fingerprint.edited_pairs(docs).count() == n
        assert simhash.near_duplicates(docs).count() == n
        assert mixing.mix(docs).count() == n
        assert langid.identify(docs, langid.prototypes(docs)).count() == n
        refs = quality_rules.References(quality_rules.reference_counts(docs))
        assert quality_rules.measure(docs, refs).count() == n
        labels = docs.select("doc_id", F.lit(1).alias("label"))
        assert toxicity.score(docs, toxicity.learn_from(docs.select("doc_id", "text"), labels)).count() == n
        vectors = quality_net.word_vectors(docs)
        assert quality_net.score(docs, quality_net.learn(docs, labels, vectors), vectors).count() == n
        assert pieces.encode(docs, pieces.load(), check=True).where("exact").count() == n
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "score")
        assert html_cut.extract(pages).count() == n
        assert warc_audit.audit(pages, pages).where("status = 'intact'").count() == n
        assert simhash.representatives(docs).count() <= n
        assert mixing.repeat(docs).columns == docs.columns


def test_edited_pairs(spark):
    rng = random.Random(1)
    rows = [(i * 3, "".join(rng.choice("abç de\n") for _ in range(rng.randint(0, 400)))) for i in range(200)]
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i]["fingerprint"] == fingerprint.encode(fingerprint.quartile_codes(t.encode()))
        assert 0 <= got[i]["near_edited"] <= 1
    codes = fingerprint.quartile_codes("some text".encode() * 50)
    assert (fingerprint.decode(fingerprint.encode(codes)) == codes).all()


def test_simhash_by_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            if copy and rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy).upper()))

    def brute(t):
        w = t.lower().split()
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for chunk in (1024, 2):  # with every bucket in one chunk, and cut into many
        simhash.CHUNK = chunk
        got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: (fps[i], find(i)) for i in range(len(rows))}
    simhash.CHUNK = 1024


def test_html():
    page = """<html><head><title>T</title><style>a{}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; more</h1><p>First <b>bold</b> long paragraph of the article with   many words in it.<p>Second one, with a <a href=y>link</a> inside of it.</article>
    <aside><p>Side text that is long enough to look like an article paragraph.</p></aside><div id="comments"><p>Nice post, I liked it a lot, thank you.</p></div>
    <form><label>Mail</label><input></form><script>var a = "<p>no</p>";</script><footer>&copy; me</footer></body>"""
    assert html_cut.main_text(page) == "Head & more\nFirst bold long paragraph of the article with many words in it.\nSecond one, with a link inside of it."
    assert html_cut.main_text(None) == html_cut.main_text("") == html_cut.main_text("<nav>menu</nav><!-- cut") == ""
    assert html_cut.minimum_cut([2.0, -0.5, -3.0], [(0, 1, 1.0), (1, 2, 0.2)]) == [True, True, False]


def test_minimum_cut_by_brute_force():
    rng = random.Random(10)
    for _ in range(200):
        n = rng.randint(1, 8)
        terminal = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 3)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(keep):
            return sum(abs(t) for t, k in zip(terminal, keep) if (t > 0) != k) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_cut.minimum_cut(terminal, edges)) == pytest.approx(best)


def test_html_of_odd_shapes():
    """The cut decides where elements say little and a block's own text misleads; long, deep and broken pages end soon."""
    words = "words " * 80
    found, boxes = html_cut.blocks(f"<div><p>{words}</p><ul><li>Short.</li></ul><p>{words}</p></div>")
    terminal, edges = html_cut.graph(found, boxes)
    assert [t > 0 for t in terminal] == [True, False, True]
    assert html_cut.minimum_cut(terminal, edges) == [True, True, True]
    mixed = f"<article><p>Short.</p><p>{words}</p></article><div class=comments><p>{words}</p></div>"
    assert html_cut.main_text(mixed) == "Short.\n" + words.strip()
    long = "<article>" + "".join(f"<p>paragraph {i} of a long page</p><div class=ad>buy {i}</div>" for i in range(5000)) + "</article>"
    assert html_cut.main_text(long) == "\n".join(f"paragraph {i} of a long page" for i in range(5000))
    assert html_cut.main_text("<div>some text of it " * 5000).count("\n") == 4999
    # Short neighbours don't drag a paragraph out of an element that says nothing.
    plain = "plain words of text " * 57
    page = f"<div class='zz'><div>Next &gt;</div><p>{plain}</p><ul><li><a href=x>One link</a></li><li><a href=y>Two link</a></li></ul></div>"
    assert plain.strip() in html_cut.main_text(page).split("\n") and "link" not in html_cut.main_text(page)
    assert html_cut.main_text("<article><p>Energy is <math><mi>E</mi>=m</math> here</p></article>") == "Energy is E=m here"
    for broken in ("<", "<p", "<p class='", "a < b > c", "</p></div>", "<!--", "<![CDATA[x", "&#x110000; &bogus; &lt"):
        assert "<p" not in html_cut.main_text(broken)


def test_html_query_by_enumeration(spark):
    """Whole pages through Spark: of all labellings of a page's blocks the one kept costs least."""
    rng = random.Random(14)
    pieces_ = ["<p>{}</p>", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>", "<div class=zz>{}</div>", "<nav><a href=x>{}</a></nav>", "<h1>{}</h1>", "<section><p>{}</p><p>and {}</p></section>"]
    pages = []
    for i in range(60):
        body = "".join(rng.choice(pieces_).replace("{}", f"t{rng.randint(0, 99)} " * rng.choice([1, 3, 20, 90])) for _ in range(rng.randint(1, 6)))
        pages.append((i, f"u{i}", rng.choice(["<article>{}</article>", "<div>{}</div>", "<body>{}"]).format(body), "mine"))
    rows = html_cut.extract(spark.createDataFrame(pages, "page_id long, url string, html string, score string").repartition(3)).collect()
    texts = {r["page_id"]: r["text"] for r in rows}
    assert rows[0].asDict().keys() == {"page_id", "url", "score", "text", "n_chars"} and all(r["n_chars"] == len(r["text"]) and r["score"] == "mine" for r in rows)
    undecided = 0
    for i, _, page, _ in pages:
        found, boxes = html_cut.blocks(page)
        terminal, edges = html_cut.graph(found, boxes)

        def cost(keep):
            return sum(abs(t) for t, k in zip(terminal, keep) if (t > 0) != k) + sum(w for a, b, w in edges if keep[a] != keep[b])

        best = min((tuple(m >> k & 1 == 1 for k in range(len(found))) for m in range(1 << len(found))), key=cost)
        got = tuple(html_cut.minimum_cut(terminal, edges))
        assert cost(got) == pytest.approx(cost(best))
        assert texts[i] == "\n".join(b.text for b, k in zip(found, got) if k)
        undecided += sum((t > 0) != k for t, k in zip(terminal, got))
    assert undecided > 5  # the flow changes labels


def odd_texts(n):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "a", "the", "ing", "é", "日", "▁", ".", "!!", "***", "\t", "0", "😀", "x" * 70, "\0", "²", "];", "naïve"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*out, *out[:9], "", " ", "é" * 900, "ab" * 400 + "c", "日本語" * 300]


@pytest.mark.parametrize("common", [pieces.COMMON, 20, 0])
def test_pieces_match_the_library(spark, common):
    """Every text, whichever way its words' ids come to it: all sent, some joined, all joined."""
    table, model = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [(i, t, "x") for i, t in enumerate(odd_texts(400))]
    docs = spark.createDataFrame([*rows, (None, None, "x"), (0, rows[0][1], "y")], "doc_id long, text string, key string")
    got = pieces.encode(docs, table, check=True, common=common)
    assert got.columns == ["doc_id", "key", "ids", "decoded_sha256", "exact"]
    found = got.collect()
    assert len(found) == len(rows) + 2 and all(r["exact"] for r in found)
    by_id = {(r["doc_id"], r["key"]): r["ids"] for r in found}
    for i, t, _ in rows:
        assert by_id[i, "x"] == model.encode(t)
        assert pieces.decode_ids(by_id[i, "x"], table) == t.replace("▁", " ")
    assert by_id[0, "y"] == by_id[0, "x"] and by_id[None, "x"] == []
    back = pieces.decode(got, table).select("doc_id", "key", "decoded").collect()
    assert {r["decoded"] for r in back} == {(t or "").replace("▁", " ") for _, t, _ in rows}


def test_lattice_by_brute_force(spark):
    table = pieces.load()
    words = ["▁the", "▁a", "é", "😀", "▁inging", "x" * 600, "▁"]
    rows = spark.createDataFrame([(pieces.name_of(w), w, 1) for w in words], "name string, word string, n long")
    rows = rows.withColumn("word", F.when(F.col("name") != F.col("word"), F.col("word")))
    got = {r["name"]: sorted((e >> pieces.BITS, e % (1 << pieces.BITS)) for e in r["edges"]) for r in pieces.lattice(rows, table).collect()}
    for w in words:
        spans = [(i, k) for i in range(len(w)) for k in range(2, min(table.longest, len(w) - i) + 1)]
        want = [(i * pieces.SPAN + k, table.order.index(w[i : i + k])) for i, k in spans if w[i : i + k] in table.table]
        assert got[pieces.name_of(w)] == sorted(want)


def test_merges_in_order_of_rank(spark):
    """Words without late pieces are folded in one pass and give what merges one by one give; words with them still do, by the other way."""
    table = pieces.load()
    assert table.late and all(set(table.order[i]) == {pieces.BLANK} for i in table.late)
    rng = random.Random(8)
    made = {"".join(rng.choice(table.order) for _ in range(rng.randint(1, 5)))[: pieces.LONG] for _ in range(1500)}
    made |= {pieces.BLANK * n + x for n in range(1, 36) for x in ("", "a", "the")}
    # abc has its place before bc, which merges reach first where a b isn't a piece.
    small = pieces.Pieces({p: (i, -float(i)) for i, p in enumerate(["abc", "bc", "cd", "abcd", "dd"])}, [0] * 256, [b""] * 5, "merge")
    assert [small.order[i] for i in small.late] == ["abc"]
    few = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(300)}
    for t, words in ((table, made), (small, few)):
        rank = {p: i for i, p in enumerate(t.order)} | {t.order[i]: a for a, z in t.ties for i in range(a, z)}
        rows = spark.createDataFrame([(w, None, 1) for w in sorted(words)], "name string, word string, n long")
        coded = pieces.encode_words(rows, t, False)[0]
        assert "sort_array" in coded._jdf.queryExecution().optimizedPlan().toString()
        got = {r["name"]: r["numbers"] for r in coded.collect()}
        assert len(got) == len(words)
        for w in words:
            spans = list(w)
            while pairs := [(rank[a + b], i) for i, (a, b) in enumerate(zip(spans, spans[1:])) if a + b in rank]:
                i = min(pairs)[1]
                spans[i : i + 2] = [spans[i] + spans[i + 1]]
            assert got[w] == [pieces.CHARS + ord(x) if len(x) == 1 else t.order.index(x) for x in spans]


def test_mixing_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 30), f"s{min(int(rng.expovariate(0.5)), 6)}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    by = out.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by.index))}
    want, left, free = {}, float(by["size"].sum()), set(by.index)
    while True:  # share out again and again, as the contract has it
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * by.loc[s, "size"]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * by.loc[s, "size"]
        left, free = left - sum(want[s] for s in over), free - over
    for s in by.index:
        assert by.loc[s, "target"] == pytest.approx(want[s])
        assert abs(by.loc[s, "taken"] - want[s]) <= 30
    assert (out["taken"] <= 3 * out["size"]).all()


def test_repeated_words():
    rng = random.Random(6)
    for _ in range(200):
        ids = np.array([rng.randrange(4) for _ in range(rng.randint(0, 40))], np.int64)
        w = [tuple(ids[i : i + 5]) for i in range(max(0, len(ids) - 4))]
        want = {i + k for i, x in enumerate(w) if w.count(x) > 1 for k in range(5)}
        assert quality_rules.repeated_words(ids) == len(want)
    assert quality_rules.duplicate_lines("a\n a\na\n\n\n") == 1


def test_misspelt_insults_score_high():
    rng = random.Random(7)
    clean = [" ".join(rng.choice(["river", "stone", "market", "walks", "green", "over"]) for _ in range(60)) for _ in range(200)]
    bad = [t.replace("stone", "idiotic", 1) for t in clean]
    model = toxicity.fit(clean + bad, np.array([0] * 200 + [1] * 200))
    low, high = model.logits(["river stone market green"])[0], model.logits(["river idi0tic market green"])[0]
    assert high > low
    mixed = [clean[0], bad[1], "", bad[2], None]
    assert model.logits(mixed) == pytest.approx([model.logits([t])[0] for t in mixed])


def test_quality_features_see_returning_words():
    texts = ["one one one one", "one two three four", None, "a, a, a, a,", "", "x y x y x y"]
    vectors = np.random.default_rng(1).normal(size=(quality_net.ROWS, quality_net.DIM)).astype(np.float32)
    shares = quality_net.features_of(texts, vectors)[:, -quality_net.RETURNS :]
    assert np.allclose(shares, [[0.75, 0.5, 0.25], [0, 0, 0], [0, 0, 0], [0, 0.75, 0], [0, 0, 0], [0, 2 / 3, 0]])
    alone = np.vstack([quality_net.features_of([t], vectors) for t in texts])
    assert np.allclose(alone, quality_net.features_of(texts, vectors), atol=1e-5)


def test_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    for name, label in (("op6_subword_toxicity", "toxic"), ("op8_random_indexing_quality", "quality")):
        rows = QUERIES[name](spark, data).join(labels, "doc_id").where("held_out").toPandas()
        assert (rows["predicted"] == rows[label]).mean() > 0.9
        yes, no = rows[rows[label] == 1], rows[rows[label] == 0]
        assert (yes["predicted"] == 1).mean() > 0.5 and (no["predicted"] == 1).mean() < 0.1
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_hyperdimensional_language"](spark, data).join(docs, "doc_id").where("held_out").toPandas()
    assert (rows["lang_pred"] == rows["lang"]).mean() > 0.95


def test_warc_audit_finds_damage(spark):
    got = {r["status"]: {r["page_id"] % 50} | set() for r in QUERIES["op4_warc_merkle_audit"](spark, DATA).where("page_id % 50 IN (7, 9)").collect()}
    assert got == {"corrupt": {7}, "missing": {9}}


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 50
    assert len(corpus_pipeline.STAGES) == 5


def test_language_stage_keeps_short_texts(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    short = ["Avec.", "Lllldoado.", "A.", "Edrere.", "Onhaha sh."]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*short, "12 34", "", None])], "doc_id long, text string")
    out = corpus_pipeline.identify_language(spark, docs.unionByName(more, allowMissingColumns=True), DATA)
    assert {r["text"] for r in out.where("doc_id < 0").collect()} == set(short)


def test_near_dedup_stage_by_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    common = [rng.choice(words) for _ in range(30)]
    texts = ["", " ", "one", "ONE", "a b c", None]
    for _ in range(90):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))] + (common if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = [(i - i % 9 if i % 9 < 2 else i, t) for i, t in enumerate(texts)]  # some ids are given twice

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    found = 0
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                found += root[i] != root[j]
                root = [root[j] if r == root[i] else r for r in root]
    assert found > 40
    heads = {}
    for r, row in zip(root, rows):
        heads.setdefault(r, []).append(row)
    docs = spark.createDataFrame([*rows, (None, "one"), (None, "one")], "doc_id long, text string")
    for chunk in (1024, 2):  # with every group in one chunk, and cut into many
        simhash.CHUNK = chunk
        out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()]
        assert out.count((None, "one")) == 2
        kept = [r for r in out if r[0] is not None]
        assert len(kept) == len(heads)
        for members in heads.values():  # one row of each component, of its smallest id
            mine = [r for r in kept if r in members]
            assert len(mine) == 1 and mine[0][0] == min(i for i, _ in members)
    simhash.CHUNK = 1024


def test_near_dedup_loses_no_pair_of_small_sets(spark):
    """Four of five shingles in common are 0.8; bands of fingerprints alone lose some of these pairs."""
    rng, rows = random.Random(5), []
    for i in range(400):
        words = [f"w{rng.randrange(10**7)}" for _ in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 800, 2))


def test_unigram_fold_by_brute_force(spark):
    """The best of all paths over a unigram table with made-up scores, characters without a piece ten under the least."""
    rng = random.Random(9)
    made = {c: -6.0 - i / 8 for i, c in enumerate("abc▁")} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): -rng.uniform(4, 14) for _ in range(25)}
    table = pieces.Pieces({p: (256 + i, s) for i, (p, s) in enumerate(made.items())}, list(range(256)), [], "viterbi")
    words = ["▁" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(80)]

    def best(word):
        if not word:
            return 0.0, []
        ways = []
        for k in range(1, min(table.longest, len(word)) + 1):
            if (e := table.table.get(word[:k])) or k == 1:
                score, ids = best(word[k:])
                ways.append((score + (e[1] if e else min(made.values()) - 10), ([e[0]] if e else list(word[:1].encode())) + ids))
        return max(ways, key=lambda x: x[0])

    rows = spark.createDataFrame([(w, None, 1) for w in set(words)], "name string, word string, n long")
    got = {r["name"]: pieces.ids_of(np.array(r["numbers"]), np.array([0]), table, pieces._plain_ids(table))[0].tolist() for r in pieces.encode_words(rows, table)[0].collect()}
    score = {i: s for i, s in table.table.values()}
    for w in set(words):  # ways of equal score are equally right
        assert sum(score.get(i, min(made.values()) - 10) for i in got[w]) == pytest.approx(best(w)[0])
        text = "".join(table.order[[table.table[p][0] for p in table.order].index(i)] if i > 255 else chr(i) for i in got[w])
        assert text == w
    assert pieces.load().fold == "merge"


def test_quartile_digest_by_brute_force():
    rng = random.Random(11)
    for n in (0, 1, 7, 8, 500, 5000):
        data = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        counts = [0] * fingerprint.BUCKETS
        for salt, (i, j, k) in enumerate(fingerprint.TRIPLETS, 1):
            for at in range(max(0, n - k)):
                h = ((data[at + i] << 16 | data[at + j] << 8 | data[at + k]) * 0x9E3779B1 + salt * 0x7FEB352D) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x846CA68B & 0xFFFFFFFF
                counts[h >> 23] += 1
        ranked = sorted(counts)
        cuts = [ranked[len(ranked) * q // 4 - 1] for q in (1, 2, 3)]
        codes = [sum(c > x for x in cuts) for c in counts]
        bits = "".join(f"{c:02b}" for c in codes)
        want = f"{min(255, round(12 * np.log2(n + 1))):02x}" + "".join(f"{int(bits[b : b + 8], 2):02x}" for b in range(0, len(bits), 8))
        assert fingerprint.encode(fingerprint.quartile_codes(data)) == want


def test_quality_counts_by_brute_force(spark):
    """The whole query: its counts, the base rules, and that only texts that pass them are judged by divergence."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op5_distribution_divergence"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    white = " \t\n\v\f\r"
    for r in rows:
        text = texts[r["doc_id"]]
        words = [w for w in "".join(" " if c in white else c for c in text).split(" ") if w]
        places: dict = {}
        for i in range(len(words) - 4):
            places.setdefault(tuple(words[i : i + 5]), []).append(i)
        repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
        lines = [x for x in text.split("\n") if x.strip(white)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
        by_char, by_word = r["char_distance"], r["word_distance"]
        far = (by_char or 0) >= quality_rules.MAX_CHAR_DISTANCE or (by_word or 0) >= quality_rules.MAX_WORD_DISTANCE
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not far)


def test_letters_of_all_planes():
    for text, n in (("😀 🎉", 0), ("12 .", 0), ("a", 1), ("𐐷x", 2), ("日本", 2), ("a😀b", 3), ("🄀", 0), (None, 0)):
        assert len(langid.trigrams(text)) == n, text
    classes = langid._letter_of()
    assert all((classes[cp] > 0) == chr(cp).isalpha() for cp in range(0, 0x110000, 7))


def test_warc_audit_of_odd_pages(spark):
    """Lost, added, changed and unnamed pages; a record that moves is intact."""
    rows = [(i, f"u{i}", "x" * (i % 7)) for i in range(3000)] + [(None, f"n{i}", "text") for i in range(40)] + [(-5, "minus", "y"), (7, "again", "z")]
    gone, added, changed = {3, 1500, -5}, [(5000, "new", "a"), (None, "new", "b")], {10, 2999}
    kept = [(i, u, h + "!" if i in changed else h) for i, u, h in rows if i not in gone and u != "n7"]
    kind = "page_id long, url string, html string"
    out = warc_audit.audit(spark.createDataFrame(rows, kind), spark.createDataFrame(kept + added, kind)).collect()
    assert len(out) == len(rows) + 2
    of = {s: sorted((r["page_id"] is None, r["page_id"] or 0) for r in out if r["status"] == s) for s in ("missing", "extra", "corrupt")}
    assert of == {"missing": [(False, -5), (False, 3), (False, 1500), (True, 0)], "extra": [(False, 5000), (True, 0)], "corrupt": [(False, 10), (False, 2999)]}
    assert warc_audit.audit(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0


def test_names_that_clash_and_ids_that_repeat(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "one text of its own entirely here", 7), (1, "quite another one with other words", 8), (2, long, 9), (3, long + " end", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_rows long")
    for name in ("n_rows", "own_id", "place", "copies", "key", "bucket", "node", "__n", "own_key"):
        given = docs.withColumnRenamed("n_rows", name).withColumn("source", F.lit("s"))
        kept = simhash.representatives(given)
        assert kept.columns == given.columns
        assert sorted((r["doc_id"], r[name]) for r in kept.collect()) == [(1, 7), (1, 8), (2, 9)]
        again = mixing.repeat(given)
        assert again.columns == given.columns and {(r["doc_id"], r[name]) for r in again.collect()} <= {(i, x) for i, _, x in rows}


def test_mix_reruns_agree_and_inclusion_follows_the_odds(spark):
    """A source that is cut: the same rows whatever the partitions, as many words as the target, and over many seeds each document as often
    as its inclusion odds, which rise with the root of its size."""
    rows = [(i, "w " * (4 if i % 2 else 64), "a") for i in range(300)] + [(1000 + i, "w " * 60, "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()

    def taken(df, seed):
        got = mixing.mix(df, weights=(1.0, 3.0), max_repeat=2, seed=seed).toPandas().sort_values("doc_id", ignore_index=True)
        return got[got["source"] == "a"]

    first = taken(docs, "s0")
    assert 0 < first["target"].iloc[0] < first["source_size"].iloc[0]
    assert (first["copies"].to_numpy() == taken(docs.repartition(7), "s0")["copies"].to_numpy()).all()
    seeds = [first, *(taken(docs, f"s{k}") for k in range(1, 12))]
    for got in seeds:
        assert set(got["copies"]) == {0, 1} and abs(got["taken"].sum() - got["target"].iloc[0]) <= 64
    rate = first["target"].iloc[0] / (np.sqrt(first["size"]) * first["size"]).sum()
    for size in (4, 64):
        often = np.mean([got[got["size"] == size]["copies"].mean() for got in seeds])
        assert often == pytest.approx(rate * size**0.5, rel=0.15)


def test_likeness_of_digests(spark):
    """near_edited and near_next of the whole query, from digests made text by text."""
    texts = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in QUERIES["op1_quartile_digest"](spark, DATA).collect()}

    def likeness(x, y):
        a, b = (fingerprint.quartile_codes(t.encode()).tolist() for t in (x, y))
        apart = sum(abs(m - n) for m, n in zip(a[1:], b[1:])) / (len(a) - 1) / fingerprint.FULL + abs(a[0] - b[0]) * fingerprint.LENGTH_WEIGHT
        return max(0.0, 1 - apart)

    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        want = likeness(t, edited), likeness(t, following)
        assert (rows[i]["near_edited"], rows[i]["near_next"]) == pytest.approx(want)


def test_prototypes_and_cosines_by_brute_force(spark):
    """Languages from vectors bound letter by letter and added up trigram by trigram."""
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(["the cat sat", "le chat noir", "a thin thing", "ça va très bien", "x", "", None, "12 the 7"])] + [(9, "the chat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (langid.CLASSES, langid.DIM))

    def bundle(text):
        out, framed = np.zeros(langid.DIM), "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        for word in framed:
            codes = [0, *(int(langid._letter_of()[ord(c)]) for c in word), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        for last, following in zip(framed, framed[1:]):  # the blank between two words, with a letter on either side
            a, c = (int(langid._letter_of()[ord(x)]) for x in (last[-1], following[0]))
            out += np.roll(letters[a], 2) * np.roll(letters[0], 1) * letters[c]
        return out

    profiles = {}
    for lang in "ab":
        total = sum(bundle(t) for _, t, own in rows if own == lang)
        profiles[lang] = total / np.linalg.norm(total)
    names, proto = langid.prototypes(docs)
    assert names == ["a", "b"] and np.allclose(proto, [profiles["a"], profiles["b"]], atol=1e-5)
    for r in langid.identify(docs, (names, proto)).collect():
        v = bundle(r["text"])
        cos = {k: float(v @ p / max(np.linalg.norm(v), 1e-12)) for k, p in profiles.items()}
        best = max(cos, key=lambda k: cos[k])
        want = (best, min(1.0, max(0.0, cos[best]))) if v.any() else ("und", 0.0)
        assert (r["lang_pred"], r["score"]) == (want[0], pytest.approx(want[1], abs=1e-4))


def test_word_vectors_by_brute_force(spark):
    """Each row's vector is the sum of its neighbours' index vectors up to two places away, made of length 1 and centred."""
    texts = ["one two three two", "two Three, 44 one!", "", None, "lone"]
    got = quality_net.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    sums = np.zeros((quality_net.ROWS, quality_net.DIM))
    for t in texts:
        rows, _ = quality_net.tokens([t])
        for i, own in enumerate(rows):
            for j in range(max(0, i - 2), min(len(rows), i + 3)):
                if i != j:
                    sums[own, quality_net._SPOT[rows[j]]] += quality_net._SIGN[rows[j]]
    used = np.flatnonzero(np.abs(sums).sum(axis=1))
    want = np.zeros_like(sums)
    want[used] = sums[used] / np.linalg.norm(sums[used], axis=1, keepdims=True)
    want[used] -= want[used].mean(axis=0)
    assert len(used) >= 6 and np.allclose(got, want, atol=1e-5)


def test_a_long_training_text_is_left_out(spark, monkeypatch):
    """A text that the byte bound has no room for is skipped, wherever it stands in the order."""
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 3000)
    rows = [(i, ("bad nasty words" if i % 2 else "kind calm words") + f" {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = docs.orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", 500)).otherwise(F.col("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = toxicity.learn_from(docs, labels)
    assert model.slope > 0 and np.abs(model.weight).sum() > 0
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in range(1, 60, 2) if i != first) > max(scores[i] for i in range(0, 60, 2) if i != first)


def test_common_words_never_exceed_their_bound(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    docs = spark.createDataFrame([(" ".join(w for w in words for _ in range(12_000 + 50 * k)),) for k in range(2)], "text string")
    import pyarrow as pa

    for most in (0, 2, 3, 500):
        sent = pa.ipc.open_stream(pieces.common_words(docs, pieces.load(), most).value).read_all()
        assert sent.num_rows <= most
    assert sent.num_rows >= 5


def test_pipeline_stages_on_empty_and_odd_tables(spark, odd):
    """All five stages: values, and the caller's columns under names that the operators use."""
    import corpus_pipeline

    clash = odd.withColumns({c: F.monotonically_increasing_id() for c in ("score", "predicted", "lang_pred", "exact", "decoded_sha256", "n_chars", "kept_1", "label")})
    clash = spark.createDataFrame(clash.collect(), clash.schema)
    given = {tuple(r) for r in clash.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, clash.limit(0), DATA).columns == clash.columns and stage(spark, clash.limit(0), DATA).count() == 0, name
        rows = stage(spark, clash, DATA).collect()
        assert rows and {tuple(r) for r in rows} <= given, name
        if name == "language ID":
            assert sorted(r["text"] for r in rows) == sorted(t for _, t, _, _ in ODD if t and t.strip())
        if name == "SimHash near-dedup":
            assert sorted(str(r["doc_id"]) for r in rows) == ["1", "3", "3", "4", "None"]
        if name.startswith("mixing"):
            assert max(sum(tuple(r) == x for r in rows) for x in given) <= mixing.MAX_REPEAT
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    coded = corpus_pipeline.encode_pieces(spark, clash.withColumn("ids", F.lit("mine")), DATA)
    assert coded.columns == [c for c in clash.columns if c != "text"] + ["ids", "ids_", "n_ids"]
    rows, texts = coded.collect(), {r["exact"]: r["text"] for r in clash.collect()}
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["ids"] == "mine" and r["ids_"] == model.encode(texts[r["exact"]] or "") and r["n_ids"] == len(r["ids_"])
    assert corpus_pipeline.encode_pieces(spark, clash.limit(0), DATA).count() == 0


def test_the_driver_plans_little_and_keeps_no_copies(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word {i % 3} of a text that goes on here", "en", "ab"[i % 2]) for i in range(12)], "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    # A table of fixed size is no view of a larger one.
    assert quality_net._SPOT.base is None and quality_net._SPOT.nbytes == quality_net.ROWS * quality_net.NONZERO

    def refused(*_: object) -> None:
        raise AssertionError("rows come to the driver one by one")

    monkeypatch.setattr(type(docs), "toPandas", refused)
    monkeypatch.setattr(type(docs), "first", refused)
    vectors = quality_net.word_vectors(docs)
    assert quality_net.learn(docs, labels, vectors).logits(np.zeros((1, quality_net.WIDTH))).shape == (1,)
    assert langid.prototypes(docs)[0] == ["en"]
    # A round of components takes no query besides those that write its edges.
    edges = spark.createDataFrame([(2, 1), (3, 2), (7, 5)], "u long, v long")
    assert sorted(map(tuple, simhash.components(edges).collect())) == [(2, 1), (3, 1), (7, 5)]
    # The mix is written before documents are joined to it, and the vocabulary is in no plan.
    assert mixing.repeat(docs)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    plan = pieces.encode(docs, pieces.load())._jdf.queryExecution().analyzed().toString()
    assert "LocalRelation" not in plan and "LogicalRDD" not in plan
