"""Keys of any size: what runs along an order, digests, closures, components, ranges and trees, against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from palimpsest.operators import contracts, graph, groups, ranges, text, trees, windows
from palimpsest.operators.order import Carried, scan, scan_runs
from palimpsest.plans.catalog import QUERIES
from palimpsest.plans.fixtures import view
from palimpsest.sources import store

DATA = "/root/testdata/sf0.001"


def test_scan_along_keys_larger_than_a_range(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i // 10, i, rng.choice([None, 1, 5, 7]), rng.choice([None, "x", "y"])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, r int, i int, v long, t string").repartition(5)
    want, state = [], {}
    for k, _, i, v, t in rows:
        total, last, high = state.get(k, (0, None, None))
        now = last if t is None else t
        want.append((k, i, total, now, last, high))
        state[k] = (total + (v or 0), now, max((x for x in (high, v) if x is not None), default=None))
    carried = Carried({"s": F.col("v")}, {"l": F.col("t")}, {"p": F.col("t")}, {"h": F.col("v")})
    got = scan(df, ["k"], ["i"], carried).select("k", "i", "s", "l", "p", "h").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    named = df.where("k IS NOT NULL")
    got = scan_runs(named, ["k"], ["r"], ["i"], carried).select("k", "i", "s", "l", "p", "h").collect()
    assert sorted(map(tuple, got), key=str) == sorted((w for w in want if w[0]), key=str)
    assert scan(df.limit(0), ["k"], ["i"], carried).count() == 0


def test_one_document_of_all_pages(spark):
    """Owners and blocks of all lines as one document: the state crosses every page."""
    lines = view(spark, DATA, "spec_lines").withColumn("doc", F.lit(1))
    rows = sorted(map(tuple, lines.select("page", "line_no").collect()))
    owned = windows.owner_attribution(lines, ["doc"], ["page", "line_no"]).select("page", "line_no", "kind", "owner", "line").collect()
    by_place = {(r["page"], r["line_no"]): r for r in owned}
    assert sorted(by_place) == rows and len({p for p, _ in rows}) > 5
    owner = None
    for at in rows:
        r = by_place[at]
        if r["kind"] == "rule-start":
            owner = r["line"].split()[1]
        elif r["kind"] == "rule-continuation":
            assert r["owner"] == owner is not None
        else:
            owner = None if r["owner"] is None else owner
    blocks = windows.production_blocks(lines, ["doc"], ["page", "line_no"]).collect()
    seen, n = None, 0
    for r in sorted(blocks, key=lambda r: (r["page"], r["line_no"])):
        if r["operator"] == "is":
            n, seen = n + 1, r
            assert r["position"] == 0
        assert (r["occurrence"], r["rule"], r["lhs"]) == (n, seen["rule"], seen["lhs"])
    assert n == spark.read.parquet(f"{DATA}/orders.parquet").count()


def test_spans_of_one_source(spark):
    rows = [("s", i, "é" * (i % 7)) for i in range(300)]
    got = windows.page_spans(spark.createDataFrame(rows, "source string, page int, text string"), "source", "page", "text").collect()
    start = 0
    for r, (_, page, text) in zip(sorted(got, key=lambda r: r["page"]), rows, strict=True):
        assert (r["page"], r["byte_start"], r["byte_length"]) == (page, start, len(text.encode()))
        start += len(text.encode()) + 1
    assert windows.page_span_audit(spark.createDataFrame(got)).count() == 0


@pytest.mark.parametrize("fanout", [2, 3, 256])
def test_tree_digests(spark, fanout):
    rng = random.Random(fanout)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), i, f"text {i}" if i % 9 else None) for i in range(70)] + [("one", 100, "x")]
    got = groups.tree_digests(spark.createDataFrame(rows, "k string, i int, t string").repartition(4), "k", "i", "t", fanout).collect()

    def digest(texts):
        level = [hashlib.sha256(t.encode()).hexdigest() if t is not None else "" for t in texts]
        first = True
        while first or len(level) > 1:
            level = [hashlib.sha256("".join(level[i : i + fanout]).encode()).hexdigest() for i in range(0, len(level), fanout)]
            first = False
        return level[0]

    want = {k: [t for key, _, t in rows if key == k] for k in {r[0] for r in rows}}
    assert {r["key"]: (r["digest"], r["bytes"] or 0, r["pieces"]) for r in got} == {k: (digest(ts), sum(len(t) for t in ts if t), len(ts)) for k, ts in want.items()}


def test_members_are_rows(spark):
    rows = [("b", 3), (None, 1), ("b", 9), ("a", 5), (None, 7)]
    got = groups.members(spark.createDataFrame(rows, "k string, i int"), "k", "i").collect()
    assert sorted((r["order"], r["key"], r["member"], r["first"], r["members"], r["place"]) for r in got) == [(1, None, 1, 1, 2, 1), (3, "b", 1, 3, 2, 2), (5, "a", 1, 5, 1, 3), (7, None, 2, 1, 2, 1), (9, "b", 2, 3, 2, 2)]


def closure_of(edges):
    reach = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in seen:
                    seen.add(b)
                    todo.insert(0, b)
            todo.pop()
        reach[s] = seen
    return reach


def test_cycles_and_reach(spark):
    rng = random.Random(8)
    edges = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(75))] + [(f"n{i}", f"n{i + 1}") for i in range(60, 90)] + [("n90", "n80"), ("loop", "loop")]
    df = spark.createDataFrame(edges, "src string, dst string")
    reach = closure_of(edges)
    found = {r["node"]: r["component"] for r in graph.cycles(df).collect()}
    assert set(found) == {n for n in reach if n in reach[n]}
    assert all((found[a] == found[b]) == (b in reach[a] and a in reach[b]) for a in found for b in found)
    seeds = ["n60", "n3", "nowhere"]
    got = {r["node"]: r["depth"] for r in graph.reach(df, spark.createDataFrame([(s,) for s in seeds], "node string")).collect()}
    depth, frontier, d = {s: 0 for s in seeds}, set(seeds), 0
    while frontier:
        d += 1
        frontier = {b for a, b in edges if a in frontier} - set(depth)
        depth |= dict.fromkeys(frontier, d)
    assert got == depth
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("palimpsest")]
    one = graph.prune(df, spark.createDataFrame([("n60",)], "node string"))
    assert {r["reason"] for r in one.collect()} == {None, graph.FROM_ONE}
    assert graph.cycles(df.limit(0)).count() == 0


def test_every_fault_of_facts_and_every_status(spark):
    good = dict(source_term="t{}", target="x{}", document="d", clause="c", page=1, hash="a" * 64, codepoint="")
    good["class"] = "k"

    def fact(tbl, n, **other):
        return {"tbl": tbl, "fact": n} | {k: v.format(n) if isinstance(v, str) else v for k, v in good.items()} | other

    facts = [fact(1, 1), fact(1, 2), fact(1, 3, codepoint="processor-defined"), fact(2, 4, target=" "), fact(2, 5, hash="zz"), fact(2, 6), fact(2, 7, source_term="t5"), fact(2, 8, target="x5"), fact(3, 9), fact(3, 10), fact(4, 11)]
    spans = [(1, 1, 65, 90), (1, 2, 0x10FF00, 0x10FFFF), (1, 1, 97, 122), (2, 4, 1, 2), (2, 5, 5000, 4000), (2, 7, 0xD7FF, 0xD800), (2, 8, 3, 3), (3, 9, 10, 20), (3, 9, 20, 30), (3, 10, 12, 13), (4, 11, 48, 57)]
    kind = "tbl int, fact int, source_term string, target string, class string, document string, clause string, page int, hash string, codepoint string"
    names = [c.split()[0] for c in kind.split(", ")]
    f = spark.createDataFrame([tuple(r[n] for n in names) for r in facts], kind)
    r = spark.createDataFrame(spans, "tbl int, fact int, first long, last long")
    got = sorted(map(tuple, ranges.fact_faults(f, r).collect()))
    assert got == sorted([
        (2, 4, "lacks source term, class or target"), (2, 5, "lacks provenance"), (2, 5, "reversed range"), (2, 6, "has neither scalar nor range"), (2, 7, "repeats a source term"),
        (2, 7, "range outside Unicode scalars"), (2, 8, "repeats a target"), (3, 9, "overlapping ranges"), (3, 10, "overlapping ranges"),
    ])
    points = spark.createDataFrame([(1, 65), (1, 64), (1, 0x10FFFF), (1, 0x110000), (1, 0xD800), (1, -1), (2, 1), (3, 12), (3, 20), (3, 25), (4, 50), (4, 58), (9, 1)], "tbl int, cp long")
    looked = {(x["tbl"], x["cp"]): (x["status"], x["fact"]) for x in ranges.lookup(points, f, r, spark.createDataFrame([(3,)], "tbl int")).collect()}
    assert looked == {
        (1, 65): ("match", 1), (1, 64): ("unsupported", 3), (1, 0x10FFFF): ("match", 2), (1, 0x110000): ("invalid_scalar", None), (1, 0xD800): ("invalid_scalar", None), (1, -1): ("invalid_scalar", None),
        (2, 1): ("invalid_facts", None), (3, 12): ("ambiguous", None), (3, 20): ("match", 9), (3, 25): ("match", 9), (4, 50): ("match", 11), (4, 58): ("no_match", None), (9, 1): ("no_match", None),
    }


def test_pre_order_of_one_tree(spark):
    paths = ["rhs", "rhs/1", "rhs/1/1", "rhs/2", "rhs/2/1", "rhs/2/1/3", "rhs/2/10", "rhs/10"]
    rows = [(t, p) for t in ("x", "y") for p in paths]
    idx = trees.path_index(spark.createDataFrame(rows, "tree string, path string").repartition(3))
    assert sorted(map(tuple, idx.select("tree", "path", "idx").collect())) == sorted((t, p, i + 1) for t in ("x", "y") for i, p in enumerate(paths))
    spans = {(r["tree"], r["path"]): (r["last_idx"], r["nodes"]) for r in trees.subtree_span(idx).collect()}
    assert spans["x", "rhs"] == (8, 8) and spans["y", "rhs/2"] == (7, 4) and spans["x", "rhs/2/10"] == (7, 1)


def test_trees_normalised_at_any_depth(spark):
    rng = random.Random(6)
    empty = {"e1", "e2"}

    def make(depth):
        kind = rng.choice(["token", "reference"] if depth == 0 else ["token", "sequence", "choice", "sequence", "choice", "optional", "repeat"])
        if kind in ("token", "reference"):
            return (kind, rng.choice(["a", "b", "e1", "e2"]), 1, [])
        return (kind, "", rng.randint(0, 1), [make(depth - 1) for _ in range(rng.randint(1, 3) if kind in ("sequence", "choice") else 1)])

    def rewrite(node, path, log):
        """(kind, written, parts, inner, can be empty)"""
        kind, name, least, children = node
        if not children:
            written = f"'{name}'" if kind == "token" else name
            log.append((path, "identity", written))
            return (kind, written, None, None, kind == "reference" and name in empty)
        kids = [rewrite(c, f"{path}/{i + 1}", log) for i, c in enumerate(children)]
        first = kids[0]
        if kind == "optional":
            out = first if first[4] else (kind, f"[{first[1]}]", None, first, True)
            operation = "optional-wrapper-removal" if first[4] else "identity"
        elif kind == "repeat":
            gone = first[0] == "optional"
            inner, least = (first[3], 0) if gone else (first, least)
            out = (kind, f"{{{inner[1]}}}{least}", None, None, least == 0 or inner[4])
            operation = "optional-wrapper-removal" if gone else "identity"
        else:
            parts = []
            for i, k in enumerate(kids):
                for p in k[2] if k[0] == kind else [k]:
                    if kind == "sequence" or all(p[1] != q[1] for q in parts):
                        parts.append(p)
                    elif k[0] != kind:
                        log.append((f"{path}/{i + 1}", "choice-deduplicate", None))
            if len(parts) == 1:
                out, operation = parts[0], f"{kind}-collapse"
            else:
                mark, all_or_any = (" ", all) if kind == "sequence" else (" | ", any)
                out, operation = (kind, "(" + mark.join(p[1] for p in parts) + ")", parts, None, all_or_any(p[4] for p in parts)), f"{kind}-flatten"
        log.append((path, operation, out[1]))
        return out

    rows, want = [], []
    for t in range(60):
        node, log = make(rng.randint(0, 5)), []
        rewrite(node, "rhs", log)
        want += [(t, *x) for x in log]
        todo = [("rhs", node)]
        for path, (kind, name, least, children) in todo:
            rows.append((t, path, kind, name, least))
            todo += [(f"{path}/{i + 1}", c) for i, c in enumerate(children)]
    got = trees.normalized(spark.createDataFrame(rows, "tree int, path string, kind string, name string, minimum int"), spark.createDataFrame([(e,) for e in empty], "name string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert max(p.count("/") for _, p, *_ in rows) >= 4 and len({o for _, _, o, _ in want}) == 7


def test_alias_families(spark):
    rows = [
        ("rep", 1, None, "r0", "s0"), ("a", 1, "b", "r1", "s1"), ("b", 1, "rep", "r0", "s2"), ("kept", 1, "rep", "r9", "s9"), ("x", 1, "y", "r", "s"), ("y", 1, "x", "r", "s"),
        ("two", 1, "rep", "r2", "s3"), ("two", 2, None, "r3", "s3"), ("both", 1, "rep", "r", "s"), ("both", 2, "a", "r", "s"), ("user", 1, None, "u", "s"), ("user", 2, "a", "u", "s"), ("lost", 1, "ghost", "g", "s"),
    ]
    df = spark.createDataFrame(rows, "lhs string, alt int, ref string, role string, source string")
    retained, witness = graph.alias_families(df, spark.createDataFrame([("kept",), ("rep",)], "name string"))
    got = {r["name"]: (r["aliases"], r["refs"], r["roles"], r["provenance"]) for r in retained.collect()}
    assert got["rep"] == (2, [], ["r0", "r1"], ["s0", "s1", "s2"]) and got["user"] == (0, ["rep"], ["u"], ["s"])
    assert got["kept"] == (0, ["rep"], ["r9"], ["s9"]) and set(got) == {"rep", "kept", "x", "y", "two", "both", "user", "lost"}
    assert sorted(map(tuple, witness.collect()), key=str) == sorted([
        ("a", "rep", "factored", "whole-unit-alias"), ("b", "rep", "factored", "whole-unit-alias"), ("kept", "rep", "rejected", "protected-reachability-root"),
        ("x", None, "rejected", "cyclic-unit-alias"), ("y", None, "rejected", "cyclic-unit-alias"), ("two", "rep", "rejected", "multi-alternative-alias"), ("user", "rep", "rejected", "multi-alternative-alias"),
    ], key=str)


def test_readers_return_what_they_reject(spark, tmp_path):
    good = {"kind": "start", "name": "a", "n": 3}
    lines = [json.dumps(x) for x in (good, good | {"n": "x"}, {"kind": "start", "n": 1}, {"kind": "other"}, {"name": "a"}, good | {"more": 1}, {"kind": "start", "name": "b"})] + ["", "{", "[1]", '"text"']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    rows = store.read_jsonl(spark, str(tmp_path / "a.jsonl"), {"kind": "string", "name": "string", "n": "int"}, ("kind", "name"), ("start",)).collect()
    assert sorted((r["name"] or "", r["n"] or 0, r["has_n"], r["reject"] or "", r["line"] or "") for r in rows if not r["reject"]) == [("a", 3, True, "", ""), ("a", 3, True, "", ""), ("b", 0, False, "", "")]
    assert sorted((r["reject"], r["line"]) for r in rows if r["reject"]) == sorted([("invalid integer field n", lines[1]), ("missing field name", lines[2]), *(("no record", x) for x in lines[8:])])
    (tmp_path / "t").mkdir()
    (tmp_path / "t/good.tsv").write_text("a\tb\tc\n1\t2\tyes\n\n1\t\tno\n\t2\tyes\n1\t2\n1\t2\tperhaps\n")
    (tmp_path / "t/bare.tsv").write_text("1\t2\tyes\n")
    rows = store.read_tsv_checked(spark, str(tmp_path / "t"), ["a", "b", "c"], ("a",), {"c": ("yes", "no")}).collect()
    assert sorted((r["a"], r["b"] or "", r["c"]) for r in rows if not r["reject"]) == [("1", "", "no"), ("1", "2", "yes"), ("1", "2", "yes")]
    assert sorted((r["reject"], r["line"].rsplit("/", 1)[-1]) for r in rows if r["reject"]) == [("empty required field", "\t2\tyes"), ("fields: 2", "1\t2"), ("invalid header", "bare.tsv"), ("unknown c", "1\t2\tperhaps")]


def test_pairs_along_shortest_paths(spark):
    """Every pair, over cycles, diamonds and a path longer than a power of two, in rounds that double."""
    rng, written = random.Random(5), []
    edges = {(f"n{i}", f"n{i + 1}") for i in range(37)} | {(f"d{i}", f"d{j}") for i in range(12) for j in range(i + 1, 12)}
    edges |= {(f"c{rng.randrange(40)}", f"c{rng.randrange(40)}") for _ in range(50)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    keep = store.Dealt.write
    with pytest.MonkeyPatch.context() as m:
        m.setattr(store.Dealt, "write", lambda self, df, column: written.append(1) or keep(self, df, column))
        got = list(map(tuple, graph.pairs(spark.createDataFrame([*edges, *edges], "src string, dst string").repartition(3)).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    # Two tables a doubling: known pairs are neither written nor shuffled again.
    assert 0 < len(written) <= 2 * 7
    assert graph.pairs(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_lines_are_read_once(spark):
    """A scan along runs works its rows out once, whatever reads them, and the join with what pages hand on shuffles none of them."""
    worked_out = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(line):
        worked_out.add(1)
        return line

    lines = view(spark, DATA, "spec_lines").withColumn("doc", F.lit(1))
    n = lines.count()
    rows = scan_runs(lines.withColumn("line", seen("line")), ["doc"], ["page"], ["line_no"], Carried(sums={"at": F.octet_length("line")}))
    assert rows.where("at >= 0").select("line").distinct().count() > 0 and worked_out.value == n
    # Only the one row a page is dealt out for the join.
    assert rows._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(doc#") <= 3


def test_lines_and_records_are_dealt_out_once(spark, monkeypatch):
    """The audit of records writes their lines and the records once each, and finds the same in more buckets than shuffle partitions."""
    written = []
    for way in ("parquet", "saveAsTable"):
        real = getattr(DataFrameWriter, way)
        monkeypatch.setattr(DataFrameWriter, way, lambda self, *given, _real=real: (written.append(self._df.columns), _real(self, *given)))
    report = QUERIES["validity_report"](spark, DATA)
    assert sum(not {"line", "source_line"}.isdisjoint(columns) for columns in written) == 2
    want = sorted(map(tuple, report.collect()))
    monkeypatch.setattr(store, "TASK_ROWS", 600)  # ten buckets
    assert sorted(map(tuple, QUERIES["validity_report"](spark, DATA).collect())) == want


def test_records_are_compressed(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "'a field that repeats' as text")
    store.write_jsonl(rows, f"{tmp_path}/j")
    store.write_tsv(rows, f"{tmp_path}/t")
    for name in ("j", "t"):
        assert sum(p.stat().st_size for p in (tmp_path / name).glob("part-*")) < 20_000
    assert spark.read.text(f"{tmp_path}/j").count() == store.read_tsv(spark, f"{tmp_path}/t", "id long, text string").count() == 2000


def test_references_inside_their_line(spark):
    rows = spark.createDataFrame([(1, "a  b a C-1 b-2 a"), (2, ""), (3, None), (4, " x X x")], "n int, line string")
    found = text.references(rows, "line").select("n", "name", "first_position")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 0), (1, "b", 1), (1, "b-2", 4), (4, "x", 0)]
    plan = text.references(view(spark, DATA, "lines"), "line")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_keys_are_grouped_once(spark):
    """Words are worked out for their ids and first places together, and once more for the rows themselves."""
    worked_out = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(word):
        worked_out.add(1)
        return word

    words = spark.range(600).select("id", F.concat(F.lit("w"), F.col("id") % 7).alias("word")).withColumnRenamed("id", "pos").withColumn("word", seen("word").alias("word"))
    groups.intern(words.where("word <> ''"), "word", "pos").collect()
    once = worked_out.value
    got = groups.interned(words, "word", "pos").collect()
    assert {(r["word"], r["id"]) for r in got} == {(f"w{i}", i + 1) for i in range(7)} and [r["pos"] for r in got if r["is_new"]] == list(range(7))
    assert once and worked_out.value - once <= 2.5 * once


def test_names_that_can_be_empty(spark):
    """Against plain Python. Rounds join references alone: what needs no name is written once and in no join by a name."""
    rng, rows = random.Random(4), []
    for i in range(80):
        for alt in range(rng.randint(1, 3)):
            for _ in range(rng.randint(1, 3)):
                kind = rng.choice(["token", "optional", "repeat0", "ref", "ref"])
                rows.append((f"n{i}", alt, kind, f"n{rng.randrange(90)}" if kind == "ref" else "x"))
    rows += [(f"c{i}", 1, "ref", f"c{i + 1}") for i in range(6)] + [("c6", 1, "optional", "x"), ("c6", 1, "ref", "c6"), ("c6", 2, "repeat0", "x"), ("gone", 1, "ref", None), ("gone", 1, "optional", "x")]
    items = {}
    for lhs, alt, kind, name in rows:
        items.setdefault((lhs, alt), []).append((kind, name))
    want = set()
    while more := {lhs for (lhs, _), xs in items.items() if all(k in ("optional", "repeat0") or k == "ref" and (n is None or n in want) for k, n in xs)} - want:
        want |= more
    dealt, keep = [], store.Dealt.write
    with pytest.MonkeyPatch.context() as m:
        m.setattr(store.Dealt, "write", lambda self, df, column: dealt.append(column) or keep(self, df, column))
        got = graph.nullable(spark.createDataFrame(rows, "lhs string, alt int, item_kind string, name string"))
    assert sorted(r["lhs"] for r in got.collect()) == sorted(want) and "c0" in want and len(want) > 20
    assert dealt[0] == "need" and len(dealt) > 2 and set(dealt[1:]) == {"lhs"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("palimpsest")]
    assert graph.nullable(spark.createDataFrame([], "lhs string, alt int, item_kind string, name string")).count() == 0


@pytest.mark.parametrize("name", ["candidate_check", "source_ref_check"])
def test_rules_are_compiled(spark, name):
    """Longer methods than 8,000 bytes are interpreted."""
    stages = QUERIES[name](spark, DATA)._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_no_texts_are_joined_to_labels(spark):
    plan = view(spark, DATA, "semantic_items")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan.split("Join", 1)[0] and "sha2(" in plan.split("Join", 1)[1]


def test_only_references_are_looked_up(spark, monkeypatch):
    """Nodes without a name are in no join by the name."""
    written, keep = {}, trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda df, label: written.setdefault(label, keep(df, label)) if label == "references" else keep(df, label))
    rows = [(t, p, k, n, 1) for t in range(40) for p, k, n in (("rhs", "choice", ""), ("rhs/1", "reference", "e"), ("rhs/2", "sequence", ""), ("rhs/2/1", "token", "e"), ("rhs/2/2", "reference", "f"))]
    got = trees.normalized(spark.createDataFrame(rows, "tree int, path string, kind string, name string, minimum int"), spark.createDataFrame([("e",)], "name string"))
    assert got.where("written = \"(e | ('e' f))\"").count() == 40
    assert sorted({(r["kind"], r["name"], r["known"]) for r in written["references"].collect()}) == [("reference", "e", True), ("reference", "f", False)] and written["references"].count() == 80


def test_tasks_follow_the_number_of_members(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 10)
    decls = [(i, f"d{i}", ("record", "sum", "list", "enum")[i % 4], None if i % 3 else "d1") for i in range(40)] + [(40, "d0", "record", None)]
    members = [(i % 40, f"m{i}", (None, "int", "d3", "ghost", "")[i % 5]) for i in range(200)] + [(0, "m0", "int")]
    df = contracts.registry_faults(spark.createDataFrame(decls, "decl_id int, name string, kind string, target string"), spark.createDataFrame(members, "decl_id int, member string, type string"))
    want = [(0, None, "duplicate declaration"), (0, "m0", "duplicate member")]
    want += [(d, m, "unknown member type") for d, m, t in members if d % 4 == 0 and t in (None, "", "ghost")] + [(d, m, "unknown payload type") for d, m, t in members if d % 4 == 1 and t == "ghost"]
    want += [(d, None, "unknown target type") for d, _, k, t in decls if k == "list" and t is None]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 21" in plan


def test_frequent_tokens_are_dealt_out_by_line_too(spark):
    plan = QUERIES["lexicalize_tokens"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [token#" in plan and "lane#" in plan.split("RepartitionByExpression [token#", 1)[1].split("\n")[0]
