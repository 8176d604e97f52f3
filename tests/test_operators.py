"""Golden cases and planted faults."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import contracts, graph, text, windows
from palimpsest.plans.catalog import QUERIES
from palimpsest.plans.contracts import DECLARED


def test_line_spans(spark):
    docs = spark.createDataFrame([(1, "aé\n\nb\n"), (2, ""), (3, None), (4, "x")], "doc_id long, text string")
    got = sorted(tuple(r) for r in text.line_spans(docs).collect())
    assert got == [(1, 0, 0, 3, "aé"), (1, 1, 4, 0, ""), (1, 2, 5, 1, "b"), (4, 0, 0, 1, "x")]


def test_utf8_faults(spark):
    cases = {b"ok": (None, None), b"a\xff": (1, "bad lead"), b"\xc0\xaf": (0, "overlong"), b"\xed\xa0\x80": (0, "surrogate"), b"x\xe2\x82": (1, "truncated"), b"\xe2a\x82": (0, "bad continuation"), b"\xf5\x80\x80\x80": (0, "beyond range")}
    df = spark.createDataFrame([(k,) for k in cases], "b binary")
    got = {bytes(r["b"]): (r["f"]["fault_offset"], r["f"]["reason"]) for r in df.select("b", text.utf8_fault(df["b"]).alias("f")).collect()}
    assert got == cases


def test_owner_crosses_pages_and_ends(spark):
    lines = ["1 R501 program is unit", "2 or other", "Some text", "3 or orphan", "5.1 Heading here", "See there"]
    df = spark.createDataFrame([(1, 1 + i // 2, i, x) for i, x in enumerate(lines)], "doc int, page int, line_no int, line string")
    got = [(r["kind"], r["owner"]) for r in windows.owner_attribution(df, ["doc"], ["page", "line_no"]).orderBy("line_no").collect()]
    assert got == [("rule-start", "R501"), ("rule-continuation", "R501"), (None, None), (None, None), ("heading", None), ("cross-reference", None)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["depth"] for r in graph.reach(edges, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["node"]: r["level"] for r in graph.levels(edges).collect()} == {"d": 1, "c": 2, "b": 3, "a": 4, "x": None, "y": None, "z": None}
    assert {r["src"] for r in graph.pairs(edges).where("src = dst").collect()} == {"x", "y"}
    names = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")], "name string, next string")
    got = {r["name"]: (r["representative"], r["state"]) for r in graph.resolve_aliases(names).collect()}
    assert got == {"a": ("c", "resolved"), "b": ("c", "resolved"), "c": ("c", "not-alias"), "x": (None, "cyclic"), "y": (None, "cyclic"), "z": (None, "cyclic"), "s": (None, "cyclic")}


def test_glyphs(spark):
    words = ["R501", "program", "is", "unit"]
    rows, x, i = [], 0.0, 0
    for w in words:
        for c in w:
            rows.append((1, i, c, x, x + 5, 0.5 * (i % 2)))
            x, i = x + 5, i + 1
        x += 10
    rows.append((1, i, "[", 0.0, 5.0, 12.0))
    g = spark.createDataFrame(rows, "doc_id int, text_index int, ch string, x1 double, x2 double, y1 double")
    got = windows.canonical_page_text(windows.gap_spaces(windows.reading_order(g))).first()["page_text"]
    assert got == "R501 program is unit\n[\n"


@pytest.mark.parametrize(("line", "kind"), [("1 R5 a is b", "start"), ("2 or x", "or"), ("J3/24", "layout"), ("", "layout"), ("NOTE x y", "boundary"), ("3 or", "sequence"), ("Each thing must go", "boundary"), ("1 5.1 Head", "heading")])
def test_production_class(spark, line, kind):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(text.production_class(df["line"]).alias("k")).first()["k"] == kind


@pytest.mark.parametrize(("type_", "good", "bad"), [
    ("int", ["0", "-0", "12", "-7"], ["", "-", "007", "1.0", "+1", "12\n"]),
    ("bool", ["true", "false"], ["True", "0", ""]),
    ("name", ["a-b", "é"], ["", "a b", "(a)", 'q"', "b\\s"]),
    ("origin", ["llm", "llm-repair"], ["llm-", "repair"]),
    ("item", ["(relation)", '(syntax "a b")', "(syntax x)"], ["(syntax)", "(relation x)", "relation", "(other)"]),
    ("names", ["(names)", "(names a b)"], ["(name a)", "()", "names", "(names a  b)"]),
    ("source-ref-option", ["none", "(some (source-ref (document d) (clause 1) (rule R1) (page 3) (source-hash ab)))"], ["some", "(some none)", "(some (source-ref (clause 1) (document d) (rule R1) (page 3) (source-hash ab)))"]),
])
def test_patterns_of_types(spark, type_, good, bad):
    df = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "value string, want boolean")
    pattern = contracts.pattern(DECLARED, type_)
    assert [r["value"] for r in df.where(df["value"].rlike(rf"\A{pattern}\z") != df["want"]).collect()] == []


def test_nonconforming_records(spark):
    sound = [("id", "S1"), ("checked", "true"), ("page", "1"), ("origin", "smt"), ("resolution", "open"), ("body", "(rule)"), ("names", "(names)"), ("source", "none")]
    rows = [(1, i, *f) for i, f in enumerate(sound, 1)] + [(2, i, *f) for i, f in enumerate(sound[:4], 1)] + [(1, 9, "more", "x")]
    values = spark.createDataFrame(rows, "record_id long, position int, field string, value string")
    got = {tuple(r) for r in contracts.nonconforming(values, DECLARED, "fact").collect()}
    assert got == {(1, "resolution", "not of type enum"), (1, "more", "unknown field"), (1, None, "field count"), (2, None, "field count")}
    assert contracts.nonconforming(values.where("record_id = 3"), DECLARED, "fact").count() == 0


def test_registry(spark):
    d = spark.createDataFrame([(1, "pair", "record", None), (2, "many", "list", "pair"), (3, "many", "enum", None), (4, None, "optional", "gone"), (5, "either", "sum", None)], "decl_id long, name string, kind string, target string")
    m = spark.createDataFrame([(1, "left", "int"), (1, "left", "pair"), (1, "right", None), (3, "a", None), (3, None, None), (5, "yes", None), (5, "no", "lost")], "decl_id long, member string, type string")
    got = sorted((r["decl_id"], r["member"] or "", r["reason"]) for r in contracts.registry_faults(d, m).collect())
    assert got == [
        (1, "left", "duplicate member"), (1, "right", "unknown member type"), (2, "", "duplicate declaration"), (3, "", "empty member"),
        (4, "", "empty name"), (4, "", "unknown target type"), (5, "no", "unknown payload type"),
    ]


@pytest.mark.parametrize(("name", "reasons"), [("source_ref_check", 8), ("candidate_check", 10), ("trace_check", 32), ("layout_fact_check", 12), ("record_conformance", 9), ("schema_registry_check", 7)])
def test_planted_faults_are_all_found(spark, name, reasons):
    """Each condition of a contract is broken by some row, and is the reason given."""
    got = {r["reason"] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select("reason").distinct().collect()}
    assert len(got) == reasons, sorted(got)


def test_closure_states(spark):
    rules = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "ghost"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("none",)], "node string")
    want = {("a", "resolved"), ("b", "ambiguous"), ("c", "resolved"), ("ghost", "unresolved"), ("none", "missing root")}
    assert {tuple(r) for r in graph.closure(rules, edges, roots).collect()} == want
    assert [tuple(r) for r in graph.closure(rules, edges, roots.where("false")).collect()] == [(None, "no roots")]


def test_reach_keeps_depths_over_many_hops(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n0", "n5"), ("n12", "n0"), ("n3", "m")]
    got = graph.reach(spark.createDataFrame(chain, "src string, dst string"), spark.createDataFrame([("n0",)], "node string"))
    assert {r["node"]: r["depth"] for r in got.collect()} == {f"n{i}": i if i < 5 else i - 4 for i in range(13)} | {"m": 4}


def test_repeat_kinds_and_notation(spark):
    rows = [("r", 1, 1, "ref", "if-stmt"), ("r", 2, 1, "ref", "do-stmt"), ("r", 2, 2, "optional", "x"), ("r", 3, 1, "ref", "do-stmt"), ("r", 3, 2, "token", "END"), ("r", 4, 1, "repeat0", "y"), ("r", 5, 1, "repeat1", "z")]
    items = spark.createDataFrame(rows, "lhs string, alt int, pos int, item_kind string, name string")
    kinds = windows.repeat_kinds(items, F.col("name").endswith("-stmt"), "lhs", "alt").drop("lhs")
    assert {tuple(r) for r in kinds.collect()} == {(1, "direct", "if-stmt", "if-stmt"), (2, "compound", "sequence", "do-stmt"), (3, "unsupported", "expression", "do-stmt")}
    made = text.canonical_notation(items).first()["notation"]
    assert made == "if-stmt or do-stmt [ x ] or do-stmt END or [ y ] ... or z ..."
    assert spark.range(1).select(text.canonical_spacing(F.lit(" [y]...  or z"))).first()[0] == "[ y ] ... or z"
