"""Operators over ordered lines: spans of pages, glyphs, inherited state, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import text as T
from palimpsest.operators.graph import FROM_ALL, FROM_ONE
from palimpsest.operators.order import Carried, scan, scan_runs


def before(*keys: str, order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def upto(*keys: str, order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def page_spans(pages: DataFrame, source: str, page: str, text: str) -> DataFrame:
    """(source, page, byte_start, byte_length): pages laid end to end with a separator of one byte between. A source may have any number
    of pages."""
    rows = pages.select(F.col(source).alias("source"), F.col(page).alias("page"), F.octet_length(text).cast("long").alias("byte_length"))
    return scan(rows, ["source"], ["page"], Carried(sums={"byte_start": F.col("byte_length") + 1})).select("source", "page", F.col("byte_start").cast("long").alias("byte_start"), "byte_length")


def page_span_audit(spans: DataFrame) -> DataFrame:
    """(source, page, reason): the first fault of each source; none for a sound index."""
    rows = scan(spans, ["source"], ["page"], Carried(prior={"end": F.col("byte_start") + F.col("byte_length") + 1}))
    reason = F.when(F.col("byte_start") < 0, "negative").when(F.col("byte_length") < 0, "negative").when(F.col("byte_start") != F.coalesce("end", F.lit(0)), "gap or overlap")
    found = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    return found.groupBy("source").agg(F.min("page").alias("page"), F.min_by("reason", "page").alias("reason"))


def reading_order(glyphs: DataFrame, page: str = "doc_id", tolerance: float = 3.0) -> DataFrame:
    """All columns plus glyph_line and place: lines begin where y1 rises by more than the tolerance from the glyph before by
    y1; inside a line glyphs go by x1, then text_index. This is a total order."""
    g = glyphs.where(~F.col("ch").isin("\n", "\f", "\r"))
    by_y = Window.partitionBy(page).orderBy("y1", "x1", "text_index")
    new = F.col("y1") - F.lag("y1").over(by_y) > tolerance
    g = g.withColumn("new", F.coalesce(new, F.lit(False)).cast("long"))
    g = g.withColumn("glyph_line", F.sum("new").over(upto(page, order=["y1", "x1", "text_index"]))).drop("new")
    return g.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("glyph_line", "x1", "text_index")).cast("long"))


def gap_spaces(placed: DataFrame, page: str = "doc_id") -> DataFrame:
    """All columns plus gap: a blank belongs before this glyph."""
    w = Window.partitionBy(page, "glyph_line").orderBy("place")
    width = F.col("x2") - F.col("x1")
    wide = F.greatest(F.lit(1.0), 0.5 * F.greatest(width, F.lag(width).over(w)))
    gap = (F.lag("ch").over(w) != " ") & (F.col("ch") != " ") & (F.col("x1") - F.lag("x2").over(w) > wide)
    return placed.withColumn("gap", F.coalesce(gap, F.lit(False)))


def canonical_page_text(spaced: DataFrame, page: str = "doc_id") -> DataFrame:
    """(page, page_text): glyphs in order with their gaps, a line feed after each line."""
    piece = F.concat(F.when(F.col("gap"), " ").otherwise(""), F.col("ch"))
    lines = spaced.groupBy(page, "glyph_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", piece.alias("s")))), lambda x: x["s"]), "").alias("s"))
    return lines.groupBy(page).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_line", "s"))), lambda x: x["s"]), "\n"), F.lit("\n")).alias("page_text"))


def owner_attribution(lines: DataFrame, document: list[str], order: list[str]) -> DataFrame:
    """All columns plus number, kind and owner. Lines that go on a rule inherit it, across pages too; any other line ends
    it. order begins with the page: pages are bounded, a document may have any number of them, and what a page hands on to the next is
    its last event."""
    clean = T.without_number(F.col("line"))
    kind, goes_on = T.structure_kind(F.col("line"))
    rows = lines.withColumns({"number": T.printed_number(F.col("line")), "kind": kind, "goes_on": goes_on})
    event = F.when(F.col("kind") == "rule-start", F.regexp_extract(clean, "^(R[0-9]+)", 1)).when(~F.col("goes_on"), "")
    rows = scan_runs(rows, document, order[:1], order[1:], Carried(last={"owner": event}))
    rows = rows.withColumn("inside", F.col("goes_on") & (F.coalesce(F.col("owner"), F.lit("")) != ""))
    kept = F.when(F.col("goes_on") | (F.col("kind") == "rule-start"), F.nullif("owner", F.lit("")))
    return rows.withColumn("owner", kept).withColumn("kind", F.when(F.col("inside"), "rule-continuation").otherwise(F.col("kind"))).drop("goes_on", "inside")


def production_blocks(lines: DataFrame, document: list[str], order: list[str], sums: dict[str, Column] | None = None, dealt: bool = False) -> DataFrame:
    """Lines of productions: class, occurrence (number of the start), position in the block, rule, lhs, operator, content, and
    clause, the first number of the latest heading, on starts only. Layout lines neither end nor continue a block. Whether a block is
    open, its number, its head and the heading are carried from page to page, as in owner_attribution; so are sums, which are taken over all lines before. dealt as in scan_runs."""
    text = F.ltrim(T.without_number(F.col("line")))
    start = F.col("class") == "start"
    head = r"^(R[0-9]+) *([^ ].*?) is  *(.*)$"
    rows = lines.withColumn("class", T.production_class(F.col("line"))).withColumn("x", text)
    opens = F.when(start, True).when(F.col("class").isin("heading", "boundary"), False)
    heads = F.when(start, F.struct(F.regexp_extract("x", head, 1).alias("rule"), F.regexp_extract("x", head, 2).alias("lhs")))
    heading = F.when(F.col("class") == "heading", F.regexp_extract("x", "^([0-9]+)", 1))
    carried = Carried(sums={"starts": start.cast("long"), **(sums or {})}, last={"active": opens, "block": heads, "heading": heading})
    rows = scan_runs(rows, document, order[:1], order[1:], carried, dealt)
    rows = rows.withColumn("occurrence", (F.col("starts") + start.cast("long")).cast("long"))
    rows = rows.where("class = 'start' OR (class IN ('or', 'sequence') AND active)")
    return rows.withColumns({
        "operator": F.when(start, "is").otherwise(F.col("class")),
        "content": F.when(start, F.regexp_extract("x", head, 3)).when(F.col("class") == "or", F.trim(F.expr("substr(x, 4)"))).otherwise(F.col("x")),
        "clause": F.when(start, F.col("heading")),
        "position": (F.row_number().over(Window.partitionBy(*document, "occurrence").orderBy(*order)) - 1).cast("long"),
        "rule": F.col("block.rule"), "lhs": F.col("block.lhs"),
    }).drop("x", "active", "heading", "block", "starts")


def assemble_productions(blocks: DataFrame, document: list[str]) -> DataFrame:
    """(document, occurrence, rule, lhs, alternatives, production, lines): `or` opens an alternative, other lines go on with one blank."""
    w = upto(*document, "occurrence", order=["position"])
    rows = blocks.withColumn("alt", 1 + F.sum((F.col("operator") == "or").cast("long")).over(w))
    alt = rows.groupBy(*document, "occurrence", "rule", "lhs", "alt").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("position", "content")))), lambda x: x["content"]), " ").alias("s"), F.count("*").alias("n")
    )
    return alt.groupBy(*document, "occurrence", "rule", "lhs").agg(
        F.count("*").alias("alternatives"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alt", "s"))), lambda x: x["s"]), " | ").alias("production"), F.sum("n").alias("lines")
    )


def bracket_audit(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows whose brackets don't close, with the depth at the end and the least depth."""
    signs = F.transform(F.split(text, ""), lambda c: F.when(c == "[", 1).when(c == "]", -1).otherwise(0))
    depth = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("low")), lambda a, s: F.struct((a["now"] + s).alias("now"), F.least(a["low"], a["now"] + s).alias("low")))
    out = rows.withColumn("d", depth).select(*keys, F.col("d.now").cast("long").alias("open_at_end"), F.col("d.low").cast("long").alias("lowest"))
    return out.where("open_at_end <> 0 OR lowest < 0")


def repeat_kinds(items: DataFrame, statement: Column, *node: str) -> DataFrame:
    """(node, repeat_kind, item, derivations) of the repeats with a statement in them, items (item_kind, name) being what is repeated
    and statement telling which names are one. A lone reference is 'direct'; a sequence is 'compound' if all else in it can be
    empty, or 'unsupported'. Derivations are its statements, sorted, each once."""
    bearing = (F.col("item_kind") == "ref") & statement
    sound = bearing | F.col("item_kind").isin("optional", "repeat0")
    names = F.array_join(F.array_sort(F.collect_set(F.when(bearing, F.col("name")))), ",")
    g = items.groupBy(*node).agg(F.count("*").alias("n"), F.bool_and(sound).alias("sound"), F.bool_or(bearing).alias("bearing"), names.alias("derivations")).where("bearing")
    kind = F.when(F.col("n") == 1, "direct").when(F.col("sound"), "compound").otherwise("unsupported")
    item = F.when(F.col("n") == 1, F.col("derivations")).when(F.col("sound"), "sequence").otherwise("expression")
    return g.select(*node, kind.alias("repeat_kind"), item.alias("item"), "derivations")


def lineage(targets: DataFrame, pruned: DataFrame, aliases: DataFrame, omitted: DataFrame) -> DataFrame:
    """(kind, id, profile, detail, reason): the rows of all four, each (id, profile, detail), profile telling whether they were worked out for
    one root (`root`) or several (`set`); detail may be absent."""
    from_roots = F.when(F.col("profile") == "root", FROM_ONE).otherwise(FROM_ALL)
    rows = targets.withColumns({"kind": F.lit("target"), "reason": F.lit(None).cast("string")})
    for more, kind, reason in ((pruned, "pruned", from_roots), (aliases, "alias", F.lit("whole-unit-alias")), (omitted, "omitted-before", F.lit("omitted-before-target-lowering"))):
        rows = rows.unionByName(more.withColumns({"kind": F.lit(kind), "reason": reason}), allowMissingColumns=True)
    return rows.select("kind", "id", "profile", "detail", "reason")
