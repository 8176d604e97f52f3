"""Queries: windows over ordered lines and items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import glyphs as G
from palimpsest.operators import windows as W
from palimpsest.plans.fixtures import glyph_pages, query
from palimpsest.plans.text import KINDS, PRODUCTION

PAGES = """spans as (select source, doc_id as page, cast(coalesce(sum(strlen(text) + 1) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_start,
 cast(strlen(text) as bigint) as byte_length from documents)"""


@query("page_spans", f"with {PAGES} select * from spans")
def page_spans(t):
    return W.page_spans(t("documents"), "source", "doc_id", "text")


@query("page_span_audit", f"""with {PAGES}, bad as (select source, page, byte_start + case when page % 97 = 13 then 2 else 0 end as byte_start, byte_length from spans),
 r as (select *, case when byte_start <> coalesce(lag(byte_start + byte_length + 1) over (partition by source order by page), 0) then 'gap or overlap' end as reason from bad)
 select source, min(page) as page, 'gap or overlap' as reason from r where reason is not null group by source""")
def page_span_audit(t):
    """The index of all documents with starts moved where page % 97 = 13."""
    spans = W.page_spans(t("documents"), "source", "doc_id", "text")
    return W.page_span_audit(spans.withColumn("byte_start", F.col("byte_start") + F.when(F.col("page") % 97 == 13, 2).otherwise(0)))


PLACED = """+ g as (select * from glyphs where ch not in (chr(10), chr(12), chr(13)))
, n as (select *, coalesce(y1 - lag(y1) over (partition by doc_id order by y1, x1, text_index) > 3.0, false) as nw from g)
, l as (select * exclude (nw), cast(sum(cast(nw as int)) over (partition by doc_id order by y1, x1, text_index rows between unbounded preceding and current row) as bigint) as glyph_line from n)
, placed as (select *, row_number() over (partition by doc_id order by glyph_line, x1, text_index) as place from l)
, spaced as (select *, coalesce(lag(ch) over w <> ' ' and ch <> ' ' and x1 - lag(x2) over w > greatest(1.0, 0.5 * greatest(x2 - x1, lag(x2 - x1) over w)), false) as gap from placed window w as (partition by doc_id, glyph_line order by place))
, joined as (select doc_id, glyph_line, string_agg(case when gap then ' ' else '' end || ch, '' order by place) as s from spaced group by all)"""


@query("reading_order", PLACED + " select doc_id, text_index, glyph_line, place from placed", "glyphs")
def reading_order(t):
    return G.reading_order(glyph_pages(t("documents")))


@query("gap_spaces", PLACED + " select doc_id, count(*) filter (gap) as gaps, count(*) as glyphs from spaced group by doc_id", "glyphs")
def gap_spaces(t):
    return G.gap_counts(glyph_pages(t("documents")))


@query("canonical_page_text", PLACED + " select doc_id, string_agg(s, chr(10) order by glyph_line) || chr(10) as page_text from joined group by doc_id", "glyphs")
def canonical_page_text(t):
    return G.page_text(glyph_pages(t("documents")))


# A document of spec_lines is a run of ten pages, so that state crosses page breaks and no window holds the corpus.
def doc():
    return F.floor((F.col("page") - 1) / 10).cast("long")


KINDS_DOC = KINDS.replace("over (order by page, line_no", "over (partition by (page - 1) // 10 order by page, line_no")


@query("classify_structure_lines", KINDS_DOC + " select page, line_no, number, kind from classed", "spec_lines")
def classify_structure_lines(t):
    return W.owner_attribution(t("spec_lines").withColumn("doc", doc()), ["doc"], ["page", "line_no"]).select("page", "line_no", "number", "kind")


@query("owner_attribution", KINDS_DOC + " select page, line_no, kind, owner from classed where kind in ('rule-start', 'rule-continuation')", "spec_lines")
def owner_attribution(t):
    rows = W.owner_attribution(t("spec_lines").withColumn("doc", doc()), ["doc"], ["page", "line_no"])
    return rows.where("kind IN ('rule-start', 'rule-continuation')").select("page", "line_no", "kind", "owner")


BLOCKS = PRODUCTION + r"""
, st as (select *, (page - 1) // 10 as doc, last_value(case when class = 'start' then true when class in ('heading', 'boundary') then false end ignore nulls) over w as active,
 cast(sum(cast(class = 'start' as int)) over w as bigint) as occurrence, last_value(case when class = 'heading' then regexp_extract(x, '^([0-9]+)', 1) end ignore nulls) over w as hd
 from classed window w as (partition by (page - 1) // 10 order by page, line_no rows between unbounded preceding and current row))
, parts as (select *, case when class = 'start' then regexp_extract(x, '^(R[0-9]+) *([^ ].*?) is  *(.*)$', 1) end as r, case when class = 'start' then regexp_extract(x, '^(R[0-9]+) *([^ ].*?) is  *(.*)$', 2) end as l
 from st where class = 'start' or (class in ('or', 'sequence') and active))
, blocks as (select doc, page, line_no, occurrence, row_number() over b - 1 as position, first_value(r ignore nulls) over b as rule, first_value(l ignore nulls) over b as lhs,
 case class when 'start' then 'is' else class end as operator, case class when 'start' then regexp_extract(x, '^(R[0-9]+) *([^ ].*?) is  *(.*)$', 3) when 'or' then trim(substr(x, 4), ' ') else x end as content,
 case when class = 'start' then hd end as clause from parts window b as (partition by doc, occurrence order by page, line_no rows between unbounded preceding and current row))"""


def blocks_of(t):
    return W.production_blocks(t("spec_lines").withColumn("doc", doc()), ["doc"], ["page", "line_no"])


@query("production_blocks", BLOCKS + " select doc, page, line_no, occurrence, position, rule, lhs, operator, content from blocks", "spec_lines")
def production_blocks(t):
    return blocks_of(t).select("doc", "page", "line_no", "occurrence", "position", "rule", "lhs", "operator", "content")


@query("clause_carry_forward", BLOCKS + " select doc, occurrence, rule, clause from blocks where operator = 'is'", "spec_lines")
def clause_carry_forward(t):
    return blocks_of(t).where("operator = 'is'").select("doc", "occurrence", "rule", "clause")


ASSEMBLED = BLOCKS + """
, alts as (select *, 1 + cast(sum(cast(operator = 'or' as int)) over (partition by doc, occurrence order by position rows between unbounded preceding and current row) as bigint) as alt from blocks)
, folded as (select doc, occurrence, rule, lhs, alt, coalesce(string_agg(content, ' ' order by position) filter (content <> ''), '') as s, count(*) as n from alts group by all)
, made as (select doc, occurrence, rule, lhs, count(*) as alternatives, string_agg(s, ' | ' order by alt) as production, cast(sum(n) as bigint) as lines from folded group by all)"""


@query("assemble_productions", ASSEMBLED + " select * from made", "spec_lines")
def assemble_productions(t):
    return W.assemble_productions(blocks_of(t), ["doc"])


@query("bracket_audit", ASSEMBLED + """, btexts as (select doc, occurrence, case when occurrence % 7 = 3 then replace(production, ' ]', '') when occurrence % 11 = 5 then '] ' || production else production end as p from made)
 , c as (select doc, occurrence, unnest(string_split(p, '')) as ch, unnest(range(length(p))) as i from btexts)
 , d as (select *, sum(case ch when '[' then 1 when ']' then -1 else 0 end) over (partition by doc, occurrence order by i) as depth from c)
 select doc, occurrence, cast(sum(case ch when '[' then 1 when ']' then -1 else 0 end) as bigint) as open_at_end, cast(least(min(depth), 0) as bigint) as lowest from d group by doc, occurrence having open_at_end <> 0 or lowest < 0""", "spec_lines")
def bracket_audit(t):
    """Assembled productions, with brackets taken away or added in some of them."""
    p = F.expr("case when occurrence % 7 = 3 then replace(production, ' ]', '') when occurrence % 11 = 5 then concat('] ', production) else production end")
    return W.bracket_audit(W.assemble_productions(blocks_of(t), ["doc"]).withColumn("p", p), ["doc", "occurrence"], "p")




@query("sequence_internal", """+ items as (select *, ends_with(name, '-stmt') as bearing, item_kind in ('optional', 'repeat0') as nullable from rule_items)
, w as (select *, min(case when bearing then pos end) over r as nb, min(case when not nullable and not bearing then pos end) over r as nn, max(pos) over (partition by lhs, alt) as last from items window r as (partition by lhs, alt order by pos rows between 1 following and unbounded following))
 select lhs, alt, pos, name from w where bearing and pos < last and (coalesce(nb, 1000) < coalesce(nn, 1000) or nn is null)""", "rule_items")
def sequence_internal(t):
    """Statement items after which a statement comes before the first item that can't be empty, or nothing but items that can."""
    right = Window.partitionBy("lhs", "alt").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    rows = t("rule_items").withColumns({"bearing": F.col("name").endswith("-stmt"), "nullable": F.col("item_kind").isin("optional", "repeat0")})
    rows = rows.withColumns({"nb": F.min(F.when(F.col("bearing"), F.col("pos"))).over(right), "nn": F.min(F.when(~F.col("nullable") & ~F.col("bearing"), F.col("pos"))).over(right), "last": F.max("pos").over(Window.partitionBy("lhs", "alt"))})
    return rows.where("bearing AND pos < last AND (nb < nn OR nn IS NULL)").select("lhs", "alt", "pos", "name")


@query("first_plus_repeat", """+ w as (select *, max(cast(ends_with(name, '-stmt') as int)) over (partition by lhs, alt order by pos rows between unbounded preceding and 1 preceding) as b from rule_items)
 select lhs, alt, pos, name from w where item_kind = 'repeat0' and b = 1""", "rule_items")
def first_plus_repeat(t):
    """Repeats with a statement item before them in their sequence."""
    bearing = F.max(F.col("name").endswith("-stmt").cast("int")).over(W.before("lhs", "alt", order=["pos"]))
    return t("rule_items").withColumn("b", bearing).where("item_kind = 'repeat0' AND b = 1").select("lhs", "alt", "pos", "name")


@query("repeat_item_kinds", """+ marked as (select *, item_kind = 'ref' and ends_with(name, '-stmt') as bearing from rule_items)
, g as (select lhs, alt, count(*) as n, count(*) filter (not bearing and item_kind not in ('optional', 'repeat0')) as bad, string_agg(distinct name, ',' order by name) filter (bearing) as derivations from marked group by lhs, alt)
 select lhs, alt, case when n = 1 then 'direct' when bad = 0 then 'compound' else 'unsupported' end as repeat_kind, case when n = 1 then derivations when bad = 0 then 'sequence' else 'expression' end as item, derivations from g where derivations is not null""", "rule_items")
def repeat_item_kinds(t):
    """Repeats, an alternative being what is repeated."""
    return W.repeat_kinds(t("rule_items"), F.col("name").endswith("-stmt"), "lhs", "alt")
