"""Queries: validation, lineage, orders, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import text as T
from palimpsest.operators.audit import validity
from palimpsest.operators.contracts import first_fault
from palimpsest.operators.order import Carried, ranked, scan_runs
from palimpsest.plans.fixtures import query
from palimpsest.plans.text import SPANS
from palimpsest.operators import windows as W
from palimpsest.plans.windows import ASSEMBLED, BLOCKS, blocks_of, doc
from palimpsest.sources import store

# Fixed values of the domains.
ORIGINS = ("mechanical", "search", "smt", "llm", "llm-repair", "human", "imported", "differential")
RESOLUTIONS = ("resolved", "unresolved", "disputed")

def _in(column: str, names: tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(f"'{n}'" for n in names)})"


# What sound rows fulfil, in the order in which faults are reported; a condition that is null is a fault.
SOURCE_RULES = {"document": "document <> ''", "clause": "clause <> ''", "rule": "rule <> ''", "hash": "source_hash <> ''", "page": "page > 0"}
DOMAIN_RULES = {"origin": _in("origin", ORIGINS), "resolution": _in("resolution", RESOLUTIONS)}
ITEM_RULES = {"id": "id <> ''", "subject": "subject <> ''"} | SOURCE_RULES | DOMAIN_RULES
SOURCE = first_fault(SOURCE_RULES)
# The same for DuckDB, from lists of faults rather than from conditions.
_NO_SOURCE = "[case when nullif(document, '') is null then 'document' end, case when nullif(clause, '') is null then 'clause' end, case when nullif(rule, '') is null then 'rule' end, case when nullif(source_hash, '') is null then 'hash' end, case when greatest(coalesce(page, 0), 0) = 0 then 'page' end]"
_NO_DOMAIN = f"[case when not list_contains({list(ORIGINS)}, coalesce(origin, '')) then 'origin' end, case when not list_contains({list(RESOLUTIONS)}, coalesce(resolution, '')) then 'resolution' end]"
_NO_ITEM = f"list_concat([case when nullif(id, '') is null then 'id' end, case when nullif(subject, '') is null then 'subject' end], {_NO_SOURCE}, {_NO_DOMAIN})"


def first_of(faults_: str) -> str:
    return f"list_filter({faults_}, lambda x: x is not null)[1]"


SOURCE_SQL = first_of(_NO_SOURCE)


def faults(rows: DataFrame, reason: str) -> DataFrame:
    """(pos, reason): the first fault of each row, by an ordered CASE; sound rows give none."""
    return rows.select("pos", F.expr(reason).alias("reason")).where("reason IS NOT NULL")


def checked(name: str, rules: dict[str, str], sql: str) -> None:
    query(name, f"+ f as (select pos, {first_of(sql)} as reason from checked_items) select * from f where reason is not null", "semantic_items", "checked_items")(lambda t: faults(t("checked_items"), first_fault(rules)))


checked("item_check", ITEM_RULES, _NO_ITEM)
checked("enum_domain_check", DOMAIN_RULES, _NO_DOMAIN)


@query("span_audit", SPANS + """, given as (select doc_id, line_no, line, byte_start + case when line_no % 7 = 3 then 2 else 0 end as s, byte_length + case when line_no % 11 = 5 then 100000 else 0 end as n from spans)
 select g.doc_id, line_no, case when s + n > strlen(text) then 'out of range' else 'other text' end as reason from given g join documents using (doc_id)
 where s + n > strlen(text) or encode(text)[s + 1:s + n] <> encode(line)""", "lines")
def span_audit(t):
    """Lines that don't come out of their document at their span, or whose span leaves it; some are moved by two bytes, some
    made too long. Each line is cut inside the row of its document."""
    def moved(s: Column) -> Column:
        return s["byte_start"] + F.when(s["line_no"] % 7 == 3, 2).otherwise(0)

    def size(s: Column) -> Column:
        return s["byte_length"] + F.when(s["line_no"] % 11 == 5, 100000).otherwise(0)

    return T.cut_spans(t("documents"), moved, size).where("reason IS NOT NULL").select("doc_id", "line_no", "reason")


# Spellings are given for every third part's scalar, some empty, some of several bytes.
_SPELLED = "select 8000 + p_partkey as cp, case when p_partkey % 21 = 0 then '' when p_partkey % 33 = 0 then 'é' else concat('sp-', p_partkey) end as spelling from part where p_partkey % 3 = 0 union all select 233, 'e-acute'"


@query("canonical_spelling", f"""with c as (select distinct unnest(string_split(text, '')) as ch from documents where text <> ''), cps as (select cast(unicode(ch) as bigint) as cp, strlen(ch) as width from c union select 8000 + p_partkey, 3 from part)
, given as ({_SPELLED}) select cps.cp, case when spelling <> '' and strlen(spelling) = length(spelling) then spelling else '' end as spelling,
 case when spelling <> '' and strlen(spelling) > length(spelling) then 'spelling beyond ASCII' when coalesce(spelling, '') = '' and width > 1 then 'needs a spelling' end as fault from cps left join given using (cp)""")
def canonical_spelling(t):
    """The spelling of each scalar: that of a table if it has one; none for ASCII; scalars beyond it need one."""
    part = t("part")
    cps = T.codepoints(t("documents")).select("cp", "width").unionByName(part.select((8000 + F.col("p_partkey")).alias("cp"), F.lit(3).cast("long").alias("width"))).distinct()
    given = part.where("p_partkey % 3 = 0").select((8000 + F.col("p_partkey")).alias("cp"), F.expr("case when p_partkey % 21 = 0 then '' when p_partkey % 33 = 0 then 'é' else concat('sp-', p_partkey) end").alias("spelling"))
    given = given.unionByName(part.sparkSession.range(1).select(F.lit(233).cast("long").alias("cp"), F.lit("e-acute").alias("spelling")))
    return T.spelled(cps, given)


@query("span_order_audit", SPANS + ", p as (select doc_id, line_no, byte_start - case when line_no % 5 = 3 then 4 else 0 end as s, byte_length from spans), q as (select *, lag(s + byte_length) over (partition by doc_id order by line_no) as e from p) select doc_id, line_no from q where s < e", "lines")
def span_order_audit(t):
    """Spans that begin before the one before them ends; every fifth is moved to plant some."""
    s = F.col("byte_start") - F.when(F.col("line_no") % 5 == 3, 4).otherwise(0)
    p = T.line_spans(t("documents")).select("doc_id", "line_no", s.alias("s"), "byte_length")
    return p.withColumn("e", F.lag(F.col("s") + F.col("byte_length")).over(Window.partitionBy("doc_id").orderBy("line_no"))).where("s < e").select("doc_id", "line_no")


MOVED = BLOCKS + ", moved as (select *, case when line_no % 23 = 4 then occurrence - 1 else occurrence end as given from blocks)"


@query("occurrence_audit", MOVED + """, a as (select *, last_value(case when operator = 'is' then given end ignore nulls) over w as active, lag(case when operator = 'is' then given end) over (partition by doc, operator = 'is' order by page, line_no) as prev from moved window w as (partition by doc order by page, line_no rows between unbounded preceding and current row))
 select doc, page, line_no, case when operator = 'is' then 'not increasing' else 'other start' end as reason from a where (operator = 'is' and given <= prev) or (operator <> 'is' and given <> active)""", "spec_lines")
def occurrence_audit(t):
    """Starts whose number doesn't rise, and continuations that carry another number than their start."""
    rows = blocks_of(t).withColumn("given", F.when(F.col("line_no") % 23 == 4, F.col("occurrence") - 1).otherwise(F.col("occurrence"))).withColumn("st", F.col("operator") == "is")
    rows = rows.select("doc", "page", "line_no", "given", "st")
    started = F.when(F.col("st"), F.col("given"))
    rows = scan_runs(rows, ["doc"], ["page"], ["line_no"], Carried(prior={"prev": started}, last={"active": started}))
    rows = rows.where("(st AND given <= prev) OR (NOT st AND given <> active)")
    return rows.select("doc", "page", "line_no", F.when(F.col("st"), "not increasing").otherwise("other start").alias("reason"))


@query("duplicate_span_audit", "with g as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2) select cast(coalesce(sum(n * (n - 1) // 2), 0) as bigint) as duplicate_pairs, count(*) filter (n > 1) as spans from g")
def duplicate_span_audit(t):
    """Pairs of rows that share a span; (order, line number) stands for the span."""
    g = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("duplicate_pairs"), F.count(F.when(F.col("n") > 1, 1)).alias("spans"))


@query("all_or_nothing", f"+ g as (select id, count(*) as n, count(*) filter ({SOURCE_SQL} is null) as sound from checked_items where id is not null group by id) select pos, id from checked_items join g using (id) where n = sound", "semantic_items", "checked_items")
def all_or_nothing(t):
    """A batch (rows of an id) goes out only if each of its rows is sound; rows without an id are in no batch."""
    items = t("checked_items")
    ok = items.groupBy("id").agg(F.bool_and(F.expr(f"{SOURCE} is null")).alias("ok")).where("ok").select("id")
    return items.hint("merge").join(ok, "id", "left_semi").select("pos", "id")


@query("witness_set_equality", "with e as (select distinct o_custkey as k from orders where o_custkey % 17 <> 4), a as (select c_custkey as k from customer where c_custkey % 19 <> 5 union all select c_custkey from customer where c_custkey % 23 = 6) select k, 'missing' as fault from e where k not in (select k from a) union all select distinct k, 'unexpected' from a where k not in (select k from e) union all select k, 'twice' from a group by k having count(*) > 1")
def witness_set_equality(t):
    """Expected witnesses (customers that ordered) against the actual ones (customers); some of each are taken away, and some
    stand twice."""
    e = t("orders").where("o_custkey % 17 <> 4").select(F.col("o_custkey").alias("k")).distinct()
    a = t("customer").select(F.col("c_custkey").alias("k"))
    a = a.where("k % 19 <> 5").unionByName(a.where("k % 23 = 6"))
    once = a.groupBy("k").agg(F.count("*").alias("n"))
    out = e.exceptAll(once.select("k")).withColumn("fault", F.lit("missing")).unionByName(once.select("k").exceptAll(e).withColumn("fault", F.lit("unexpected")))
    return out.unionByName(once.where("n > 1").select("k", F.lit("twice").alias("fault")))


@query("lineage_witness", """with p as (select p_partkey, p_brand, p_size, concat('S', p_partkey) as id, case p_partkey % 3 when 0 then 'set' else 'root' end as profile from part), n as (select nt.*, case n_nationkey % 3 when 0 then 'set' else 'root' end as profile from nation nt)
 select 'target' as kind, id, profile, p_brand as detail, null as reason from p where p_size >= 10 and p_partkey % 7 <> 2 union all select 'pruned', id, profile, null, case profile when 'root' then 'not-reachable-from-selected-root' else 'not-reachable-from-declared-roots' end from p where p_size < 10 and p_partkey % 7 <> 2
 union all select 'alias', n_name, profile, cast(n_regionkey as varchar), 'whole-unit-alias' from n
 union all select 'omitted-before', id || '/' || unnest(range(1, cast(1 + p_size % 3 as bigint) + 1)), profile, p_brand, 'omitted-before-target-lowering' from p where p_partkey % 7 = 2""")
def lineage_witness(t):
    """One table of what became of all rows, in the profile of a root or of a set of roots: targets, pruned rows, aliases, and rows left out
    before, one for each of their alternatives."""
    def profile(c: str) -> Column:
        return F.when(F.col(c) % 3 == 0, "set").otherwise("root").alias("profile")

    part = t("part").select(F.concat(F.lit("S"), "p_partkey").alias("id"), profile("p_partkey"), F.col("p_brand").alias("detail"), "p_size", (F.col("p_partkey") % 7 == 2).alias("left_out"))
    alternatives = F.sequence(F.lit(1), 1 + F.col("p_size") % 3)
    omitted = part.where("left_out").withColumn("n", F.explode(alternatives)).select(F.concat_ws("/", "id", "n").alias("id"), "profile", "detail")
    aliases = t("nation").select(F.col("n_name").alias("id"), profile("n_nationkey"), F.col("n_regionkey").cast("string").alias("detail"))
    return W.lineage(part.where("NOT left_out AND p_size >= 10").select("id", "profile", "detail"), part.where("NOT left_out AND p_size < 10").select("id", "profile"), aliases, omitted)


@query("lineage_coverage", """with kept as (select text, min(doc_id) as k from documents group by text), named as (select doc_id, k from documents d join kept on d.text is not distinct from kept.text), gone as (select * from named where doc_id <> k)
 , refs as (select o.doc_id, case when o.doc_id % 3 = 1 then o.doc_id + 1 else coalesce(gone.k, o.doc_id + 1) end as ref from named o left join gone on gone.doc_id = o.doc_id + 1 where o.doc_id = o.k)
 select doc_id, 'neither retained nor witnessed' as fault from gone where doc_id % 9 = 4 union all select doc_id, 'refers to a removed row' from refs where ref in (select doc_id from gone)""")
def lineage_coverage(t):
    """Removed rows (all but the first of their text) without a witness, some being taken away, and retained rows that still refer to
    a removed one. A row refers to the id after its own; references are led to retained rows, but for some that are left."""
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    kept = docs.groupBy("h").agg(F.min("doc_id").alias("k")).withColumnRenamed("h", "kh")
    named = store.materialize(docs.hint("merge").join(kept, F.col("h").eqNullSafe(F.col("kh"))).select("doc_id", "k"), "lineage")
    gone = named.where("doc_id <> k")
    lost = gone.hint("merge").join(named.where("doc_id % 9 <> 4").select("doc_id"), "doc_id", "left_anti")
    refs = named.where("doc_id = k").select("doc_id", (F.col("doc_id") + 1).alias("ref"))
    refs = refs.hint("merge").join(gone.select(F.col("doc_id").alias("ref"), "k"), "ref", "left")
    refs = refs.select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.col("ref")).otherwise(F.coalesce("k", "ref")).alias("ref"))
    stale = refs.hint("merge").join(gone.select(F.col("doc_id").alias("ref")), "ref", "left_semi")
    out = lost.select("doc_id", F.lit("neither retained nor witnessed").alias("fault"))
    return out.unionByName(stale.select("doc_id", F.lit("refers to a removed row").alias("fault")))


@query("source_witness_refresh", "+ have as (select id, document from semantic_items where pos % 4 <> 1) select distinct id, document, (id, document) not in (select (id, document) from have) as added from semantic_items", "semantic_items")
def source_witness_refresh(t):
    """A witness for each source of an item; added where there was none."""
    items = t("semantic_items").select("id", "document", "pos")
    have = items.where("pos % 4 <> 1").select("id", "document").distinct().withColumn("have", F.lit(True))
    return items.select("id", "document").distinct().join(have, ["id", "document"], "left").select("id", "document", F.col("have").isNull().alias("added"))


@query("site_order", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, row_number() over (order by cast(l_orderkey as hugeint), l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as place from lineitem")
def site_order(t):
    """Total order with numbers that may come as text: leading zeros don't count, longer is greater."""
    key = [F.concat(F.lit("00"), "l_orderkey").cast("decimal(38,0)").alias("n"), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))]
    rows = t("lineitem").select(*key, "l_orderkey")
    return ranked(rows, ["n", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).drop("n")


@query("candidate_order", "+ d as (select distinct lhs, alt, pos, name from rule_items) select *, row_number() over (order by lhs, alt, pos, name) as place from d", "rule_items")
def candidate_order(t):
    return ranked(t("rule_items").select("lhs", "alt", "pos", "name").distinct(), ["lhs", "alt", "pos", "name"])


@query("rule_order", "select doc_id, source, row_number() over (order by source, doc_id) as place from documents")
def rule_order(t):
    """By source alone, stable: the input's order breaks ties."""
    return ranked(t("documents").select("doc_id", "source"), ["source", "doc_id"])


@query("trace_order", "select pos, id, origin, row_number() over (order by id, origin, pos) as place from semantic_items", "semantic_items")
def trace_order(t):
    return ranked(t("semantic_items").select("id", "origin", "pos"), ["id", "origin", "pos"])


@query("page_range", "select page, line_no, line from spec_lines where page between 11 and 20", "spec_lines")
def page_range(t):
    return t("spec_lines").where(F.col("page").between(11, 20))


# Fields of a production record in the order in which they are written, those that must be there, and the kinds.
PRODUCTION_FIELDS = {
    "kind": "string", "rule": "string", "lhs": "string", "operator": "string", "text": "string", "page": "int", "byte_start": "long", "byte_length": "long",
    "occurrence": "int", "occurrence_clause": "string", "source_line": "string",
}
PRODUCTION_REQUIRED = ("kind", "rule", "lhs", "operator", "text", "page", "byte_start", "byte_length")
PRODUCTION_KINDS = ("production-start", "production-continuation")
HEADER = '{"format":"productions","origin":"MECHANICAL"}'

RECORDS = BLOCKS + """, starts as (select (page - 1) // 10 as doc, page, line_no, line, coalesce(sum(strlen(line) + 1) over (partition by (page - 1) // 10 order by page, line_no rows between unbounded preceding and 1 preceding), 0) as byte_start from spec_lines)
, recs as (select case operator when 'is' then 'production-start' else 'production-continuation' end as kind, rule, lhs, operator, content as text, b.page, cast(byte_start as bigint) as byte_start, cast(strlen(line) as bigint) as byte_length, occurrence, clause, line as source_line, b.line_no, b.doc
 from blocks b join starts using (doc, page, line_no))
, written as (select *, '{"kind":"' || kind || '","rule":"' || rule || '","lhs":"' || lhs || '","operator":"' || operator || '","text":"' || text || '","page":' || page || ',"byte_start":' || byte_start || ',"byte_length":' || byte_length || ',"occurrence":' || occurrence
 || case when clause is null then '' else ',"occurrence_clause":"' || clause || '"' end || ',"source_line":"' || source_line || '","origin":"MECHANICAL"}' as record from recs)"""


def spanned_blocks(t) -> DataFrame:
    """Blocks of productions with the bytes of their lines; both run along a document at once."""
    return W.production_blocks(t("spec_lines").withColumn("doc", doc()), ["doc"], ["page", "line_no"], {"byte_start": F.octet_length("line") + 1})


def records(blocks: DataFrame) -> DataFrame:
    """Production records of all documents, with their spans in their document."""
    kind = F.when(F.col("operator") == "is", PRODUCTION_KINDS[0]).otherwise(PRODUCTION_KINDS[1])
    return blocks.select(kind.alias("kind"), "rule", "lhs", "operator", F.trim("content").alias("text"), "page", F.col("byte_start").cast("long"), F.octet_length("line").cast("long").alias("byte_length"),
                       "occurrence", F.col("clause").alias("occurrence_clause"), F.col("line").alias("source_line"), "line_no", "doc")


@query("read_productions_jsonl", RECORDS + """, lines as (select *, case when line_no % 31 = 4 then replace(record, '"page":', '"page":"x') when line_no % 29 = 3 then replace(record, '"byte_length"', '"length"') when line_no % 43 = 7 then replace(record, '"byte_start":', '"byte_start":true,"was":') when line_no % 37 = 5 then left(record, length(record) - 20)
 when line_no % 41 = 6 then replace(record, 'production-', 'other-') else record end as line, case when line_no % 31 = 4 then 'no record' when line_no % 29 = 3 then 'missing field byte_length' when line_no % 43 = 7 then 'invalid integer field byte_start' when line_no % 37 = 5 then 'no record' end as reject from written where line_no % 31 = 4 or line_no % 29 = 3 or line_no % 43 = 7 or line_no % 37 = 5 or line_no % 41 <> 6)
 select case when reject is null then kind end as kind, case when reject is null then rule end as rule, case when reject is null then lhs end as lhs, case when reject is null then operator end as operator, case when reject is null then text end as text, case when reject is null then page end as page,
 case when reject is null then byte_start end as byte_start, case when reject is null then byte_length end as byte_length, case when reject is null and line_no % 5 <> 2 then occurrence end as occurrence, case when reject is null then clause end as occurrence_clause, case when reject is null then source_line end as source_line,
 case when reject is null then line_no % 5 <> 2 end as has_occurrence, case when reject is null then clause is not null end as has_occurrence_clause, case when reject is null then true end as has_source_line, coalesce(reject, null) as reject,
 case when reject is not null then case when line_no % 5 = 2 then replace(line, '"occurrence":', '"number":') else line end end as line from lines""", "spec_lines")
def read_productions_jsonl(t):
    """All production records written as JSON lines and read back; some are of another kind, some lack a field or an optional one, some
    are cut off or have a page that ends the object."""
    rows = records(spanned_blocks(t))
    record = F.to_json(F.struct(*PRODUCTION_FIELDS, F.lit("MECHANICAL").alias("origin")))
    n = F.col("line_no")
    line = F.when(n % 31 == 4, F.replace(record, F.lit('"page":'), F.lit('"page":"x'))).when(n % 29 == 3, F.replace(record, F.lit('"byte_length"'), F.lit('"length"')))
    line = line.when(n % 43 == 7, F.replace(record, F.lit('"byte_start":'), F.lit('"byte_start":true,"was":')))
    line = line.when(n % 37 == 5, F.left(record, F.length(record) - 20)).when(n % 41 == 6, F.replace(record, F.lit("production-"), F.lit("other-"))).otherwise(record)
    line = F.when(n % 5 == 2, F.replace(line, F.lit('"occurrence":'), F.lit('"number":'))).otherwise(line)
    path = store.fresh(rows.sparkSession, "jsonl")
    rows.select(line.alias("value")).write.text(path, compression="gzip")
    return store.read_jsonl(rows.sparkSession, path, PRODUCTION_FIELDS, PRODUCTION_REQUIRED, PRODUCTION_KINDS)


@query("write_productions_jsonl", RECORDS + f" select record, false as header from written union all select '{HEADER}', true", "spec_lines")
def write_productions_jsonl(t):
    """All production records with their spans, written as JSON lines with a header beside them, and what then stands in the files."""
    rows, spark = records(spanned_blocks(t)).select(*PRODUCTION_FIELDS, F.lit("MECHANICAL").alias("origin")), t("orders").sparkSession
    store.write_jsonl(rows, path := store.fresh(spark, "jsonl"), HEADER)
    written = spark.read.text(path).select(F.col("value").alias("record"), F.lit(False).alias("header"))
    return written.unionByName(spark.read.text(path + ".header").select(F.col("value").alias("record"), F.lit(True).alias("header")))


GIVEN = RECORDS + """, docs as (select doc, string_agg(line, chr(10) order by page, line_no) as text from starts group by doc)
, given as (select doc, page, line_no, unnest(case when doc % 4 = 3 and kind = 'production-start' and line_no % 37 = 5 then [0, 1] else [0] end) as copy, kind, byte_start + case when doc % 4 = 1 and line_no % 29 = 3 then 2 else 0 end as byte_start,
 byte_length + case when doc % 4 = 1 and line_no % 97 = 5 then 1000000 else 0 end as byte_length, case when doc % 4 = 2 and line_no % 31 = 6 then null else occurrence - case when doc % 4 = 2 and line_no % 23 = 4 then 1 else 0 end end as occurrence,
 case when doc % 4 = 2 and line_no % 41 = 7 then null else source_line end as source_line from recs)
, marked as (select g.*, byte_start + byte_length <= strlen(text) as inside, kind = 'production-start' as st, text from given g join docs using (doc))
, seen as (select *, last_value(case when inside then byte_start + byte_length end ignore nulls) over p as end_before, last_value(case when st then occurrence end ignore nulls) over p as start_before, last_value(case when st then occurrence end ignore nulls) over u as active from marked
 window p as (partition by doc order by page, line_no, copy rows between unbounded preceding and 1 preceding), u as (partition by doc order by page, line_no, copy rows between unbounded preceding and current row))
, counted as (select doc, count(*) as records, count(*) filter (st) as starts, count(*) filter (not st) as continuations, count(*) filter (inside and byte_length > 0 and (source_line is null or substr(text, cast(byte_start + 1 as bigint), cast(byte_length as bigint)) <> source_line)) as span_mismatches,
 count(*) filter (case when st then coalesce(occurrence <= start_before, false) else not coalesce(occurrence = active, false) end) as occurrence_errors, count(*) filter (inside and coalesce(byte_start < end_before, false)) as ordering_errors,
 count(*) filter (occurrence is null or source_line is null) + count(*) filter (not inside) as other_errors from seen group by doc)
, pairs as (select doc, cast(sum(n * (n - 1) // 2) as bigint) as duplicate_spans from (select doc, byte_start, byte_length, count(*) as n from given where kind = 'production-start' group by all) group by doc)
, objects as (select doc, count(*) - case when doc % 12 = 8 then 1 else 0 end as objects from recs where kind = 'production-start' group by doc)"""


@query("validity_report", GIVEN + """ select doc, records, starts, continuations, objects, span_mismatches, occurrence_errors, ordering_errors, coalesce(duplicate_spans, 0) as duplicate_spans, other_errors,
 case when starts > 0 and starts = objects and span_mismatches + occurrence_errors + ordering_errors + coalesce(duplicate_spans, 0) + other_errors = 0 then 'PASS' else 'FAIL' end as verdict from counted left join pairs using (doc) left join objects using (doc)""", "spec_lines")
def validity_report(t):
    """The audit of each document's production records. Of every four documents one is sound (but in every third of these an object is
    missing); in the others spans are moved or too long, occurrences changed or missing, source lines missing, starts repeated."""
    buckets = store.tasks_for(t("lineitem"))
    lines = store.dealt_out(t("spec_lines").withColumn("doc", doc()), "doc", "page", buckets=buckets)
    blocks = W.production_blocks(lines, ["doc"], ["page", "line_no"], {"byte_start": F.octet_length("line") + 1}, dealt=True)
    good = records(blocks)
    kind, n, start = F.col("doc") % 4, F.col("line_no"), F.col("kind") == PRODUCTION_KINDS[0]
    copies = F.when((kind == 3) & start & (n % 37 == 5), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    given = good.select(
        "doc", "page", "line_no", "kind", F.explode(copies).alias("copy"), (F.col("byte_start") + F.when((kind == 1) & (n % 29 == 3), 2).otherwise(0)).alias("byte_start"),
        (F.col("byte_length") + F.when((kind == 1) & (n % 97 == 5), 1_000_000).otherwise(0)).alias("byte_length"),
        F.when((kind == 2) & (n % 31 == 6), None).otherwise(F.col("occurrence") - F.when((kind == 2) & (n % 23 == 4), 1).otherwise(0)).alias("occurrence"),
        F.when((kind == 2) & (n % 41 == 7), None).otherwise(F.col("source_line")).alias("source_line"),
    )
    made = W.assemble_productions(blocks, ["doc"])
    objects = made.groupBy("doc").agg((F.count("*") - F.when(F.col("doc") % 12 == 8, 1).otherwise(0)).alias("n"))
    return validity(store.dealt_out(given, "doc", "page", buckets=buckets, placed=True), lines, objects)


@query("read_page_index", """with s as (select source, doc_id as page, cast(coalesce(sum(strlen(text) + 1) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start, cast(strlen(text) as bigint) as length from documents)
 select source, page, case when page % 83 <> 9 then start end as start, case when page % 83 <> 9 then length end as length, case when page % 83 = 9 then 'malformed page' end as fault from s
 union all select source, null, null, null, 'declared pages' from s group by source having count(*) filter (page % 83 = 9) > 0
 union all select source, null, null, null, 'declared bytes' from s group by source having max(case when page % 83 <> 9 then start + length end) is distinct from max(start + length)""")
def read_page_index(t):
    """An index written as `source S page N start A length B` lines with a `source S pages N bytes T` line each, and parsed again.
    Lines that are malformed (some lose their length), and sources whose pages or bytes aren't as declared, are rows with a fault."""
    spans = W.page_spans(t("documents"), "source", "doc_id", "text")
    line = F.concat_ws(" ", F.lit("source"), "source", F.lit("page"), "page", F.lit("start"), "byte_start", F.when(F.col("page") % 83 != 9, F.concat(F.lit("length "), "byte_length")))
    head = F.concat_ws(" ", F.lit("source"), "source", F.lit("pages"), "n", F.lit("bytes"), "total")
    sums = spans.groupBy("source").agg(F.count("*").alias("n"), F.max(F.col("byte_start") + F.col("byte_length")).alias("total"))
    spark = spans.sparkSession
    spans.select(line.alias("value")).unionByName(sums.select(head.alias("value"))).write.text(path := store.fresh(spark, "index"))
    return store.read_page_index(spark, path)


# The columns of candidates, those that must be there, and the statuses.
CANDIDATE_COLUMNS = ["rule", "container", "document", "clause", "page", "byte_start", "hash", "kind", "path", "item", "derivation", "status"]
CANDIDATE_REQUIRED = ("rule", "container", "status")
STATUSES = ("candidate", "suppressed", "unsupported")

_STATUS = "case when pos % 23 = 4 then 'open' when pos % 7 = 3 then 'suppressed' when pos % 11 = 5 then 'unsupported' else 'candidate' end"
_NULLED = ", ".join(f"case when reject is null then nullif({c}, '') end as {c}" for c in CANDIDATE_COLUMNS)


@query("read_candidates_tsv", f"""+ c as (select pos, case when pos % 29 = 5 then '' else rule end as rule, subject as container, document, clause, cast(page as varchar) as page, cast(pos as varchar) as byte_start, source_hash as hash, origin as kind, 'rhs/' || id as path, 'item' as item, 'direct' as derivation, {_STATUS} as status from semantic_items)
, l as (select *, concat_ws(chr(9), coalesce(rule, ''), coalesce(container, ''), coalesce(document, ''), clause, page, byte_start, coalesce(hash, ''), kind, path, item) || case when pos % 31 = 6 then '' else chr(9) || derivation end || chr(9) || status as line,
 case when pos % 31 = 6 then 'fields: 11' when coalesce(rule, '') = '' or coalesce(container, '') = '' then 'empty required field' when pos % 23 = 4 then 'unknown status' end as reject from c)
 select {_NULLED}, reject, case when reject is not null then line end as line from l""", "semantic_items")
def read_candidates_tsv(t):
    """Candidates of twelve columns written as TSV and read back; some have an unknown status, no rule, or a field too few."""
    rows = t("semantic_items")
    columns = dict(zip(CANDIDATE_COLUMNS, ["case when pos % 29 = 5 then '' else rule end", "subject", "document", "clause", "page", "pos", "source_hash", "origin", "concat('rhs/', id)", "'item'", "'direct'", _STATUS], strict=True))
    value = F.concat_ws("\t", *(F.when(F.col("pos") % 31 == 6, F.lit(None)).otherwise(F.lit("direct")) if n == "derivation" else F.coalesce(F.expr(e).cast("string"), F.lit("")) for n, e in columns.items()))
    spark = rows.sparkSession
    # One header a file, of which a range of partitions each has its own.
    head = spark.range(0, 4, 1, 4).select(F.lit("\t".join(CANDIDATE_COLUMNS)).alias("value"), F.col("id").cast("int").alias("file"), F.lit(0).alias("n"))
    body = rows.select(value.alias("value"), F.pmod(F.xxhash64("pos"), F.lit(4)).cast("int").alias("file"), F.lit(1).alias("n"))
    head.unionByName(body).repartition(4, "file").sortWithinPartitions("file", "n").select("value").write.text(path := store.fresh(spark, "tsv"))
    return store.read_tsv_checked(spark, path, CANDIDATE_COLUMNS, CANDIDATE_REQUIRED, {"status": STATUSES})


@query("read_roots", "select p_name as root, count(*) as lines from part where p_partkey % 3 <> 0 group by p_name")
def read_roots(t):
    """Roots as bare names or as JSON with a rule; blank and # lines are skipped."""
    value = F.expr("case when p_partkey % 3 = 0 then concat('# ', p_name) when p_partkey % 3 = 1 then p_name else to_json(named_struct('rule', p_name)) end")
    spark = t("part").sparkSession
    t("part").select(value.alias("value")).write.text(path := store.fresh(spark, "roots"))
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT value LIKE '#%'")
    return lines.groupBy(F.coalesce(F.get_json_object("value", "$.rule"), F.trim("value")).alias("root")).agg(F.count("*").alias("lines"))


@query("sink_replace", "select source, count(*) as n from documents group by source")
def sink_replace(t):
    """Written once, refused a second time, replaced on request, and read back."""
    rows = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    store.write_tsv(rows.where(F.lit(False)), path := store.fresh(spark, "sink"))
    refused = False
    try:
        store.write_tsv(rows, path)
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    if not refused:
        raise RuntimeError("an existing output was not refused")
    store.write_tsv(rows, path, "overwrite")
    return store.read_tsv(spark, path, "source string, n long")
