"""Queries: resolution, lookups, range joins, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import ranges as R
from palimpsest.operators import text as T
from palimpsest.plans.fixtures import query
from palimpsest.plans.text import TOKENS
from palimpsest.sources.store import tasks_for

VERDICT = "case when n is null then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end"


@query("resolve_references", f"+ defs as (select lhs, count(distinct alt) as n from rule_items group by lhs) , refs as (select distinct r.lhs as owner, r.name, n from rule_items r left join defs d on d.lhs = r.name where item_kind = 'ref') select owner, name, {VERDICT} as status from refs", "rule_items")
def resolve_references(t):
    """References against the number of rules of that name."""
    items = t("rule_items")
    defs = items.groupBy("lhs").agg(F.countDistinct("alt").alias("n")).withColumnRenamed("lhs", "name")
    refs = items.where("item_kind = 'ref'").select(F.col("lhs").alias("owner"), "name").distinct()
    return refs.hint("merge").join(defs, "name", "left").select("owner", "name", F.expr(VERDICT).alias("status"))


@query("closure_lookup_conflicts", """+ prods as (select distinct src as name from rule_edges), facts as (select distinct case when kind = 'erratum' then target else name end as name from classifications)
 , names as (select coalesce(p.name, f.name) as name, p.name is not null as p, f.name is not null as f from prods p full join facts f on p.name = f.name)
 select name, case when p and f then 'conflict' when p then 'production' else 'fact' end as status from names union all
 select distinct dst, 'unclassified' from rule_edges where dst not in (select name from names)""", "rule_edges", "classifications")
def closure_lookup_conflicts(t):
    edges = t("rule_edges")
    prods = edges.select(F.col("src").alias("name")).distinct().withColumn("p", F.lit(True))
    facts = t("classifications").select(F.when(F.col("kind") == "erratum", F.col("target")).otherwise(F.col("name")).alias("name")).distinct().withColumn("f", F.lit(True))
    names = prods.join(facts, "name", "full")
    rest = edges.select(F.col("dst").alias("name")).distinct().join(names, "name", "left_anti")
    return names.select("name", F.when(F.col("p") & F.col("f"), "conflict").when(F.col("p"), "production").otherwise("fact").alias("status")).unionByName(rest.withColumn("status", F.lit("unclassified")))


@query("fact_lookup", """+ facts as (select s_nationkey as k, concat('nation-', s_nationkey) as expr, min(s_suppkey) as fact, count(*) as n from supplier group by s_nationkey)
 select src, dst, fact is not null as found, fact, n from rule_edges e left join facts f on e.dst = f.expr and e.src = concat('supp-', f.fact)""", "rule_edges")
def fact_lookup(t):
    """Exact lookup on two columns; several facts may share an id."""
    facts = t("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("fact"), F.count("*").alias("n"))
    facts = facts.select(F.concat(F.lit("nation-"), "s_nationkey").alias("dst"), F.concat(F.lit("supp-"), "fact").alias("src"), "fact", "n")
    return t("rule_edges").join(facts, ["src", "dst"], "left").select("src", "dst", F.col("fact").isNotNull().alias("found"), "fact", "n")


#: Parts of a token's rows.
LANES = 32


@query("lexicalize_tokens", TOKENS + ", terms as (select distinct name from classifications where kind = 'erratum') , facts as (select concat('part-', p_partkey) as term, p_size from part where p_size < 10) select page, line_no, position, token, case when p_size is not null then 'ref' else cast(token_kind as varchar) end as kind from tokens left join facts on token = term", "spec_lines", "classifications")
def lexicalize_tokens(t):
    """Tokens that are lexical terms become references. Terms: names of small parts. Brackets and the like stand on every line, so
    tokens are dealt out in LANES by their line too, each with all terms, to as many tasks as the line items need."""
    tasks = tasks_for(t("lineitem"))
    facts = t("part").where("p_size < 10").select(F.concat(F.lit("part-"), "p_partkey").alias("token"), F.lit(True).alias("term"))
    facts = facts.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))).repartition(tasks, "token", "lane")
    rows = T.notation_tokens(t("spec_lines"), "line").select("page", "line_no", "position", "token", "token_kind")
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("page", "line_no"), F.lit(LANES)).cast("int")).repartition(tasks, "token", "lane")
    rows = rows.hint("merge").join(facts, ["token", "lane"], "left")
    return rows.select("page", "line_no", "position", "token", F.when(F.col("term"), "ref").otherwise(F.col("token_kind").cast("string")).alias("kind"))


@query("effective_classifications", """+ own as (select distinct name, kind from classifications where kind <> 'lexical'), facts as (select concat('WORD-', s_suppkey) as name from supplier union all select concat('hole-', s_suppkey) from supplier)
 select name, kind from own union all select name, 'lexical' from facts where name not in (select name from own)""", "classifications")
def effective_classifications(t):
    own = t("classifications").where("kind <> 'lexical'").select("name", "kind").distinct()
    supplier = t("supplier")
    facts = supplier.select(F.concat(F.lit("WORD-"), "s_suppkey").alias("name")).union(supplier.select(F.concat(F.lit("hole-"), "s_suppkey")))
    return own.unionByName(facts.join(own, "name", "left_anti").withColumn("kind", F.lit("lexical")))


FACT_FAULTS = """+ rg as (select *, row_number() over (order by tbl, fact, first, last) as rid from lex_ranges)
, fact_faults as (select distinct tbl, fact, reason from (
 select tbl, fact, case when trim(source_term) = '' or trim(target) = '' or trim(class) = '' then 'lacks source term, class or target' end as reason from lex_facts
 union all select tbl, fact, case when page is null or not regexp_full_match(hash, '[0-9A-Fa-f]{64}') then 'lacks provenance' end from lex_facts
 union all select tbl, fact, case when codepoint <> 'processor-defined' and (tbl, fact) not in (select (tbl, fact) from lex_ranges) then 'has neither scalar nor range' end from lex_facts
 union all select a.tbl, a.fact, 'repeats a source term' from lex_facts a join lex_facts b on a.tbl = b.tbl and a.source_term = b.source_term and b.fact < a.fact
 union all select a.tbl, a.fact, 'repeats a target' from lex_facts a join lex_facts b on a.tbl = b.tbl and a.target = b.target and b.fact < a.fact and a.target <> ''
 union all select tbl, fact, 'range outside Unicode scalars' from rg where first not between 0 and 1114111 or last not between 0 and 1114111 or first between 55296 and 57343 or last between 55296 and 57343
 union all select tbl, fact, 'reversed range' from rg where first > last
 union all select a.tbl, a.fact, 'overlapping ranges' from rg a join rg b on a.tbl = b.tbl and a.rid <> b.rid and a.first <= b.last and b.first <= a.last and (b.first, b.last, b.fact) < (a.first, a.last, a.fact) where a.first <= a.last and b.first <= b.last) where reason is not null)"""

LOOKED = FACT_FAULTS + """
, n as (select max(tbl) + 1 as c from lex_facts)
, pts as (select tbl, cp, count(*) as uses from (select doc_id % n.c as tbl, cast(unicode(unnest(string_split(text, ''))) as bigint) as cp from documents, n where text <> '' union all select doc_id % n.c, 55296 + doc_id % 3000 from documents, n) group by all)
, hit as (select pts.tbl, cp, uses, count(distinct fact) as n, min(fact) as hit from pts left join lex_ranges r on r.tbl = pts.tbl and cp between first and last group by all)
, bad as (select distinct tbl from fact_faults where tbl % 4 <> 0)
, def as (select tbl, min(fact) as defined from lex_facts where (tbl, fact) not in (select (tbl, fact) from lex_ranges) group by tbl)
, looked as (select h.tbl, cp, uses, case when cp > 1114111 or cp between 55296 and 57343 then 'invalid_scalar' when bad.tbl is not null then 'invalid_facts' when n > 1 then 'ambiguous' when n = 1 then 'match' when defined is not null then 'unsupported' else 'no_match' end as status, hit, defined
 from hit h left join bad on bad.tbl = h.tbl left join def on def.tbl = h.tbl)"""


@query("codepoint_class_lookup", LOOKED + " select tbl, cp, uses, status, case status when 'match' then hit when 'unsupported' then defined end as fact from looked", "lex_facts", "lex_ranges")
def codepoint_class_lookup(t):
    """Facts of all scalars of the texts, a text's being looked up in one of the tables; some are no scalars. Every fourth table is
    taken without a check of its facts."""
    facts = t("lex_facts")
    tables = facts.agg(F.max("tbl") + 1).first()[0]
    docs = t("documents").withColumn("tbl", F.col("doc_id") % tables)
    cps = T.codepoints(docs, "tbl").select(F.col("doc_id").alias("tbl"), "cp").unionByName(docs.select("tbl", (55296 + F.col("doc_id") % 3000).alias("cp")))
    points = cps.groupBy("tbl", "cp").agg(F.count("*").alias("uses"))
    return R.lookup(points, facts, t("lex_ranges"), facts.where("tbl % 4 = 0").select("tbl"))


@query("range_overlap_audit", FACT_FAULTS + " select * from fact_faults", "lex_facts", "lex_ranges")
def range_overlap_audit(t):
    """All faults of facts and their ranges: overlaps inside a fact and across facts by a sort and a carried maximum, no self-join."""
    return R.fact_faults(t("lex_facts"), t("lex_ranges"))


CANDIDATES = """+ cand as (select pos, id, rule, document, clause, page, source_hash as hash, case when pos % 13 = 4 then 'suppressed' else 'candidate' end as status from semantic_items)
, rules as (select rule, document, clause, case when pos % 5 = 2 then page + 1 else page end as page, source_hash as hash, pos as rid from semantic_items where pos % 3 <> 1 union all select rule, document, clause, page, source_hash, pos + 1000000000 from semantic_items where pos % 17 = 6)
, nfull as (select rule, document, clause, page, hash, count(*) as n, string_agg(cast(rid as varchar), ',' order by rid) as alternatives from rules group by rule, document, clause, page, hash), nloose as (select distinct rule, document, 1 as m from rules)
, mapped as (select c.pos, case when status = 'suppressed' then 'suppressed' when n = 1 then 'mapped' when n > 1 then 'ambiguous' else 'unsupported' end as disposition,
 case when status = 'suppressed' or n >= 1 then null when m = 1 then 'lineage did not match' else 'not found' end as reason, case when status <> 'suppressed' then alternatives end as alternatives
 from cand c left join nfull f using (rule, document, clause, page, hash) left join nloose l using (rule, document))"""


def boundary_rows(t):
    items = t("semantic_items")
    key = ["rule", "document", "clause", "page", "hash"]
    cand = items.selectExpr("pos", "rule", "document", "clause", "page", "source_hash as hash", "case when pos % 13 = 4 then 'suppressed' else 'candidate' end as status")
    rules = items.where("pos % 3 <> 1").selectExpr("rule", "document", "clause", "case when pos % 5 = 2 then page + 1 else page end as page", "source_hash as hash", "pos as rid")
    rules = rules.unionByName(items.where("pos % 17 = 6").selectExpr("rule", "document", "clause", "page", "source_hash as hash", "pos + 1000000000 as rid"))
    full = rules.groupBy(*key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("rid")), lambda x: x.cast("string")), ",").alias("alternatives"))
    loose = rules.select("rule", "document").distinct().withColumn("m", F.lit(1))
    return cand.hint("merge").join(full, key, "left").hint("merge").join(loose, ["rule", "document"], "left")


DISPOSITION = "case when status = 'suppressed' then 'suppressed' when n = 1 then 'mapped' when n > 1 then 'ambiguous' else 'unsupported' end"
WHY = "case when status = 'suppressed' or n >= 1 then null when m = 1 then 'lineage did not match' else 'not found' end"


@query("boundary_map", CANDIDATES + " select * from mapped", "semantic_items")
def boundary_map(t):
    """Candidates joined to rules on their full lineage, then on rule and document alone to say why not."""
    return boundary_rows(t).selectExpr("pos", f"{DISPOSITION} as disposition", f"{WHY} as reason", "case when status <> 'suppressed' then alternatives end as alternatives")


@query("near_miss_report", CANDIDATES + " select pos from mapped where reason = 'lineage did not match'", "semantic_items")
def near_miss_report(t):
    return boundary_rows(t).where("status <> 'suppressed' AND n IS NULL AND m = 1").select("pos")


@query("active_and_passthrough", CANDIDATES + " select pos, disposition, case when disposition = 'suppressed' then 'passed' else 'mapped' end as path from mapped", "semantic_items")
def active_and_passthrough(t):
    rows = boundary_rows(t)
    active = rows.where("status = 'candidate'").selectExpr("pos", f"{DISPOSITION} as disposition", "'mapped' as path")
    return active.unionByName(rows.where("status <> 'candidate'").selectExpr("pos", "status as disposition", "'passed' as path"))


@query("root_coverage", "with roots as (select concat('part-', p_partkey) as name, p_partkey as k from part) select name from roots where k % 4 <> 0 and k % 7 <> 3")
def root_coverage(t):
    """Declared roots that are neither exported (every fourth) nor skipped (k % 7 = 3)."""
    roots = t("part").select(F.concat(F.lit("part-"), "p_partkey").alias("name"), F.col("p_partkey").alias("k"))
    known = roots.where("k % 4 = 0").unionByName(roots.where("k % 7 = 3"))
    return roots.join(known, "name", "left_anti").select("name")


@query("exactly_one_attach", "+ one as (select id, min(pos) as source_pos from semantic_items group by id having count(*) = 1) select s.pos, s.id, one.source_pos from semantic_items s left join one using (id)", "semantic_items")
def exactly_one_attach(t):
    items = t("semantic_items")
    one = items.groupBy("id").agg(F.count("*").alias("n"), F.min("pos").alias("source_pos")).where("n = 1").drop("n")
    return items.hint("merge").join(one, "id", "left").select("pos", "id", "source_pos")


@query("semantic_skip", "+ holes as (select distinct concat('order-', n_nationkey * 3, '-stmt') as name from nation) , hit as (select distinct lhs, name from rule_items where name in (select name from holes)) select distinct r.lhs, h.name as detail, h.lhs is null as kept from rule_items r left join hit h on r.lhs = h.lhs", "rule_items")
def semantic_skip(t):
    """Records that refer to a semantic-only name are dropped, with the names as details."""
    holes = t("nation").select(F.concat(F.lit("order-"), F.col("n_nationkey") * 3, F.lit("-stmt")).alias("name")).distinct()
    items = t("rule_items")
    hit = items.join(F.broadcast(holes), "name", "left_semi").select("lhs", F.col("name").alias("detail")).distinct()
    rows = items.select("lhs").distinct().hint("merge").join(hit, "lhs", "left")
    return rows.select("lhs", "detail", F.col("detail").isNull().alias("kept"))
