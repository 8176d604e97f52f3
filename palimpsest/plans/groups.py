"""Queries: groups, duplicates, identity, counts."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import groups as G
from palimpsest.plans.fixtures import query

EXPRS = "+ rules as (select lhs, alt, string_agg(item_kind || ':' || name, ' ' order by pos) as expr from rule_items group by lhs, alt)"


def exprs(t):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "item_kind", "name").alias("x")))), lambda x: x["x"])
    return t("rule_items").groupBy("lhs", "alt").agg(F.array_join(parts, " ").alias("expr"))


# What makes a location.
LOCATION = ["document", "clause", "source_hash", "page", "byte_start", "rule", "lhs", "path"]


@query("group_by_lhs", """with g as (select source as lhs, min(doc_id) as first_pos, count(*) as members from documents group by source), p as (select *, row_number() over (order by first_pos) as place from g)
 select p.lhs, d.doc_id, row_number() over (partition by d.source order by d.doc_id) as member, first_pos, members, place from documents d join p on d.source is not distinct from p.lhs""")
def group_by_lhs(t):
    """Groups in order of their first row, with their members in order, a row each."""
    g = G.members(t("documents"), "source", "doc_id")
    return g.select(F.col("key").alias("lhs"), F.col("order").alias("doc_id"), F.col("member").cast("long").alias("member"), F.col("first").alias("first_pos"), "members", "place")


@query("rule_occurrences", "select rule, count(*) as occurrences from semantic_items group by rule", "semantic_items")
def rule_occurrences(t):
    return t("semantic_items").groupBy("rule").agg(F.count("*").alias("occurrences"))


@query("shape_conflicts", "+ s as (select 'R' || (hash_k % 500) as rule, lhs, string_agg(distinct name, ',' order by name) as refs from (select *, cast(regexp_extract(lhs, '[0-9]+') as bigint) as hash_k from rule_items) group by all) select rule, count(distinct lhs || '/' || refs) as shapes from s group by rule having shapes > 1", "rule_items")
def shape_conflicts(t):
    """Rule ids with more than one left side or set of references; order doesn't count."""
    rule = F.concat(F.lit("R"), F.regexp_extract("lhs", "[0-9]+", 0).cast("long") % 500)
    s = t("rule_items").groupBy(rule.alias("rule"), "lhs").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("refs"))
    return s.groupBy("rule").agg(F.countDistinct(F.concat_ws("/", "lhs", "refs")).alias("shapes")).where("shapes > 1")


@query("classification_conflicts", "select name, count(distinct (kind, target, suffix, prefix, sep)) as variants, count(*) as facts from classifications group by name having count(*) > 1", "classifications")
def classification_conflicts(t):
    """Names stated more than once: one variant is a repeat, more are a conflict."""
    g = t("classifications").groupBy("name").agg(F.countDistinct(F.struct("kind", "target", "suffix", "prefix", "sep")).alias("variants"), F.count("*").alias("facts"))
    return g.where("facts > 1")


DEDUP = "with g as (select sha256(text) as key, min(doc_id) as kept, count(*) as copies, string_agg(distinct source, ',' order by source) as provenance from documents group by 1)"


@query("dedup_merge_provenance", DEDUP + " select kept, copies, provenance from g")
def dedup_merge_provenance(t):
    """Equal texts: the first is kept with the provenance of all."""
    return G.merge_provenance(t("documents"), [F.sha2("text", 256)], "doc_id", "source").select("kept", "copies", "provenance")


@query("suppressed_retained_link", DEDUP + " select doc_id as suppressed, kept as retained from documents d join g on sha256(d.text) = g.key where doc_id <> kept")
def suppressed_retained_link(t):
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("key"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("retained"), F.count("*").alias("n")).where("n > 1")
    return rows.hint("merge").join(first, "key").where("doc_id <> retained").select(F.col("doc_id").alias("suppressed"), "retained")


@query("intern_keys", """with w as (select doc_id, unnest(range(len(string_split(text, ' ')))) as i, translate(unnest(string_split(text, ' ')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from documents)
, k as (select key, min((doc_id, i)) as first_pos from w where key <> '' group by 1), n as (select *, row_number() over (order by first_pos) as id from k)
 select doc_id, cast(i as int) as i, w.key, id, case when id is not null then (doc_id, i) = first_pos end as is_new, case when id is null then 'empty key' end as fault from w left join n on n.key = w.key""")
def intern_keys(t):
    """Words of all texts, A-Z folded alone, with dense ids in order of their first occurrence; empty words are faults."""
    words = t("documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    keys = words.select("doc_id", "i", F.translate("word", ascii_uppercase, ascii_lowercase).alias("key"), F.struct("doc_id", "i").alias("pos"))
    return G.interned(keys, "key", "pos").drop("pos")


@query("coalesce_evidence", """+ g as (select document, clause, source_hash, page, byte_start, rule, lhs, path, string_agg(kind || ':' || status, ',' order by kind || ':' || status) as evidence, count(*) as n, count(distinct (kind, status)) as k from evidence group by all)
 select * exclude (n, k), case when n > k then 'evidence is repeated' end as fault from g""", "semantic_items", "evidence")
def coalesce_evidence(t):
    """One site for each location, with its evidence; repeated evidence is a fault."""
    sites = G.coalesce(t("evidence"), LOCATION, ["kind", "status"])
    shown = F.array_join(F.array_sort(F.transform("evidence", lambda e: F.concat_ws(":", e["kind"], e["status"]))), ",")
    return sites.select(*LOCATION, shown.alias("evidence"), "fault")


@query("coalesce_mappings", "select id, count(*) as merged, count(distinct resolution) > 1 as conflict, min(resolution) as resolution from semantic_items where origin <> 'unknown' group by id union all select id, 1, false, resolution from semantic_items where origin = 'unknown'", "semantic_items")
def coalesce_mappings(t):
    """Mappings of one identity merge; those with an unknown origin pass through."""
    rows = t("semantic_items")
    g = rows.where("origin <> 'unknown'").groupBy("id").agg(F.count("*").alias("merged"), (F.countDistinct("resolution") > 1).alias("conflict"), F.min("resolution").alias("resolution"))
    return g.unionByName(rows.where("origin = 'unknown'").select("id", F.lit(1).cast("long").alias("merged"), F.lit(False).alias("conflict"), "resolution"))


@query("find_unique", "+ c as (select id, count(*) as n, min(pos) as p from semantic_items group by id) select concat('S', l_partkey % 900) as wanted, count(*) as asked, case when any_value(n) is null then 'not found' when any_value(n) = 1 then 'found' else 'ambiguous' end as status, case when any_value(n) = 1 then any_value(p) end as pos from lineitem left join c on id = concat('S', l_partkey % 900) group by 1", "semantic_items")
def find_unique(t):
    asked = t("lineitem").groupBy(F.concat(F.lit("S"), F.col("l_partkey") % 900).alias("id")).agg(F.count("*").alias("asked"))
    c = t("semantic_items").groupBy("id").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    rows = asked.join(c, "id", "left")
    return rows.selectExpr("id as wanted", "asked", "case when n is null then 'not found' when n = 1 then 'found' else 'ambiguous' end as status", "case when n = 1 then p end as pos")


@query("nth_occurrence", "+ r as (select id, pos, row_number() over (partition by id order by pos) as n from semantic_items) select id, pos from r where n = 2", "semantic_items")
def nth_occurrence(t):
    n = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return t("semantic_items").withColumn("n", n).where("n = 2").select("id", "pos")


@query("resolution_counts", "select resolution, count(*) as items from semantic_items group by resolution", "semantic_items")
def resolution_counts(t):
    return t("semantic_items").groupBy("resolution").agg(F.count("*").alias("items"))


@query("closure_summary", "select (select count(*) from rule_edges) as edges, (select count(distinct src) from rule_edges) as owners, (select count(*) from (select src from rule_edges group by src having count(*) > 1)) as repeated, (select count(*) from (select distinct src, dst from rule_edges where dst not in (select src from rule_edges))) as unresolved", "rule_edges")
def closure_summary(t):
    e = t("rule_edges")
    owners = e.groupBy("src").agg(F.count("*").alias("n"))
    first = owners.agg(F.sum("n").alias("edges"), F.count("*").alias("owners"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"))
    open_ = e.distinct().hint("merge").join(owners.select(F.col("src").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("unresolved"))
    return first.crossJoin(open_)


@query("role_union", "select lhs, string_agg(item_kind, ',' order by p) as roles from (select lhs, item_kind, min(alt * 10 + pos) as p from rule_items group by lhs, item_kind) group by lhs", "rule_items")
def role_union(t):
    first = t("rule_items").groupBy("lhs", "item_kind").agg(F.min(F.col("alt") * 10 + F.col("pos")).alias("p"))
    return first.groupBy("lhs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "item_kind"))), lambda x: x["item_kind"]), ",").alias("roles"))


@query("render_rules", EXPRS + " select lhs, lhs || ' ::= ' || string_agg(expr, ' | ' order by alt) as rendered from rules group by lhs", "rule_items")
def render_rules(t):
    alts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alt", "expr"))), lambda x: x["expr"]), " | ")
    return exprs(t).groupBy("lhs").agg(alts.alias("alts")).select("lhs", F.concat("lhs", F.lit(" ::= "), "alts").alias("rendered"))
