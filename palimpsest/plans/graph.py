"""Queries: closures, reachability and other fixpoints; trees as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import graph as G
from palimpsest.operators import trees as R
from palimpsest.operators.windows import before
from palimpsest.plans.fixtures import query
from palimpsest.sources import store

REACHED = "+ roots as (select concat('part-', p_partkey) as node from part where concat('part-', p_partkey) not in (select dst from rule_edges)), r(node) as (select node from roots union select dst from r join rule_edges on node = src)"


def part_roots(t):
    """Parts that nothing refers to."""
    parts = t("part").select(F.concat(F.lit("part-"), "p_partkey").alias("node"))
    return parts.hint("merge").join(t("rule_edges").select(F.col("dst").alias("node")), "node", "left_anti")


RULES = "select distinct src as name from rule_edges union all select distinct src from rule_edges where src like 'part-%5'"


@query("rule_closure", REACHED + f""", rules as ({RULES}), n as (select name, count(*) as n from rules group by name), named as (select distinct dst from rule_edges join r on node = src)
 select node, case when n is null and node in (select node from roots) then 'missing root' when n is null then 'unresolved' when n > 1 and node in (select dst from named) then 'ambiguous' else 'resolved' end as state from r left join n on name = node
 union all select null, 'no roots' where not exists (select * from roots)""", "rule_edges")
def rule_closure(t):
    """The closure of the roots; some owners are declared twice."""
    e = t("rule_edges")
    owners = e.select(F.col("src").alias("name")).distinct()
    return G.closure(owners.unionByName(owners.where("name LIKE 'part-%5'")), e, part_roots(t))


_ONE = "one(node) as (select max(node) from roots union select dst from one join rule_edges on node = src)"


@query("reachable_prune", REACHED + f""", {_ONE} select distinct 'declared' as profile, src as node, src in (select node from r) as retained, case when src not in (select node from r) then case when (select count(*) from roots) = 1 then '{G.FROM_ONE}' else '{G.FROM_ALL}' end end as reason from rule_edges
 union all select distinct 'selected', src, src in (select node from one), case when src not in (select node from one) then '{G.FROM_ONE}' end from rule_edges""", "rule_edges")
def reachable_prune(t):
    """Owners that all roots reach and those that a single root reaches, with witnesses of the pruned ones."""
    roots = part_roots(t)
    edges = store.materialize(t("rule_edges"), "edges")
    declared = G.prune(edges, roots).withColumn("profile", F.lit("declared"))
    selected = G.prune(edges, roots.agg(F.max("node").alias("node"))).withColumn("profile", F.lit("selected"))
    return declared.unionByName(selected)


FORWARD = """+ fw as (select distinct name as src, case kind when 'erratum' then target when 'scalar' then substr(name, 8) else left(name, length(name) - 5) end as dst from classifications where kind in ('alias', 'list', 'scalar', 'erratum'))"""


def forwards(t):
    e = "case kind when 'erratum' then target when 'scalar' then substr(name, 8) else left(name, length(name) - 5) end"
    return t("classifications").where("kind IN ('alias', 'list', 'scalar', 'erratum')").selectExpr("name as src", f"{e} as dst").distinct()


@query("typed_closure", FORWARD + """, e as (select src, dst from rule_edges union select src, dst from fw), seeds as (select distinct src as node from fw where src like '%1%' or src like 'old%')
 , r(node) as (select node from seeds union select dst from r join e on node = src) select node, case when node in (select src from rule_edges) then 'normative' when node in (select src from fw) then 'derived' else 'terminal' end as kind from r""", "rule_edges", "classifications")
def typed_closure(t):
    """Closure over rules and over facts that forward to their targets."""
    fw, e = forwards(t), t("rule_edges")
    seeds = fw.where("src LIKE '%1%' OR src LIKE 'old%'").select(F.col("src").alias("node"))
    found = G.reach(e.unionByName(fw), seeds)
    found = found.join(e.select(F.col("src").alias("node"), F.lit(1).alias("rule")).distinct(), "node", "left").join(fw.select(F.col("src").alias("node"), F.lit(1).alias("fact")).distinct(), "node", "left")
    return found.select("node", F.when(F.col("rule") == 1, "normative").when(F.col("fact") == 1, "derived").otherwise("terminal").alias("kind"))


@query("classification_cycles", FORWARD + """, e as (select src, dst from fw union select concat('supp-', s_suppkey), concat('supp-', s_suppkey, '-list') from supplier where s_suppkey % 6 = 1)
 , r(a, b) as (select src, dst from e union select a, dst from r join e on b = src) select a as name from r where a = b""", "classifications")
def classification_cycles(t):
    """Facts that lead back to themselves; some are planted by forwarding suppliers to their lists."""
    planted = t("supplier").where("s_suppkey % 6 = 1").select(F.concat(F.lit("supp-"), "s_suppkey").alias("src"), F.concat(F.lit("supp-"), "s_suppkey", F.lit("-list")).alias("dst"))
    return G.cycles(forwards(t).unionByName(planted)).select(F.col("node").alias("name"))


@query("affected_by", """+ r(node) as (select distinct name from rule_items where item_kind = 'ref' and ends_with(name, '9-stmt') union select lhs from r join rule_items on name = node and item_kind = 'ref') select node from r""", "rule_items")
def affected_by(t):
    """Names that contain a seed, at any depth; seeds end in a suffix."""
    refs = t("rule_items").where("item_kind = 'ref'").select(F.col("name").alias("src"), F.col("lhs").alias("dst"))
    return G.reach(refs, refs.where(F.col("src").endswith("9-stmt")).select(F.col("src").alias("node"))).select("node")


ROUNDS = 24
NULLABLE = "+ n0 as materialized (select lhs from rule_items where false)" + "".join(
    f", n{k} as materialized (select distinct lhs from (select lhs, alt from rule_items group by lhs, alt having bool_and(item_kind in ('optional', 'repeat0') or (item_kind = 'ref' and name in (select lhs from n{k - 1})))))" for k in range(1, ROUNDS + 1)
)


@query("nullable_fixpoint", NULLABLE + f" select lhs from n{ROUNDS}", "rule_items")
def nullable_fixpoint(t):
    return G.nullable(t("rule_items"))


CORNER = NULLABLE + f"""
, marked as (select *, item_kind in ('optional', 'repeat0') or (item_kind = 'ref' and name in (select lhs from n{ROUNDS})) as nul from rule_items)
, firsts as (select lhs, name, item_kind, coalesce(bool_and(nul) over (partition by lhs, alt order by pos rows between unbounded preceding and 1 preceding), true) as ahead from marked)
, e as (select distinct lhs as src, name as dst from firsts where ahead and item_kind = 'ref'), c(src, dst) as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src)"""


def corners(t):
    items = t("rule_items")
    empty = G.nullable(items).select(F.col("lhs").alias("name"), F.lit(True).alias("empty"))
    # Only references are looked up; names of other items may be very frequent.
    ref = F.col("item_kind").eqNullSafe("ref")
    rows = items.where(ref).hint("merge").join(empty, "name", "left").unionByName(items.where(~ref), True)
    nul = F.col("item_kind").isin("optional", "repeat0") | ((F.col("item_kind") == "ref") & F.coalesce("empty", F.lit(False)))
    ahead = F.coalesce(F.bool_and(nul).over(before("lhs", "alt", order=["pos"])), F.lit(True))
    return rows.withColumn("ahead", ahead).where("ahead AND item_kind = 'ref'").select(F.col("lhs").alias("src"), F.col("name").alias("dst"))


@query("left_corner_pairs", CORNER + " select src, dst from c", "rule_items")
def left_corner_pairs(t):
    """Who can come first in whom: first items, and those after items that can be empty, closed over references."""
    return G.pairs(corners(t))


@query("cycle_report", CORNER + ", bases as (select distinct lhs from rule_items group by lhs, alt having bool_and(item_kind <> 'ref')) select src as name, src in (select lhs from bases) as has_base from c where src = dst", "rule_items")
def cycle_report(t):
    bases = t("rule_items").groupBy("lhs", "alt").agg(F.bool_and(F.col("item_kind") != "ref").alias("b")).where("b").select(F.col("lhs").alias("src"), F.lit(True).alias("b")).distinct()
    return G.cycles(corners(t)).withColumnRenamed("node", "src").join(bases, "src", "left").select(F.col("src").alias("name"), F.col("b").isNotNull().alias("has_base"))


@query("topo_levels", """+ e as (select src, dst from rule_edges where dst not like 'part-%' or cast(substr(src, 6) as bigint) > cast(substr(dst, 6) as bigint))
 , r(node, lv) as (select dst, 1 from e where dst not in (select src from e) union select src, lv + 1 from r join e on dst = node) select node, cast(max(lv) as bigint) as level from r group by node""", "rule_edges")
def topo_levels(t):
    """Order of dependencies, over edges to smaller parts and to other kinds of names."""
    number = "cast(substr(src, 6) as bigint) > cast(substr(dst, 6) as bigint)"
    return G.levels(t("rule_edges").where(f"case when dst like 'part-%' then {number} else true end"))


ALIAS = """+ nx as (select p_partkey as k, case when p_partkey % 3 <> 0 then (p_partkey * 7 + 3) % (select count(*) from part) end as nxt from part)
, walk(k, pt, hops) as (select k, k, 0 from nx union all select w.k, nx.nxt, hops + 1 from walk w join nx on nx.k = w.pt where nx.nxt is not null and hops < 400)
, ends as (select w.k, w.pt from walk w join nx on nx.k = w.pt where nx.nxt is null)
, res as (select concat('part-', nx.k) as name, concat('part-', cast(ends.pt as varchar)) as rep0, ends.pt is null as cyc, nx.nxt is null as own from nx left join ends using (k))
, resolved as (select name, case when not cyc then rep0 end as representative, case when own then 'not-alias' when cyc then 'cyclic' else 'resolved' end as state from res)"""


def aliases(t):
    n = t("part").count()
    nxt = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("part-"), (F.col("p_partkey") * 7 + 3) % n))
    return G.resolve_aliases(t("part").select(F.concat(F.lit("part-"), "p_partkey").alias("name"), nxt.alias("next")))


@query("alias_resolve", ALIAS + " select * from resolved", "rule_edges")
def alias_resolve(t):
    return aliases(t)


FACTORED = ALIAS + """, gone as (select name, representative from resolved where state = 'resolved'), factored as (select src, coalesce(representative, dst) as dst, count(*) as merged from rule_edges left join gone on dst = name where src not in (select name from gone) group by 1, 2)"""


FAMILY = """+ single as (select lhs, max(ref) as nxt from alias_rules group by lhs having count(*) = 1 and max(ref) is not null)
, names as (select distinct lhs as name from alias_rules)
, steps(name, pt, hops) as (select name, name, 0 from names union all select s.name, single.nxt, hops + 1 from steps s join single on single.lhs = s.pt where hops < 400)
, res as (select name, max(case when pt not in (select lhs from single) then pt end) as rep from steps group by name)
, roots as (select concat('part-', p_partkey) as name from part where concat('part-', p_partkey) not in (select dst from rule_edges))
, al as (select name, rep, name in (select name from roots) as kept from res where rep <> name and rep in (select name from names))
, gone as (select name, rep from al where not kept)
, mine as (select coalesce(g.rep, r.lhs) as name, r.*, g.rep is not null as alias from alias_rules r left join gone g on g.name = r.lhs)"""


def families(t):
    return G.alias_families(t("alias_rules"), part_roots(t).withColumnRenamed("node", "name"))


@query("factor_alias_family", FAMILY + """ select name, count(distinct lhs) filter (alias) as aliases,
 coalesce((select string_agg(distinct coalesce(g.rep, m2.ref), ',' order by coalesce(g.rep, m2.ref)) from mine m2 left join gone g on g.name = m2.ref where m2.name = mine.name and not m2.alias and m2.ref is not null), '') as refs,
 string_agg(distinct role, ',' order by role) as roles, string_agg(distinct source, ',' order by source) as provenance from mine group by name""", "rule_edges", "alias_rules")
def factor_alias_family(t):
    """Names that stay when aliases are merged into what they stand for, with the roles and sources of their whole family."""
    retained, _ = families(t)
    return retained.select("name", "aliases", *(F.array_join(c, ",").alias(c) for c in ("refs", "roles", "provenance")))


@query("factor_witnesses", FAMILY + """ select name, rep as representative, case when kept then 'rejected' else 'factored' end as disposition, case when kept then 'protected-reachability-root' else 'whole-unit-alias' end as reason from al
 union all select name, null, 'rejected', 'cyclic-unit-alias' from res where rep is null
 union all select r.lhs, res.rep, 'rejected', 'multi-alternative-alias' from alias_rules r join res on res.name = r.ref where r.lhs not in (select lhs from single) and res.rep <> r.lhs and res.rep in (select name from names) group by r.lhs, res.rep having count(*) = 1""", "rule_edges", "alias_rules")
def factor_witnesses(t):
    """What became of each alias, and why some were not merged; names that nothing refers to are protected."""
    return families(t)[1]


@query("disposition_table", REACHED + """, names as (select src as node from rule_edges union select node from r) select node, case when node in (select node from r) then 'selected' when node like 'part-1%' then 'omitted_root' else 'omitted_helper' end as disposition from names""", "rule_edges")
def disposition_table(t):
    """Names that are reached, declared roots that are not, and the rest."""
    reached = G.reach(t("rule_edges"), part_roots(t)).select("node", F.lit(True).alias("in"))
    names = t("rule_edges").select(F.col("src").alias("node")).union(reached.select("node")).distinct()
    return names.join(reached, "node", "left").select("node", F.when(F.col("in"), "selected").when(F.col("node").like("part-1%"), "omitted_root").otherwise("omitted_helper").alias("disposition"))


@query("factor_replay_audit", FACTORED + """, given as (select src, case when src like '%7' then concat(dst, '-x') else dst end as dst, merged + case when src like '%33' then 1 else 0 end as merged from factored where src not like '%01')
 select src, dst, merged, 'missing' as fault from (select * from factored except all select * from given) union all select src, dst, merged, 'unexpected' from (select * from given except all select * from factored)""", "rule_edges")
def factor_replay_audit(t):
    """A factored table in which rows are lost, changed and counted wrong, against a replay from the witnesses: what is missing in it,
    and what it shouldn't have. Rows of names that no alias touches are replayed as well, so they must be as before."""
    replay = store.materialize(G.factor_aliases(t("rule_edges"), aliases(t)), "replay")
    changed = F.when(F.col("src").like("%7"), F.concat("dst", F.lit("-x"))).otherwise(F.col("dst"))
    given = replay.where("src NOT LIKE '%01'").select("src", changed.alias("dst"), (F.col("merged") + F.col("src").like("%33").cast("int")).alias("merged"))
    out = replay.exceptAll(given).withColumn("fault", F.lit("missing"))
    return out.unionByName(given.exceptAll(replay).withColumn("fault", F.lit("unexpected")))


INDEX = "+ keyed as (select path, name, list_transform(string_split(path, '/')[2:], lambda x: cast(x as int)) as k from tree_nodes), indexed as (select path, name, k, row_number() over (order by k) as idx from keyed)"


def one_tree(t):
    return R.path_index(t("tree_nodes").withColumn("tree", F.lit("rhs")))


@query("path_index", INDEX + " select path, name, idx from indexed", "tree_nodes")
def path_index(t):
    """The pre-order numbers of one tree of all regions, nations and suppliers."""
    return one_tree(t).select("path", "name", "idx")


@query("subtree_span", INDEX + " select a.path, max(b.idx) as last_idx, count(*) as nodes from indexed a join indexed b on b.path = a.path or starts_with(b.path, a.path || '/') group by a.path", "tree_nodes")
def subtree_span(t):
    return R.subtree_span(one_tree(t)).drop("tree")


@query("node_table_check", "+ c as (select a.path, a.name, len(string_split(a.path, '/')) as depth, count(b.path) as children from tree_nodes a left join tree_nodes b on a.path = regexp_replace(b.path, '/[0-9]+$', '') and b.path <> a.path group by all) select path, case when depth < 4 and children = 0 then 'a choice without a child' when depth = 4 and children > 0 then 'a leaf with a child' when depth = 4 and name like '%7' then 'empty name' end as reason from c where reason is not null", "tree_nodes")
def node_table_check(t):
    """Nodes against the rules of their kind: inner nodes need children, leaves have none and a name (7s are planted as empty)."""
    return R.node_faults(t("tree_nodes"))


@query("path_syntax_check", "+ p as (select case when name like '%3' then replace(path, '/', '/0') when name like '%8' then path || '/' else path end as path from tree_nodes) select path, regexp_matches(path, '^rhs(/[1-9][0-9]*)*$') as well_formed from p", "tree_nodes")
def path_syntax_check(t):
    p = F.expr("case when name like '%3' then replace(path, '/', '/0') when name like '%8' then concat(path, '/') else path end")
    return t("tree_nodes").select(p.alias("path")).select("path", F.col("path").rlike("^rhs(/[1-9][0-9]*)*$").alias("well_formed"))


@query("split_alternatives", "+ a as (select lhs, alt, string_agg(name, ' ' order by pos) as expr from rule_items group by all) select lhs, 'rhs/' || row_number() over (partition by lhs order by alt) as path, expr from a", "rule_items")
def split_alternatives(t):
    """Rules with a list of alternatives become a row for each, with its path."""
    return R.split_alternatives(t("rule_items"))


def _flatten_sql(deepest: int = 7) -> str:
    """Levels from the deepest up: (tree, path, kind, w, parts, inner_w, inner_e, e), a part being {w, e}."""
    known = "select distinct lhs as name from rule_items where ends_with(lhs, '3-stmt')"
    out = [f"empty_names as ({known})", "leveled as (select *, len(string_split(path, '/')) as depth from expr_nodes)"]
    shape = "cast(null as struct(w varchar, e boolean)[]) as parts, cast(null as varchar) as inner_w, cast(null as boolean) as inner_e"
    out.append(f"t{deepest + 1} as (select tree, path, kind, name as w, {shape}, false as e, 'none' as op, cast([] as varchar[]) as dropped from expr_nodes where false)")
    for d in range(deepest, 0, -1):
        out.append(f"""g{d} as (select c.tree, regexp_replace(c.path, '/[0-9]+$', '') as path, list(c order by cast(regexp_extract(c.path, '[0-9]+$') as int)) as c from t{d + 1} c group by 1, 2),
i{d} as (select l.*, c, case when kind in ('sequence', 'choice') then flatten(list_transform(c, lambda x: case when x.kind = l.kind then list_transform(x.parts, lambda p: {{'p': p, 'src': null}}) else [{{'p': {{'w': x.w, 'e': x.e}}, 'src': x.path}}] end)) end as items
 from leveled l join g{d} g on g.tree = l.tree and g.path = l.path where depth = {d} and kind not in ('reference', 'token')),
k{d} as (select *, list_transform(items, lambda x: x.p.w) as ws from i{d}),
f{d} as (select *, case when kind = 'choice' then list_filter(items, lambda x, i: list_position(ws, x.p.w) = i) else items end as kept, case when kind = 'choice' then list_transform(list_filter(items, lambda x, i: list_position(ws, x.p.w) <> i and x.src is not null), lambda x: x.src) else [] end as dropped, c[1] as ch from k{d}),
p{d} as (select *, list_transform(kept, lambda x: x.p) as parts, case when len(kept) = 1 then list_filter(c, lambda x: x.w = kept[1].p.w)[1] when kind = 'optional' and ch.e then ch end as same,
 case when kind = 'repeat' and ch.kind <> 'optional' then minimum else 0 end as least from f{d}),
t{d} as (select tree, path, kind, case when kind = 'token' then chr(39) || name || chr(39) else name end as w, {shape}, kind = 'reference' and name in (select name from empty_names) as e, 'identity' as op, cast([] as varchar[]) as dropped from leveled where depth = {d} and kind in ('reference', 'token')
 union all select tree, path, coalesce(same.kind, kind), case when same is not null then same.w when kind = 'optional' then '[' || ch.w || ']' when kind = 'repeat' then '{{' || coalesce(ch.inner_w, ch.w) || '}}' || least when kind = 'sequence' then '(' || array_to_string(list_transform(parts, lambda p: p.w), ' ') || ')' else '(' || array_to_string(list_transform(parts, lambda p: p.w), ' | ') || ')' end,
 case when same is not null then same.parts when kind in ('sequence', 'choice') then parts end, case when same is not null then same.inner_w when kind = 'optional' then ch.w end, case when same is not null then same.inner_e when kind = 'optional' then ch.e end,
 case when same is not null then same.e when kind = 'optional' then true when kind = 'repeat' then least = 0 or coalesce(ch.inner_e, ch.e) when kind = 'sequence' then len(list_filter(parts, lambda p: not p.e)) = 0 else len(list_filter(parts, lambda p: p.e)) > 0 end,
 case when kind = 'optional' then case when same is null then 'identity' else 'optional-wrapper-removal' end when kind = 'repeat' then case when ch.kind = 'optional' then 'optional-wrapper-removal' else 'identity' end when same is null then kind || '-flatten' else kind || '-collapse' end, dropped from p{d})""")
    every = " union all ".join(f"select * from t{d}" for d in range(1, deepest + 1))
    return f"+ {', '.join(out)}, every as ({every}) select tree, path, op as operation, w as written from every union all select tree, unnest(dropped), 'choice-deduplicate', null from every"


@query("flatten_choices", _flatten_sql(), "rule_items", "expr_nodes")
def flatten_choices(t):
    """Expression trees of all orders, normalised at any depth, with what was done to each node."""
    names = t("rule_items").where(F.col("lhs").endswith("3-stmt")).select(F.col("lhs").alias("name"))
    return R.normalized(t("expr_nodes"), names)
