"""Queries: rows, records and declarations against their contracts. Faults are planted by a number a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.contracts import BUILTIN, Declaration, faulty, first_fault, nonconforming, pattern, registry_faults, source_rules
from palimpsest.plans.audits import ORIGINS, RESOLUTIONS
from palimpsest.plans.fixtures import query
from palimpsest.sources import store

Columns = dict[str, tuple[str, dict[int, str]]]


def _one_of(column: str, *names: str) -> str:
    return f"{column} in ({', '.join(f"'{n}'" for n in names)})"


def _columns(columns: Columns) -> list[str]:
    """SQL of each column: its sound value, or the faulty one where h is a given number."""
    return [f"case {' '.join(f'when h = {n} then {bad}' for n, bad in faults.items())} else {sound} end as {name}" if faults else f"{sound} as {name}" for name, (sound, faults) in columns.items()]


def _rows(t, table: str, key: str, h: str, columns: Columns) -> DataFrame:
    return t(table).selectExpr("*", f"{h} as h").selectExpr(f"{key} as pos", *_columns(columns))


def _duck(table: str, key: str, h: str, columns: Columns) -> str:
    return _plain(f"with rows as (select {key} as pos, {', '.join(_columns(columns))} from (select *, {h} as h from {table}))")


def _plain(sql: str) -> str:
    return sql.replace("regexp_like(", "regexp_matches(").replace("sha2(cast(l_partkey as string), 256)", "sha256(cast(l_partkey as string))").replace("sha2(p_brand, 256)", "sha256(p_brand)")


def _checked(name: str, table: str, key: str, h: str, columns: Columns, rules: dict[str, str], expected: str, extra: str | None = None) -> None:
    """Register a query of (pos, reason): the first fault of each unsound row. expected: SQL of the reason by what was planted (h) and
    the row of the table, which knows neither the columns nor the rules; DuckDB is asked that. extra: SQL of a column over the
    others that many rules use. Such rows are written out first: the optimiser would put its terms into each rule, more than code
    can be generated for."""
    sql = f"with f as (select {key} as pos, {expected} as reason from (select *, {h} as h from {table})) select * from f where reason is not null"

    @query(name, sql)
    def check(t):
        rows = _rows(t, table, key, h, columns)
        rows = store.materialize(rows.selectExpr("*", extra), name) if extra else rows
        return faulty(rows, rules, "pos")


def _by(reasons: dict[str, tuple[int, ...] | str]) -> str:
    """SQL of a reason from the numbers under which its faults are planted, or a condition, in order."""
    return "case " + " ".join(f"when {f'h in {(*at, -1)}' if isinstance(at, tuple) else at} then '{reason}'" for reason, at in reasons.items()) + " end"


LINE, PLACE = "l_orderkey * 10 + l_linenumber", "(l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 401"
SOURCE_COLUMNS: Columns = {
    "document": ("concat('doc-', l_suppkey)", {1: "null"}),
    "clause": ("cast(l_linenumber as string)", {2: "''"}),
    "rule": ("concat('R', l_partkey)", {3: "''"}),
    "page": ("l_orderkey % 50 + 1", {4: "0"}),
    "end_page": ("case when l_orderkey % 2 = 0 then 0 else l_orderkey % 50 + 2 end", {5: "-1", 6: "1"}),
    "byte_start": ("l_orderkey * 100", {7: "-1"}),
    "byte_length": ("l_linenumber * 10", {8: "-4"}),
    "occurrence": ("l_linenumber", {9: "-1"}),
    "source_hash": ("sha2(cast(l_partkey as string), 256)", {10: "''"}),
}
_SOURCE_PLANTED = {"document": (1,), "clause": (2,), "rule": (3,), "page": (4,), "hash": (10,), "page span": "h = 5 or (h = 6 and l_orderkey % 50 > 0)", "byte span": (7, 8), "occurrence": (9,)}
_checked("source_ref_check", "lineitem", LINE, PLACE, SOURCE_COLUMNS, source_rules(), _by(_SOURCE_PLANTED))

# Fixed values of the boundary candidates.
KINDS = ("repeat-item", "first-plus-repeat", "compound-repeat-item", "sequence-internal")
HASH = "^[0-9A-Fa-f]{64}$"
_checked(
    "candidate_check", "lineitem", LINE, PLACE,
    {
        "rule": ("concat('R', l_partkey)", {1: "''", 2: "null"}),
        "container": ("concat('order-', l_orderkey)", {3: "''"}),
        "document": ("concat('doc-', l_suppkey)", {4: "''"}),
        "clause": ("cast(l_linenumber as string)", {5: "''"}),
        "page": ("cast(l_orderkey % 50 + 1 as string)", {6: "''", 7: "'000'", 8: "'x7'", 9: "'007'"}),
        "byte_start": ("cast(l_orderkey * 100 as string)", {10: "''", 11: "'-1'", 12: "'0'"}),
        "hash": ("sha2(cast(l_partkey as string), 256)", {13: "''", 14: "'abc'", 15: "upper(sha2(cast(l_partkey as string), 256))"}),
        "path": ("concat('rhs/', l_linenumber, '/1')", {16: "''", 17: "'rhs'", 18: "'rhs/'", 19: "'rhs/01'", 20: "'lhs/1'", 21: "'rhs/1/'"}),
        "item": ("concat('part-', l_partkey)", {22: "''"}),
        "derivation": ("'repeat'", {23: "''"}),
        "status": ("case when l_suppkey % 9 = 4 then 'suppressed' else 'candidate' end", {24: "'maybe'"}),
        "kind": (f"case l_linenumber % 4 when 0 then '{KINDS[0]}' when 1 then '{KINDS[1]}' when 2 then '{KINDS[2]}' else '{KINDS[3]}' end", {25: "'choice'"}),
    },
    {
        "rule or container": "rule <> '' and container <> ''",
        "lineage": "document <> '' and clause <> '' and hash <> '' and page <> '' and byte_start <> ''",
        "hash form": f"regexp_like(hash, '{HASH}')",
        "page": "regexp_like(page, '^[0-9]*[1-9][0-9]*$')",
        "byte start": "regexp_like(byte_start, '^[0-9]+$')",
        "path missing": "path <> ''",
        "path form": "regexp_like(path, '^rhs(/[1-9][0-9]*)*$')",
        "item or derivation": "item <> '' and derivation <> ''",
        "status": "status = 'candidate'",
        "kind": _one_of("kind", *KINDS),
    },
    _by({
        "rule or container": (1, 2, 3), "lineage": (4, 5, 6, 10, 13), "hash form": (14,), "page": (7, 8), "byte start": (11,), "path missing": (16,), "path form": (18, 19, 20, 21),
        "item or derivation": (22, 23), "status": "h = 24 or l_suppkey % 9 = 4", "kind": (25,),
    }),
)

# Fixed values of the correspondence rows.
NODE_KINDS = ("reference", "token", "sequence", "choice", "optional", "repeat")
DISPOSITIONS = ("mapped", "ambiguous", "suppressed", "unsupported")
_HELD = "l_partkey % 4 = 0"  # rows that name a retained target
TRACE: Columns = SOURCE_COLUMNS | {
    "source_alternative": ("1 + l_linenumber % 3", {11: "0"}),
    "raw_path": ("concat('rhs/', l_linenumber)", {12: "''"}),
    "node_kind": (f"case l_suppkey % 6 {' '.join(f"when {i} then '{k}'" for i, k in enumerate(NODE_KINDS))} end", {13: "'list'"}),
    "node_name": ("concat('part-', l_partkey)", {14: "''"}),
    "boundary_role": ("'inner'", {15: "''"}),
    "target_rule": ("concat('T', l_partkey)", {16: "''"}),
    "target_lhs": ("concat('order-', l_orderkey)", {17: "null"}),
    "target_alternative": ("1", {18: "0"}),
    "target_path": ("case when l_orderkey % 3 = 0 then '' else 'rhs/1' end", {19: "'lhs/1'", 20: "'rhsx'"}),
    "target_slot": ("l_linenumber", {21: "-1"}),
    "transformation": (f"case when {_HELD} then 'rule-deduplicate' else 'identity' end", {22: "''"}),
    "input_hash": ("'in'", {23: "''"}),
    "output_hash": ("'out'", {24: "''"}),
    "source_expression_hash": ("'a'", {25: "''"}),
    "target_expression_hash": ("'b'", {26: "''"}),
    "disposition": (f"case when {_HELD} then 'suppressed' when l_partkey % 4 = 1 then 'ambiguous' else 'mapped' end", {27: "'kept'"}),
    "why": ("'same shape'", {28: "''"}),
    "kept_document": (f"case when {_HELD} then 'doc' else '' end", {29: "''", 34: "''"}),
    "kept_clause": (f"case when {_HELD} then '1' else '' end", {34: "''", 35: "'7'"}),
    "kept_rule": (f"case when {_HELD} then 'R1' else '' end", {34: "''"}),
    "kept_page": (f"case when {_HELD} then 3 else 0 end", {34: "0"}),
    "kept_end_page": ("0", {36: "1"}),
    "kept_byte_start": ("0", {37: "-2"}),
    "kept_byte_length": ("0", {}),
    "kept_occurrence": ("0", {}),
    "kept_source_hash": (f"case when {_HELD} then 'h' else '' end", {34: "''"}),
    "kept_alternative": (f"case when {_HELD} then 1 else 0 end", {33: "0", 34: "0"}),
    "kept_path": (f"case when {_HELD} then 'rhs' else '' end", {30: "'rhs/2'", 31: "''", 34: "''", 38: "'root'"}),
    "kept_slot": ("0", {32: "1", 39: "-1"}),
}
_PATH = "(regexp_like({0}, '^rhs(/|$)'))"
_ABSENT = " and ".join(
    [f"coalesce(kept_{c}, '') = ''" for c in ("document", "clause", "rule", "source_hash", "path")]
    + [f"coalesce(kept_{c}, 0) = 0" for c in ("page", "end_page", "byte_start", "byte_length", "alternative", "slot")]
)
_DEDUPED = "(disposition = 'suppressed' and transformation = 'rule-deduplicate')"
_KEPT = source_rules("kept_", "retained ") | {
    "retained alternative": "kept_alternative >= 1",
    "retained path missing": "kept_path <> ''",
    "retained path": _PATH.format("kept_path"),
    "retained slot": "kept_slot >= 0",
    "retained path is not the root": f"not {_DEDUPED} or kept_path = 'rhs'",
    "retained slot is not the root": f"not {_DEDUPED} or kept_slot = 0",
}
_checked(
    "trace_check", "lineitem", LINE, PLACE, TRACE,
    source_rules()
    | {
        "source alternative": "source_alternative >= 1",
        "raw path": "raw_path <> ''",
        "node kind": _one_of("node_kind", *NODE_KINDS),
        "node name": "node_name <> ''",
        "boundary role": "boundary_role <> ''",
        "target identity": "target_rule <> '' and target_lhs <> ''",
        "target alternative": "target_alternative >= 1",
        "target path": f"coalesce(target_path, '') = '' or {_PATH.format('target_path')}",
        "target slot": "target_slot >= 0",
        "retained target missing": f"not none_kept or not {_DEDUPED}",
    }
    | {reason: f"none_kept or ({holds})" for reason, holds in _KEPT.items()}
    | {
        "transformation": "transformation <> ''",
        "expression hash": "input_hash <> '' and output_hash <> ''",
        "source or target hash": "source_expression_hash <> '' and target_expression_hash <> ''",
        "disposition": _one_of("disposition", *DISPOSITIONS),
        "reason": "why <> ''",
    },
    _by(_SOURCE_PLANTED | {
        "source alternative": (11,), "raw path": (12,), "node kind": (13,), "node name": (14,), "boundary role": (15,), "target identity": (16, 17), "target alternative": (18,), "target path": (19, 20), "target slot": (21,),
        # A row that names no retained target has none of its fields; one field alone makes it name one that lacks a document.
        "retained target missing": "h = 34 and l_partkey % 4 = 0", "retained document": "(h = 29 and l_partkey % 4 = 0) or (h in (30, 32, 35, 36, 37, 38, 39) and l_partkey % 4 <> 0)",
        "retained page span": (36,), "retained byte span": (37,), "retained alternative": "h = 33 and l_partkey % 4 = 0", "retained path missing": "h = 31 and l_partkey % 4 = 0", "retained path": (38,), "retained slot": (39,),
        "retained path is not the root": (30,), "retained slot is not the root": (32,), "transformation": (22,), "expression hash": (23, 24), "source or target hash": (25, 26), "disposition": (27,), "reason": (28,),
    }),
    f"{_ABSENT} as none_kept",
)

# Fixed values of the layout facts.
FORMS = ("all", "free-form", "fixed-form")
TERMINATORS = ("end-of-line", "semicolon", "comment")
SIGNALS = ("trailing-ampersand", "leading-ampersand", "fixed-form-marker")
LAYOUT_KINDS = {"statement-boundary": "terminator", "statement-class-suffix": "suffix", "continuation": "signal", "keyword-name-policy": "policy"}
_KIND_OF = "case p_size % 4 when 0 then 'statement-boundary' when 1 then 'continuation' when 2 then 'keyword-name-policy' else 'statement-class-suffix' end"
FACTS: Columns = {
    "kind": (_KIND_OF, {1: "'comment'"}),
    "source_form": ("case when p_size % 5 = 0 then 'free-form' else 'all' end", {2: "'free'"}),
    "terminator": ("case when p_size % 4 = 0 then 'end-of-line' else '' end", {3: "'eol'"}),
    "suffix": ("case when p_size % 4 = 3 then '-stmt' else '' end", {4: "''", 5: "'-list'"}),
    "signal": ("case when p_size % 4 = 1 then 'leading-ampersand' else '' end", {6: "'and'"}),
    "policy": ("case when p_size % 4 = 2 then 'not-reserved' else '' end", {7: "'reserved'"}),
    "document": ("p_brand", {8: "''"}),
    "clause": ("cast(p_size % 3 + 1 as string)", {9: "null"}),
    "locator": ("'table 1'", {10: "''"}),
    "page": ("p_size % 5 + 1", {11: "0"}),
    "hash": ("sha2(p_brand, 256)", {12: "'abc'"}),
    "origin": ("case when p_size % 2 = 0 then 'mechanical' else 'human' end", {13: "'guess'"}),
}
_FACT_AT = ("part", "p_partkey", "(p_partkey * 7 + p_size) % 41", FACTS)
_FACT_FAULT = first_fault(
    {
        "kind": _one_of("kind", *LAYOUT_KINDS),
        "unexpected field": " and ".join(f"(kind = '{k}' or coalesce({field}, '') = '')" for k, field in LAYOUT_KINDS.items()),
        "source form": _one_of("source_form", *FORMS),
        "origin": _one_of("origin", *ORIGINS),
        "provenance": f"document <> '' and clause <> '' and locator <> '' and page > 0 and regexp_like(hash, '{HASH}')",
        "terminator": f"kind <> 'statement-boundary' or {_one_of('terminator', *TERMINATORS)}",
        "suffix": "kind <> 'statement-class-suffix' or suffix <> ''",
        "signal": f"kind <> 'continuation' or {_one_of('signal', *SIGNALS)}",
        "policy": f"kind <> 'keyword-name-policy' or {_one_of('policy', 'not-reserved')}",
    }
)


# A field of another kind of fact is unexpected; one of the kind's own is out of its domain.
_FACT_PLANTED = _by({
    "kind": (1,), "unexpected field": "(h = 3 and p_size % 4 <> 0) or (h = 5 and p_size % 4 <> 3) or (h = 6 and p_size % 4 <> 1) or (h = 7 and p_size % 4 <> 2)", "source form": (2,), "origin": (13,), "provenance": (8, 9, 10, 11, 12),
    "terminator": (3,), "suffix": "h = 4 and p_size % 4 = 3", "signal": (6,), "policy": (7,),
})


@query("layout_fact_check", f"""{_duck(*_FACT_AT)}, f as (select cast(p_partkey as string) as subject, {_FACT_PLANTED} as reason from (select *, (p_partkey * 7 + p_size) % 41 as h from part))
 select * from f where reason is not null
 union all select cast(min(pos) as string), 'duplicate' from rows group by {", ".join(FACTS)} having count(*) > 1
 union all select document, 'suffix facts' from rows group by document having count(*) filter (kind = 'statement-class-suffix') <> 1
 union all select cast(pos as string), 'suffix form' from rows where kind = 'statement-class-suffix' and source_form <> 'all'""")
def layout_fact_check(t):
    """The first fault of each fact (domains, fields its kind needs or forbids, provenance); facts that agree in all twelve
    fields; documents without exactly one suffix fact; suffix facts not for all forms."""
    facts = _rows(t, *_FACT_AT)
    id_ = F.col("pos").cast("string").alias("subject")
    out = facts.select(id_, F.expr(_FACT_FAULT).alias("reason")).where("reason IS NOT NULL")
    same = facts.groupBy(*FACTS).agg(F.min("pos").cast("string").alias("subject"), F.count("*").alias("n")).where("n > 1")
    suffix = F.col("kind") == "statement-class-suffix"
    count = facts.groupBy(F.col("document").alias("subject")).agg(F.count(F.when(suffix, 1)).alias("n")).where("n <> 1")
    form = facts.where(suffix & (F.col("source_form") != "all")).select(id_)
    for rows, reason in ((same, "duplicate"), (count, "suffix facts"), (form, "suffix form")):
        out = out.unionByName(rows.select("subject", F.lit(reason).alias("reason")))
    return out


def _enum(*names: str) -> Declaration:
    return Declaration("enum", tuple((n, None) for n in names))


DECLARED = {
    "origin": _enum(*ORIGINS),
    "resolution": _enum(*RESOLUTIONS),
    "source-ref": Declaration("record", (("document", "name"), ("clause", "name"), ("rule", "name"), ("page", "int"), ("source-hash", "name"))),
    "item": Declaration("sum", (("syntax", "string"), ("constraint", None), ("relation", None), ("rule", None), ("definition", None))),
    "names": Declaration("list", target="name"),
    "source-ref-option": Declaration("optional", target="source-ref"),
    "fact": Declaration(
        "record",
        (("id", "name"), ("checked", "bool"), ("page", "int"), ("origin", "origin"), ("resolution", "resolution"), ("body", "item"), ("names", "names"), ("source", "source-ref-option")),
    ),
}
_SOURCE = "concat('(source-ref (document doc) (clause ', o_custkey % 9, ') (rule R', o_orderkey, ') (page ', o_custkey % 50, ') (source-hash ab))')"
FACT: Columns = {
    "id": ("concat('S', o_orderkey)", {1: "'two words'"}),
    "checked": ("case when o_custkey % 2 = 0 then 'true' else 'false' end", {2: "'True'", 3: "null"}),
    "page": ("cast(o_custkey as string)", {4: "'007'", 5: "'-0x'", 6: "'-12'"}),
    "origin": ("case when o_custkey % 3 = 0 then 'llm' else 'llm-repair' end", {7: "'llm-'"}),
    "resolution": ("'disputed'", {8: "'open'"}),
    "body": ("case when o_custkey % 2 = 0 then concat('(syntax \"', o_orderpriority, '\")') else '(rule)' end", {9: "'(syntax)'", 10: "'(rule x)'", 11: "'(other)'"}),
    "names": ("concat('(names c', o_custkey, ' x)')", {12: "'(name x)'", 13: "'(names)'"}),
    "source": (f"case when o_custkey % 4 = 0 then 'none' else concat('(some ', {_SOURCE}, ')') end", {14: "'some'", 15: _SOURCE, 16: "'(some (source-ref (document d)))'"}),
}
_ORDER_AT = ("orders", "o_orderkey", "(o_orderkey * 7 + o_custkey * 3) % 61", FACT)
_LOST, _SWAPPED = "h = 17", "h = 18"  # records that lose their third field; whose fourth has another name


@query("record_conformance", f"""{_duck(*_ORDER_AT)}, planted as (select o_orderkey as pos, {_ORDER_AT[2]} as h from orders), v as (
 {" union all ".join(f"select pos, {i} as position, '{n}' as field, {n} as value, '{pattern(DECLARED, k)}' as form, '{DECLARED[k].kind if k in DECLARED else k}' as type from rows" for i, (n, k) in enumerate(DECLARED["fact"].members, 1))}),
 w as (select pos, position, case when {_SWAPPED} and position = 4 then 'source' else field end as given, field, value, form, type from v join planted using (pos) where not ({_LOST} and position = 3))
 select pos as record_id, given as field, case when given <> field then 'field order' else 'not of type ' || type end as reason from w
 where given <> field or not coalesce(regexp_matches(value, '\\A' || form || '\\z'), false)
 union all select pos, null, 'field count' from w group by pos having count(*) <> {len(FACT)}""")
def record_conformance(t):
    """Fields of records against the declared types: atoms, an enum, a sum, a list and an optional record."""
    rows = _rows(t, "orders", "o_orderkey", _ORDER_AT[2], FACT | {"h": ("h", {})})
    fields = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in FACT))
    v = rows.select("h", F.col("pos").alias("record_id"), F.posexplode(fields).alias("i", "f")).where(f"NOT ({_LOST} AND i = 2)")
    field = F.when(F.expr(f"{_SWAPPED} AND i = 3"), "source").otherwise(F.col("f.field"))
    return nonconforming(v.select("record_id", (F.col("i") + 1).alias("position"), field.alias("field"), "f.value"), DECLARED, "fact")


_DECLS = (
    "o_orderkey as decl_id",
    "case when o_orderkey % 89 = 3 then '' when o_orderkey % 97 = 5 then 'order-same' else concat('order-', o_orderkey) end as name",
    "case o_custkey % 5 when 0 then 'record' when 1 then 'sum' when 2 then 'list' when 3 then 'optional' else 'enum' end as kind",
    "case when o_custkey % 5 not in (2, 3) then null when o_orderkey % 2 = 0 then 'name' else concat('order-', o_orderkey - 1) end as target",
)
_MEMBERS = (
    "l_orderkey as decl_id",
    "case when l_partkey % 53 = 0 then '' when l_partkey % 31 = 0 then 'same' else concat('part-', l_partkey) end as member",
    "case l_partkey % 6 when 0 then 'int' when 1 then 'name' when 2 then concat('order-', l_suppkey) when 3 then null when 4 then 'bool' else 'string' end as type",
)


@query("schema_registry_check", f"""with d as (select {", ".join(_DECLS)} from orders), m as (select {", ".join(_MEMBERS)} from lineitem),
 known as (select name as type from d where name <> '' union select unnest({list(BUILTIN)}))
 select decl_id, null as member, 'empty name' as reason from d where name = ''
 union all select min(decl_id), null, 'duplicate declaration' from d where name <> '' group by name having count(*) > 1
 union all select decl_id, member, 'empty member' from m where member = ''
 union all select decl_id, member, 'duplicate member' from m where member <> '' group by 1, 2 having count(*) > 1
 union all select decl_id, member, 'unknown member type' from m join d using (decl_id) where kind = 'record' and coalesce(type, '') not in (select type from known)
 union all select decl_id, member, 'unknown payload type' from m join d using (decl_id) where kind = 'sum' and type <> '' and type not in (select type from known)
 union all select decl_id, null, 'unknown target type' from d where kind in ('list', 'optional') and coalesce(target, '') not in (select type from known)""")
def schema_registry_check(t):
    """Declarations (orders) and their members (line items): names given, none twice, all types known."""
    return registry_faults(t("orders").selectExpr(*_DECLS), t("lineitem").selectExpr(*_MEMBERS))
