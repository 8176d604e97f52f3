"""Contracts: ordered rules over rows, values against declared types, and declarations among themselves."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.store import tasks_for


def first_fault(rules: Mapping[str, str]) -> str:
    """SQL of the reason of the first broken rule, null if all hold. rules: reason to a condition of sound rows; a
    condition that is null is broken."""
    return "case " + " ".join(f"when not coalesce({holds}, false) then '{reason}'" for reason, holds in rules.items()) + " end"


def faulty(rows: DataFrame, rules: Mapping[str, str], *kept: str) -> DataFrame:
    """kept and the reason of the rows that break a rule. The reason comes out of an array: a filter by it would be put below it with all
    rules once more, in a method longer than the 8,000 bytes that the JVM compiles."""
    return rows.select(*kept, F.explode(F.array(F.expr(first_fault(rules)))).alias("reason")).where("reason IS NOT NULL")


def source_rules(prefix: str = "", label: str = "") -> dict[str, str]:
    """What a reference to a source must fulfil; its columns and reasons may have a prefix. An end page of 0 is none."""
    c = {n: prefix + n for n in ("document", "clause", "rule", "page", "source_hash", "end_page", "byte_start", "byte_length", "occurrence")}
    return {
        f"{label}document": f"{c['document']} <> ''",
        f"{label}clause": f"{c['clause']} <> ''",
        f"{label}rule": f"{c['rule']} <> ''",
        f"{label}page": f"{c['page']} > 0",
        f"{label}hash": f"{c['source_hash']} <> ''",
        f"{label}page span": f"{c['end_page']} = 0 or {c['end_page']} >= {c['page']}",
        f"{label}byte span": f"{c['byte_start']} >= 0 and {c['byte_length']} >= 0",
        f"{label}occurrence": f"{c['occurrence']} >= 0",
    }


@dataclass(frozen=True)
class Declaration:
    """A declared type. members: (name, type) of a record, (variant, payload type or None) of a sum, (name, None) of an
    enum; target: what a list or an optional holds."""

    kind: str
    members: tuple[tuple[str, str | None], ...] = ()
    target: str | None = None


# The types that need no declaration.
BUILTIN = ("bool", "int", "status", "node", "symbol", "type", "scope", "name", "string")
_ATOM = r'[^ \t()"\\]+'
_PRIMITIVE = {"bool": "true|false", "int": "-?(?:0|[1-9][0-9]*)", "name": _ATOM, "status": _ATOM, "string": f'"[^"]*"|{_ATOM}'}


def pattern(declared: Mapping[str, Declaration], kind: str) -> str:
    """Regular expression of the written values of a type: atoms, (some x) or none, (variant payload), (list x y) and
    (record (field x) ...). Types that contain themselves have none and raise RecursionError."""
    if kind not in declared:
        if kind not in _PRIMITIVE:
            raise ValueError(f"values of type {kind} can't be written")
        return f"(?:{_PRIMITIVE[kind]})"
    d = declared[kind]

    def of(name: str) -> str:
        return pattern(declared, name)

    forms = {
        "enum": lambda: "|".join(n for n, _ in d.members),
        "optional": lambda: rf"none|\(some {of(d.target)}\)",
        "list": lambda: rf"\({kind}(?: {of(d.target)})*\)",
        "sum": lambda: "|".join(rf"\({n}{' ' + of(payload) if payload else ''}\)" for n, payload in d.members),
        "record": lambda: rf"\({kind}{''.join(rf' \({n} {of(t)}\)' for n, t in d.members)}\)",
    }
    return f"(?:{forms[d.kind]()})"


def nonconforming(values: DataFrame, declared: Mapping[str, Declaration], record: str) -> DataFrame:
    """(record_id, field, reason) of values (record_id, position from 1, field, value) of one record type: fields beyond
    the declared ones or out of their order, values not of their type (null ones included), records with too few or too
    many fields (field null). A record without any value is not seen."""
    members = declared[record].members
    reason = F.when(F.col("position") > len(members), "unknown field")
    for i, (name, kind) in enumerate(members, 1):
        here = F.col("position") == i
        what = declared[kind].kind if kind in declared else kind
        reason = reason.when(here & ~F.coalesce(F.col("field") == name, F.lit(False)), "field order")
        reason = reason.when(here & ~F.coalesce(F.col("value").rlike(rf"\A{pattern(declared, kind)}\z"), F.lit(False)), f"not of type {what}")
    wrong = values.select("record_id", "field", reason.alias("reason")).where("reason IS NOT NULL")
    count = values.groupBy("record_id").agg(F.count("*").alias("n")).where(F.col("n") != len(members))
    return wrong.unionByName(count.select("record_id", F.lit(None).cast("string").alias("field"), F.lit("field count").alias("reason")))


def registry_faults(declarations: DataFrame, members: DataFrame) -> DataFrame:
    """(decl_id, member, reason): empty and repeated names, and unknown types, of declarations (decl_id, name, kind, target)
    and members (decl_id, member, type). A repeated name is reported once, at its smallest decl_id. Members are dealt out to as many
    tasks as their number needs."""
    tasks = tasks_for(members)
    none = F.lit(None).cast("string")
    empty = F.coalesce(F.col("name") == "", F.lit(True))
    nameless = F.coalesce(F.col("member") == "", F.lit(True))
    names = declarations.where(~empty).select("name", "decl_id").repartition(tasks, "name")
    out = declarations.where(empty).select("decl_id", none.alias("member"), F.lit("empty name").alias("reason"))
    twice = names.groupBy("name").agg(F.min("decl_id").alias("decl_id"), F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(twice.select("decl_id", none.alias("member"), F.lit("duplicate declaration").alias("reason")))
    out = out.unionByName(members.where(nameless).select("decl_id", "member", F.lit("empty member").alias("reason")))
    named = members.where(~nameless).select("decl_id", "member").repartition(tasks, "decl_id", "member")
    # The second of each, found by a sort, which takes less memory than a table of all members.
    same = named.withColumn("nth", F.row_number().over(Window.partitionBy("decl_id", "member").orderBy("member"))).where("nth = 2")
    out = out.unionByName(same.select("decl_id", "member", F.lit("duplicate member").alias("reason")))
    # Built-in types, which many members share, are left out before the join.
    typed = members.where(~F.coalesce(F.col("type").isin(*BUILTIN), F.lit(False))).repartition(tasks, "decl_id")
    typed = typed.hint("merge").join(declarations.select("decl_id", "kind").repartition(tasks, "decl_id"), "decl_id")
    typed = typed.where("kind = 'record' OR kind = 'sum' AND type <> ''")
    used = typed.select("decl_id", "member", "type", F.when(F.col("kind") == "sum", "unknown payload type").otherwise("unknown member type").alias("reason"))
    held = declarations.where(F.col("kind").isin("list", "optional") & ~F.coalesce(F.col("target").isin(*BUILTIN), F.lit(False)))
    used = used.unionByName(held.select("decl_id", none.alias("member"), F.col("target").alias("type"), F.lit("unknown target type").alias("reason")))
    # What names no type is unknown at once; it would be a single key of the join.
    none_named = F.coalesce(F.col("type") == "", F.lit(True))
    unknown = used.where(~none_named).repartition(tasks, "type").hint("merge").join(names.select(F.col("name").alias("type")), "type", "left_anti")
    unknown = unknown.unionByName(used.where(none_named))
    return out.unionByName(unknown.select("decl_id", "member", "reason"))
