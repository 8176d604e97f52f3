"""Facts with ranges of code points, in tables of any number: their faults, and the fact that a scalar falls under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.order import Carried, scan
from palimpsest.sources.store import materialize

#: Code points of a bin; ranges are joined to scalars by the bins that they touch.
BIN = 1024
LAST = 0x10FFFF


def is_scalar(c: Column) -> Column:
    return c.between(0, LAST) & ~c.between(0xD800, 0xDFFF)


def fact_faults(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(tbl, fact, reason) for each fault of each fact. facts: (tbl, fact, source_term, target, class, document, clause, page, hash,
    codepoint); ranges: (tbl, fact, first, last). Of facts that repeat a term or a target all but the first, by number, are at fault, and
    of ranges that overlap the one that begins later, in the same fact or another: a table's ranges in order with the highest
    end before, which is carried from range to range of the sort, so that a table may have any number. Reversed ranges overlap
    nothing."""
    key = ["tbl", "fact"]

    def empty(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | (F.coalesce(F.trim(F.col(n).cast("string")), F.lit("")) == "")
        return out

    numbers = ranges.groupBy(*key).agg(F.count("*").alias("n"))
    rows = facts.hint("merge").join(numbers, key, "left")
    found = F.array_compact(F.array(
        F.when(empty("source_term", "target", "class"), "lacks source term, class or target"),
        F.when(empty("document", "clause", "page") | ~F.coalesce(F.col("hash").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)), "lacks provenance"),
        F.when(F.col("n").isNull() & ~F.coalesce(F.col("codepoint") == "processor-defined", F.lit(False)), "has neither scalar nor range"),
    ))
    out = rows.select(*key, F.explode(found).alias("reason"))
    for name, reason in (("source_term", "repeats a source term"), ("target", "repeats a target")):
        named = facts.where(~empty(name)).select(*key, name)
        first = named.groupBy("tbl", name).agg(F.min("fact").alias("first"), F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(named.hint("merge").join(first, ["tbl", name]).where("fact <> first").select(*key, F.lit(reason).alias("reason")))
    own = F.array_compact(F.array(
        F.when(~is_scalar(F.col("first")) | ~is_scalar(F.col("last")), "range outside Unicode scalars"),
        F.when(F.col("first") > F.col("last"), "reversed range"),
    ))
    out = out.unionByName(ranges.select(*key, F.explode(own).alias("reason")))
    ordered = scan(ranges.where("first <= last"), ["tbl"], ["first", "last", "fact"], Carried(highest={"reach": F.col("last")}))
    return out.unionByName(ordered.where("reach >= first").select(*key, F.lit("overlapping ranges").alias("reason"))).distinct()


def lookup(points: DataFrame, facts: DataFrame, ranges: DataFrame, unchecked: DataFrame | None = None) -> DataFrame:
    """points (tbl, cp, more) with status and fact: `invalid_scalar` if cp is no Unicode scalar; `invalid_facts` if the table has a fault;
    `match` with the fact whose range holds it; `ambiguous` if several do, which only tables of `unchecked` (tbl), whose facts are taken as
    they are, can have; `unsupported` with the first fact that is processor-defined if none does; else `no_match`. Ranges are
    joined by the bins that they touch, of which Unicode has few."""
    faulty = fact_faults(facts, ranges).select("tbl").distinct()
    if unchecked is not None:
        faulty = faulty.join(unchecked.select("tbl").distinct().hint("merge"), "tbl", "left_anti")
    faulty = materialize(faulty, "faulty").withColumn("faulty", F.lit(True))
    with_range = ranges.select("tbl", "fact").distinct()
    defined = facts.join(with_range.hint("merge"), ["tbl", "fact"], "left_anti").groupBy("tbl").agg(F.min("fact").alias("defined"))
    clipped = ranges.where(f"first <= last AND last >= 0 AND first <= {LAST}")
    low, high = (F.floor(x / BIN).cast("int") for x in (F.greatest("first", F.lit(0)), F.least("last", F.lit(LAST))))
    binned = materialize(clipped.select("tbl", "fact", "first", "last", F.explode(F.sequence(low, high)).alias("bin")), "bins")
    asked = materialize(points.select("tbl", "cp").where(is_scalar(F.col("cp"))).distinct().withColumn("bin", F.floor(F.col("cp") / BIN).cast("int")), "asked")
    met = asked.join(binned.hint("merge"), ["tbl", "bin"]).where("cp between first and last")
    met = met.groupBy("tbl", "cp").agg(F.count_distinct("fact").alias("n"), F.min("fact").alias("hit"))
    rows = points.hint("merge").join(met, ["tbl", "cp"], "left").hint("merge").join(faulty, "tbl", "left").hint("merge").join(defined, "tbl", "left")
    status = F.when(~is_scalar(F.col("cp")), "invalid_scalar").when(F.col("faulty"), "invalid_facts").when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "match")
    rows = rows.withColumn("status", status.when(F.col("defined").isNotNull(), "unsupported").otherwise("no_match"))
    fact = F.when(F.col("status") == "match", F.col("hit")).when(F.col("status") == "unsupported", F.col("defined"))
    return rows.select(*points.columns, "status", fact.alias("fact"))
