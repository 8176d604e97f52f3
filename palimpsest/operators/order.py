"""Total orders, and what runs along them: places, sums, and state that is carried from row to row, for keys of any number of rows.

Rows are cut into ranges of their order. Inside a range windows do the work; what a range hands on to those after it is one row,
and a range needs such a row only for the key that it begins with, so no task ever sorts or holds all rows of a key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.store import dealt_out, materialize


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All columns plus place, from 1, in order of keys. Rows are cut into ranges of the keys; a range's places follow the
    number of rows before it, so no task sorts everything. One number a range comes to the driver."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(rows.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    total, before = 0, {}
    for r in cut.groupBy("__part").count().orderBy("__part").collect():
        before[r["__part"]], total = total, total + r["count"]
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("__part")] if before else F.lit(0)
    place = offset + F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return cut.withColumn("place", place.cast("long")).drop("__part")


@dataclass
class Carried:
    """What scan adds, by name: sums of the rows before; last, the last value that isn't null, of this row and those before; prior, the
    same of the rows before alone; highest, the maximum of the rows before. Without one, sums are 0 and the others null."""

    sums: dict[str, Column] = field(default_factory=dict)
    last: dict[str, Column] = field(default_factory=dict)
    prior: dict[str, Column] = field(default_factory=dict)
    highest: dict[str, Column] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [*self.sums, *self.last, *self.prior, *self.highest]

    def inside(self, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        """The columns as if a key's rows were all of it; sums are null for none."""
        by = Window.partitionBy(*key).orderBy(*order)
        before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = {n: F.sum(c).over(before) for n, c in self.sums.items()}
        out |= {n: F.last(c, ignorenulls=True).over(upto) for n, c in self.last.items()}
        out |= {n: F.last(c, ignorenulls=True).over(before) for n, c in self.prior.items()}
        return rows.withColumns(out | {n: F.max(c).over(before) for n, c in self.highest.items()})

    def handed_on(self, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
        """One row a key: what its rows hand on, the latest values as structs of order and value."""
        at = [F.col(c) for c in order]
        latest = {n: F.max(F.when(c.isNotNull(), F.struct(*at, c.alias("value")))) for n, c in (self.last | self.prior).items()}
        out = {n: F.sum(c) for n, c in self.sums.items()} | latest | {n: F.max(c) for n, c in self.highest.items()}
        return rows.groupBy(*key).agg(*(c.alias(n) for n, c in out.items()))

    def of_runs(self) -> Carried:
        """The same over rows of handed_on."""
        return Carried({n: F.col(n) for n in self.sums}, {}, {n: F.col(f"{n}.value") for n in self.last | self.prior}, {n: F.col(n) for n in self.highest})

    def joined(self, names: list[str]) -> dict[str, Column]:
        """Own columns together with those that came from before, which are called names."""
        from_before = dict(zip(self.names(), map(F.col, names), strict=True))
        out = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(from_before[n], F.lit(0)) for n in self.sums}
        out |= {n: F.coalesce(F.col(n), from_before[n]) for n in self.last | self.prior}
        return out | {n: F.greatest(F.col(n), from_before[n]) for n in self.highest}


def scan(rows: DataFrame, key: list[str], order: list[str], carried: Carried) -> DataFrame:
    """All columns plus those of carried, along order inside each key (nulls are a key). Keys of any number of rows: rows are cut into
    ranges of (key, order). Rows that agree in key and order come in any sequence."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(rows.repartitionByRange(n, *key, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    runs = carried.handed_on(cut, ["__part", *key], order)
    # A key has one run a range at most, and only the key that a range begins with has any before it.
    before = carried.of_runs().inside(runs.select("__part", *key, *(F.col(c).alias(c) for c in carried.names())), key, ["__part"])
    follows = F.row_number().over(Window.partitionBy(*key).orderBy("__part")) > 1
    names = [f"__before_{n}" for n in carried.names()]
    before = before.withColumn("__follows", follows).where("__follows")
    before = before.select(F.col("__part").alias("__at"), F.struct(*key).alias("__key"), *(F.col(c).alias(n) for c, n in zip(carried.names(), names, strict=True)))
    own = carried.inside(cut, ["__part", *key], order)
    same = F.col("__part").eqNullSafe(F.col("__at"))
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__key.{c}"))
    # One row a range at most.
    both = own.join(F.broadcast(before), same, "left")
    return both.withColumns(carried.joined(names)).drop("__part", "__at", "__key", *names)


def scan_runs(rows: DataFrame, key: list[str], run: list[str], order: list[str], carried: Carried, dealt: bool = False) -> DataFrame:
    """As scan, where columns run, which aren't null, cut a key's rows into bounded runs that follow one another by run: rows, with what they
    carry, are worked out and dealt out by key and run once, and only what a run hands on is scanned along the key. dealt: rows come of a table
    dealt out by key and run and aren't written again; what they carry is worked out twice instead."""
    given = {f"__given_{n}": c for kind in (carried.sums, carried.last, carried.prior, carried.highest) for n, c in kind.items()}
    rows = rows.withColumns(given) if dealt else dealt_out(rows.withColumns(given), *key, *run)
    carried = Carried(*({n: F.col(f"__given_{n}") for n in kind} for kind in (carried.sums, carried.last, carried.prior, carried.highest)))
    own = carried.inside(rows, [*key, *run], order).drop(*given)
    runs = carried.handed_on(rows, [*key, *run], order)
    before = scan(runs, key, run, carried.of_runs())
    names = [f"__before_{n}" for n in carried.names()]
    before = before.select(*key, *run, *(F.col(c).alias(n) for c, n in zip(carried.names(), names, strict=True)))
    return own.join(before.hint("merge"), [*key, *run]).withColumns(carried.joined(names)).drop(*names)


def attach(rows: DataFrame, side: DataFrame, keys: list[str], most: int = 100_000) -> DataFrame:
    """rows with the columns of side, which has one row a key: sent to all tasks if it is counted to be small, merged otherwise."""
    side = materialize(side, "side")
    return rows.join(F.broadcast(side) if side.count() <= most else side.hint("merge"), keys)
