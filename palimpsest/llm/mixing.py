"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target is its weighted share of all words, at most `max_repeat` times its own size.
Each of its documents first gets the whole copies that are certain (the integer part of target /
size). The rest is a fixed-size sample of unequal inclusion odds: document i, with inclusion
probability p_i in proportion to its propensity, is ranked by (u / (1 - u)) / (p_i / (1 - p_i)),
u a hash of its id and text, and the lowest ranks are taken until their words reach what is left.
The running sum needs no source in one task: ranks are cut into bins, the bins' sums are added
up, and only the bin in which a source's cut falls is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, materialize, spare

#: Fixed values of the weights, in order of the sources, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
#: Documents of a source in a bin of ranks, on average.
BIN_ROWS = 500


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, docs, source_size, target) from (source, size): one row a source. Sources by code
    point, null last, take the weights in turn. Where weight * level passes max_repeat * size,
    the target stops there and the level rises for the others, until none is above: with sources
    by size / weight, the level is the first prefix's whose next source is under its stop.
    A total of zero gives targets of zero. The windows here run over sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by = by.withColumn("w", w).withColumn("stop", (F.col("source_size") * max_repeat).cast("double"))
    ratio = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    past, rest = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(past), F.lit(0.0))) / F.sum("w").over(rest))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.col("level"))).over(every)
    return by.select("source", "docs", "source_size", F.coalesce(F.least("stop", F.col("w") * level), F.col("stop")).alias("target"))


def odds_rank(key: Column, p: Column) -> Column:
    """Pareto rank mapped to 0..1: q / (1 + q), q = random odds / inclusion odds."""
    u = (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    a = u * (1 - p)
    return a / (a + (1 - u) * p)


def row_key(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, key) for every row. Inclusion probabilities rise with
    the square root of a document's size. No row gets more than max_repeat copies; the words taken
    of a source differ from its target by half a document at the cut, or by what whole rows
    can't reach. Empty and null texts have size 0 and are never sampled. Rows that agree in id and text
    share a key and are told apart by nothing: which of them is taken is not defined, how many is. A null source is a source;
    a null id is ranked by its text. An empty table gives no rows. Extra columns are not carried."""
    key = row_key(F.col(id_col), F.col(text_col), seed)
    sizes = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "sizes")
    aim = materialize(targets(sizes, weights, max_repeat), "targets")
    roots = sizes.groupBy("source").agg(F.sum(F.sqrt("size")).alias("roots"), F.sum(F.sqrt("size") * F.col("size")).alias("root_words"))
    aim = aim.join(roots, aim["source"].eqNullSafe(roots["source"]), "left").drop(roots["source"])
    whole = F.least(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))), F.lit(max_repeat))
    aim = aim.withColumn("whole", whole.cast("int")).withColumn("left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    aim = aim.withColumn("left", F.when(F.col("whole") >= max_repeat, F.lit(0.0)).otherwise(F.col("left")))
    aim = aim.withColumn("rate", F.col("left") / F.greatest("root_words", F.lit(1e-9))).withColumn("bins", F.ceil(F.col("docs") / BIN_ROWS))
    # One row a source, and sources are few: the size of this side is checked before it is broadcast.
    small = aim.count() <= 100_000
    p = F.greatest(F.least(F.col("rate") * F.sqrt("size"), F.lit(1 - 1e-9)), F.lit(1e-12))
    ranked = sizes.join(F.broadcast(aim) if small else aim.hint("merge"), sizes["source"].eqNullSafe(aim["source"]), "left").drop(aim["source"])
    ranked = ranked.withColumn("rank", odds_rank(F.col("key"), p)).withColumn("bin", F.least(F.floor(F.col("rank") * F.col("bins")), F.col("bins") - 1))
    ranked = materialize(ranked.select("doc_id", "source", "size", "source_size", "target", "whole", "left", "rank", "bin", "key"), "ranked")
    sums = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = materialize(
        sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
        .select("source", F.col("bin").alias("cut"), "before"),
        "cuts",
    )
    placed = ranked.join(F.broadcast(cuts) if small else cuts.hint("merge"), ranked["source"].eqNullSafe(cuts["source"]), "left").drop(cuts["source"])
    # A source without a cut needs no extra copy (left = 0) or one of everything (rounding).
    settled = placed.where("cut IS NULL OR bin <> cut").withColumn("extra", F.when(F.col("size") == 0, F.lit(0)).when(F.col("cut").isNull(), (F.col("left") > 0).cast("int")).otherwise((F.col("bin") < F.col("cut")).cast("int")))
    inside = Window.partitionBy("source", "bin").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where("bin = cut").withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("extra", ((F.col("size") > 0) & (F.col("ahead") + F.col("size") / 2 < F.col("left"))).cast("int")).drop("ahead")
    out = settled.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key")


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mixed rows themselves, each as often as it was taken, with all columns of docs. Rows that
    agree in id and text share their copies as evenly as can be."""
    seed = options.get("seed", "mix")
    key, copies, n, r, times, copy = spare(docs, "own_key", "copies", "n_rows", "row_no", "times", "copy_no")
    taken = mix(docs, id_col, text_col, source_col, **options).where("copies > 0").groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies))
    # Written, or the driver plans the whole mix again at each stage of the join below.
    taken = materialize(taken, "taken")
    keyed = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col), seed)).hint("merge").join(taken, key)
    same = Window.partitionBy(key)
    keyed = keyed.withColumn(n, F.count("*").over(same)).withColumn(r, F.row_number().over(same.orderBy(F.xxhash64(*docs.columns))))
    each = F.floor(F.col(copies) / F.col(n)) + (F.col(r) <= F.col(copies) % F.col(n)).cast("long")
    keyed = keyed.withColumn(times, each).where(F.col(times) > 0)
    return keyed.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
