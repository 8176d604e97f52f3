"""Duplicates and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.order import Carried, attach, ranked, scan
from palimpsest.sources.store import materialize


def merge_provenance(rows: DataFrame, key: list[Column], pos: str, provenance: str) -> DataFrame:
    """(kept, copies, provenance): the first row of each key (nulls are equal to nulls alone), and the distinct sources of all. The sources of a
    key are made distinct by a group of their own first, so that no list grows with the copies."""
    keys = [f"k{i}" for i in range(len(key))]
    keyed = rows.select(*(k.alias(name) for k, name in zip(key, keys, strict=True)), F.col(pos).alias("pos"), F.col(provenance).alias("p"))
    each = keyed.groupBy(*keys, "p").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))
    return each.groupBy(*keys).agg(F.min("pos").alias("kept"), F.sum("n").alias("copies"), F.array_join(F.array_sort(F.collect_list("p")), ",").alias("provenance")).drop(*keys)


def intern(keys: DataFrame, key: str, pos: str, parts: int | None = None) -> DataFrame:
    """(key, id): dense ids from 1 in order of first position, which may be a struct. Positions are cut into ranges; ranks run inside a range, after
    the number of keys in the ranges before it. What comes to the driver is one number a range."""
    return _placed_keys(keys, key, pos, parts).select("key", "id")


def _placed_keys(keys: DataFrame, key: str, pos: str, parts: int | None = None) -> DataFrame:
    """intern with the first positions, first_pos."""
    n = parts or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = materialize(keys.groupBy(F.col(key).alias("key")).agg(F.min(pos).alias("first_pos")), "keys")
    ranged = materialize(first.repartitionByRange(n, "first_pos").withColumn("part", F.spark_partition_id()), "ranges")
    total, offsets = 0, {}
    for r in ranged.groupBy("part").count().orderBy("part").collect():
        offsets[r["part"]], total = total, total + r["count"]
    if not offsets:
        return ranged.select("key", "first_pos", F.lit(0).cast("long").alias("id"))
    offset = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))[F.col("part")]
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first_pos", "key"))
    return ranged.select("key", "first_pos", (offset + rank).cast("long").alias("id"))


def interned(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """All columns of rows plus id, is_new and fault: the dense id of each row's key, whether the row is its first by pos, and `empty key`
    for null and empty keys, which have no id. Ids of few keys are sent to all tasks; those of many are merged. Rows are grouped by
    their keys once, for ids and first positions together."""
    empty = F.coalesce(F.col(key) == "", F.lit(True))
    named = rows.where(~empty)
    side = _placed_keys(named, key, pos).withColumnsRenamed({"key": "__key", "first_pos": "__first"})
    found = attach(named.withColumn("__key", F.col(key)), side, ["__key"])
    found = found.withColumns({"is_new": F.col(pos) == F.col("__first"), "fault": F.lit(None).cast("string")}).select(*rows.columns, "id", "is_new", "fault")
    return found.unionByName(rows.where(empty).withColumn("fault", F.lit("empty key")), allowMissingColumns=True)


def coalesce(rows: DataFrame, location: list[str], evidence: list[str]) -> DataFrame:
    """(location, evidence, fault): rows of one location become a site with an array of their evidence; a piece of evidence that
    stands there twice is a fault. Nulls of a location are one value."""
    sites = rows.groupBy(*location).agg(F.collect_list(F.struct(*evidence)).alias("evidence"))
    return sites.withColumn("fault", F.when(F.size("evidence") > F.size(F.array_distinct("evidence")), "evidence is repeated"))


def members(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, member, first, members, place): the rows of a group numbered from 1 in order, with the order of its first row, how many
    there are, and the place of the group among groups by their first rows. A group is rows, never a list."""
    own = rows.select(F.col(key).alias("key"), F.col(order).alias("order"))
    each = own.groupBy("key").agg(F.min("order").alias("first"), F.count("*").alias("members"))
    groups = ranked(each, ["first", "key"])
    numbered = scan(own, ["key"], ["order"], Carried(sums={"member": F.lit(1)})).withColumn("member", F.col("member") + 1)
    groups, numbered = (x.withColumn("key", F.struct("key")) for x in (groups, numbered))  # structs of null are equal
    return attach(numbered, groups, ["key"]).select("key.key", "order", "member", "first", "members", "place")


def tree_digests(rows: DataFrame, key: str, order: str, text: str, fanout: int = 256) -> DataFrame:
    """(key, digest, bytes, pieces) of the pieces of each group in order. A piece's own SHA-256 is a leaf; fanout nodes that follow one another
    make a node, the SHA-256 of their digests joined; a node that is alone in its group is its digest. So no task holds
    more than fanout digests of a group, and the digest depends on the pieces and their order alone."""
    leaves = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.sha2(text, 256).alias("h"), F.octet_length(text).cast("long").alias("size"))
    leaves = materialize(leaves, "leaves")
    totals = materialize(leaves.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("pieces")), "totals")
    nodes = scan(leaves.select("key", "order", "h"), ["key"], ["order"], Carried(sums={"at": F.lit(1)})).select("key", F.col("at").cast("long").alias("at"), F.coalesce("h", F.lit("")).alias("h"))
    left = totals.agg(F.max("pieces")).first()[0] or 0
    first = True
    while first or left > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "")
        above = nodes.groupBy("key", F.floor(F.col("at") / fanout).alias("up")).agg(F.count("*").alias("n"), F.min("h").alias("only"), joined.alias("joined"))
        # A single node of a group is done; a last run of one node is hashed like any other.
        alone = (F.col("n") == 1) & (F.col("up") == 0) if not first else F.lit(False)
        nodes = materialize(above.select("key", F.col("up").alias("at"), F.when(alone, F.col("only")).otherwise(F.sha2("joined", 256)).alias("h")), "nodes")
        left, first = -(-left // fanout), False
    both = nodes.select(F.struct("key").alias("key"), F.col("h").alias("digest")).join(totals.withColumn("key", F.struct("key")).hint("merge"), "key")
    return both.select("key.key", "digest", "bytes", "pieces")
