"""Merkle fixity audit of WARC archives.

Pages become WARC records at running offsets of archive files. Records are hashed; a node of the tree is the hash of its
children in order, each with its number, the range of offsets it covers and its own hash, level by level, up to a file's
root. Ranges count from where the node begins, so a record that is lost, added or of another length changes the nodes above it,
and not those of the records that it moves. Two replicas are compared from the roots down: children are compared only
below nodes that differ, so sound files end at their roots. Every file's tree has the same depth, set by the slots a file has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

#: Slots of an archive file, and children of a node of the tree.
SLOTS, FANOUT = 1000, 10
#: Files of pages without an id: their number, below the first of these.
UNNAMED, UNNAMED_FILES = -(1 << 60), 1 << 20


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A page's WARC record; null url and html count as empty."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(page_id, warc_file, slot, record_offset, record_length, record_sha256): one row a page, in order of page_id within
    its file. Pages with a null id are dealt over files of their own by their content, so that one whose content changes is
    missing at one place and extra at another. Repeated ids share a slot and follow one another in order of
    their hashes. The window holds one file's rows, without their text."""
    text = record_text(F.col("page_id"), F.col("url"), F.col("html"))
    unnamed = F.lit(UNNAMED) - F.pmod(F.xxhash64("url", "html"), F.lit(UNNAMED_FILES))
    rows = pages.select(
        "page_id",
        F.coalesce(F.expr(f"(page_id - pmod(page_id, {slots})) div {slots}"), unnamed).cast("long").alias("warc_file"),
        F.pmod(F.coalesce("page_id", F.xxhash64("html", "url")), F.lit(slots)).cast("int").alias("slot"),
        F.octet_length(text).cast("long").alias("record_length"),
        F.sha2(text, 256).alias("record_sha256"),
    )
    before = Window.partitionBy("warc_file").orderBy("slot", "record_sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("record_offset", F.coalesce(F.sum("record_length").over(before), F.lit(0)))


def tree(recs: DataFrame, slots: int = SLOTS, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the tree, leaves first: (warc_file, idx, hash, begin, end). A leaf covers a slot's records, a node
    up to fanout children in order; begin and end are the offsets it covers. Each level is written out."""

    def fold(rows: DataFrame) -> DataFrame:
        inside = F.array_sort(F.collect_list(F.struct("child", "begin", "end", "hash")))
        nodes = rows.groupBy("warc_file", "idx").agg(inside.alias("inside"), F.min("begin").alias("begin"), F.max("end").alias("end"))
        part = F.transform("inside", lambda x: F.concat_ws(":", x["child"], x["begin"] - F.col("begin"), x["end"] - F.col("begin"), x["hash"]))
        return materialize(nodes.select("warc_file", "idx", F.sha2(F.array_join(part, "\n"), 256).alias("hash"), "begin", "end"), "tree")

    end = F.col("record_offset") + F.col("record_length")
    # Repeated ids of a slot go by their offsets; as child they have no number.
    levels, width = [fold(recs.select("warc_file", F.col("slot").alias("idx"), F.lit(0).alias("child"), F.col("record_offset").alias("begin"), end.alias("end"), F.col("record_sha256").alias("hash")))], slots
    while width > 1:
        width = -(-width // fanout)
        levels.append(fold(levels[-1].select("warc_file", F.col("idx").alias("child"), F.floor(F.col("idx") / fanout).cast("int").alias("idx"), "hash", "begin", "end")))
    return levels


def damaged(first: list[DataFrame], second: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(warc_file, slot, status): leaves that differ, found from the roots down: missing in the second replica, extra there, or
    corrupt (in both, with other content)."""
    below = None
    for a, b in zip(reversed(first), reversed(second), strict=True):
        if below is not None:
            parent = F.floor(F.col("idx") / fanout).cast("int").alias("up")
            near = below.select("warc_file", F.col("idx").alias("up"))
            a, b = (x.select("*", parent).hint("merge").join(near, ["warc_file", "up"], "left_semi").drop("up") for x in (a, b))
        other = b.select("warc_file", "idx", F.col("hash").alias("other"))
        below = a.select("warc_file", "idx", "hash").hint("merge").join(other, ["warc_file", "idx"], "full").where(~F.col("hash").eqNullSafe(F.col("other")))
        status = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("corrupt")
        below = materialize(below.select("warc_file", "idx", status.alias("status")), "differing")
    return below.withColumnRenamed("idx", "slot")


def audit(first: DataFrame, second: DataFrame, slots: int = SLOTS, fanout: int = FANOUT) -> DataFrame:
    """Records of the first replica with status intact, corrupt or missing in the second, and the second's records in slots that
    the first hasn't, with status extra and their own offsets. All records of a slot share its status. Empty replicas give no rows;
    a missing replica file makes its records missing. Null urls and html count as empty; extra columns are not carried."""
    a, b = materialize(records(first, slots), "records"), materialize(records(second, slots), "records")
    found = damaged(tree(a, slots, fanout), tree(b, slots, fanout), fanout)
    names = ["page_id", "warc_file", "record_offset", "record_length", "record_sha256"]
    own = a.hint("merge").join(found, ["warc_file", "slot"], "left").select(*names, F.coalesce("status", F.lit("intact")).alias("status"))
    added = b.hint("merge").join(found.where("status = 'extra'"), ["warc_file", "slot"]).select(*names, "status")
    return own.unionByName(added)
