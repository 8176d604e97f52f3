"""The audit of production records against the text that they were taken from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.order import Carried, scan, scan_runs
from palimpsest.sources.store import materialize


def validity(records: DataFrame, lines: DataFrame, objects: DataFrame) -> DataFrame:
    """One row a document (doc): records, starts, continuations, objects, span_mismatches, occurrence_errors, ordering_errors,
    duplicate_spans (pairs of starts), other_errors (records without an occurrence or a source line, spans that leave the document)
    and the verdict: PASS only if there are starts, as many as objects, and all errors are 0.

    records: (doc, page, line_no, copy, kind, byte_start, byte_length, occurrence, source_line), in order of page, line_no and copy; lines: (doc,
    page, line_no, line) of the text; objects: (doc, n). Spans are cut from the text of their page, so a span that
    goes on beyond it is no line of the text. What runs along a document is carried from page to page. Records and lines are to come of tables
    dealt out by doc and page: neither is shuffled or written again, pages of a row each are."""
    sizes = lines.groupBy("doc", "page").agg(F.sum(F.octet_length("line") + 1).alias("page_bytes"))
    pages = materialize(scan(sizes, ["doc"], ["page"], Carried(sums={"page_start": F.col("page_bytes")})), "pages")
    pages = pages.hint("merge").join(pages.groupBy("doc").agg((F.sum("page_bytes") - 1).alias("doc_end")), "doc").select("doc", "page", "page_start", "doc_end")
    texts = lines.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("page_text"))
    start = F.col("kind") == "production-start"
    rows = records.join(materialize(pages, "pages").hint("merge"), ["doc", "page"])
    inside = (F.col("byte_start") >= 0) & (F.col("byte_length") >= 0) & (F.col("byte_start") + F.col("byte_length") <= F.col("doc_end"))
    rows = rows.withColumn("inside", inside)
    started = F.when(start, F.col("occurrence"))
    carried = Carried(prior={"end_before": F.when(F.col("inside"), F.col("byte_start") + F.col("byte_length")), "start_before": started}, last={"active": started})
    rows = scan_runs(rows, ["doc"], ["page"], ["line_no", "copy"], carried, dealt=True)
    rows = rows.join(texts.hint("merge"), ["doc", "page"])
    cut = F.expr("substring(cast(page_text as binary), cast(byte_start - page_start + 1 as int), cast(byte_length as int))")
    given = F.substring(F.col("source_line").cast("binary"), F.lit(1), F.col("byte_length").cast("int"))
    differs = F.col("source_line").isNull() | (F.col("byte_start") < F.col("page_start")) | (cut != given)
    found = {
        "span_mismatches": F.col("inside") & (F.col("byte_length") > 0) & differs,
        "occurrence_errors": F.when(start, F.coalesce(F.col("occurrence") <= F.col("start_before"), F.lit(False))).otherwise(~F.coalesce(F.col("occurrence") == F.col("active"), F.lit(False))),
        "ordering_errors": F.col("inside") & F.coalesce(F.col("byte_start") < F.col("end_before"), F.lit(False)),
        "other_errors": F.col("occurrence").isNull() | F.col("source_line").isNull(),
        "outside": ~F.col("inside"),
    }
    counted = rows.groupBy("doc").agg(F.count("*").alias("records"), F.count_if(start).alias("starts"), F.count_if(~start).alias("continuations"), *(F.count_if(c).alias(n) for n, c in found.items()))
    pairs = records.where(start).groupBy("doc", "byte_start", "byte_length").agg(F.count("*").alias("n")).groupBy("doc").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("duplicate_spans"))
    out = counted.join(pairs, "doc", "left").join(objects.select("doc", F.col("n").alias("objects")), "doc", "left").fillna(0, ["duplicate_spans", "objects"])
    out = out.withColumn("other_errors", F.col("other_errors") + F.col("outside"))
    errors = sum((F.col(c) for c in ("occurrence_errors", "ordering_errors", "duplicate_spans", "other_errors")), F.col("span_mismatches"))
    sound = (F.col("starts") > 0) & (F.col("starts") == F.col("objects")) & (errors == 0)
    return out.select("doc", "records", "starts", "continuations", "objects", "span_mismatches", "occurrence_errors", "ordering_errors", "duplicate_spans", "other_errors", F.when(sound, "PASS").otherwise("FAIL").alias("verdict"))
