"""Glyphs page by page: the same as over rows that lie anywhere, and nothing shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import glyphs, windows
from palimpsest.plans.catalog import QUERIES
from palimpsest.plans.fixtures import glyph_pages, view

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def pages(spark):
    """Pages with glyphs out of order, of several characters, at equal places, with blanks, and one of more rows than an Arrow batch."""
    rng, rows = random.Random(3), []
    for page in range(40):
        for i in rng.sample(range(25_000 if page == 7 else 60), 25_000 if page == 7 else page):
            x = rng.choice([0.0, 1.5, 6.0, 30.0]) + 6.0 * (i % 40)
            rows.append((f"p{page}", i, rng.choice([" ", "a", "é", "😀", "ffi", "\n"]), x, x + rng.choice([1.0, 5.0, -2.0]), 12.0 * (i // 40) + rng.choice([0.0, 0.5, 3.0, 3.5])))
    return spark.createDataFrame(rows, "doc_id string, text_index long, ch string, x1 double, x2 double, y1 double").coalesce(1)


def test_pages_as_rows_anywhere(spark, pages, monkeypatch):
    monkeypatch.setattr(glyphs, "AT_ONCE", 500)
    anywhere = windows.reading_order(pages.repartition(5))
    want = sorted(map(tuple, anywhere.select("doc_id", "text_index", "glyph_line", "place").collect()))
    assert sorted(map(tuple, glyphs.reading_order(pages).collect())) == want
    spaced = windows.gap_spaces(anywhere)
    want = spaced.groupBy("doc_id").agg(F.count(F.when(F.col("gap"), 1)).alias("gaps"), F.count("*").alias("glyphs")).collect()
    assert sorted(map(tuple, glyphs.gap_counts(pages).collect())) == sorted(map(tuple, want))
    assert sorted(map(tuple, glyphs.page_text(pages).collect())) == sorted(map(tuple, windows.canonical_page_text(spaced).collect()))
    got, text = {}, {}
    for r in glyphs.layout_records(pages).collect():
        got[r["doc_id"], r["text_index"]] = r
    for (page, _), r in sorted(got.items()):
        assert (r["byte_offset"], r["byte_length"]) == (text.get(page, 0), len(r["ch"].encode()))
        text[page] = text.get(page, 0) + r["byte_length"]
    assert all(r["text_bytes"] == text[page] and r["text_length"] == sum(p == page for p, _ in got) for (page, _), r in list(got.items())[:300])
    assert glyphs.page_text(pages.limit(0)).count() == glyphs.layout_records(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["extract_layout_records", "canonical_page_text", "gap_spaces", "reading_order"])
def test_no_shuffle(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_glyphs_are_drawn_where_they_are_worked_on(spark, tmp_path, monkeypatch):
    """Odd pages give the glyphs of the view, and no row of a glyph goes from the JVM to Python."""
    texts = [None, "", "a", "\n", "é\x00😀\f\r\n b", "日本 " * 90, "ab " * 700, "", None, "x😀" * 33, "\n\n", " ", "end"]
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    given, pages = view(spark, str(tmp_path), "glyphs"), glyph_pages(view(spark, str(tmp_path), "documents"))
    for at_once in (glyphs.AT_ONCE, 50):
        monkeypatch.setattr(glyphs, "AT_ONCE", at_once)
        for f in (glyphs.layout_records, glyphs.reading_order, glyphs.gap_counts, glyphs.page_text):
            want, got = f(given), f(pages)
            assert got.schema == want.schema
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    for name in ("extract_layout_records", "canonical_page_text", "gap_spaces", "reading_order"):
        assert "Generate" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
