"""Text to rows: lines with byte spans, classifiers, tokens; string, byte and hash functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the notation.
GRAMMAR_MARKS = "[(.+-*/=_'\""
PROSE_PREFIXES = ("The", "A ", "An ", "Each ", "For ", "This ", "Examples", "is ", "shall ", "must ", "means ", "where ", "which ", "that ", "if ")
BOUNDARY_PREFIXES = ("NOTE", "Table", "Examples", "See ")
LAYOUT_PREFIXES = ("J3/", "2023-", "2024-", "2025-", "WD ")


def line_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, byte_start, byte_length, line). Lines end at line feeds, which aren't counted; a trailing line
    feed gives no last line; null and empty texts have no lines. Starts are summed inside the row of a text, so nothing is
    shuffled; repeated ids don't mix."""
    spans = docs.select(F.col(id_col).alias("doc_id"), F.explode(spans_of(F.col(text_col))).alias("s"))
    return spans.select("doc_id", *(F.col(f"s.{c}") for c in ("line_no", "byte_start", "byte_length", "line")))


def spans_of(text: Column) -> Column:
    """Array of a text's lines as structs of line_no, byte_start, byte_length and line. A running sum keeps the ends alone, and
    the lines are taken in beside it."""
    lines = F.split(text, "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.flatten(F.transform(F.array(lines), _with_starts))


def _with_starts(lines: Column) -> Column:
    # Sums of a block of lines first, so that no array grows with each line of a long text.
    block = 512
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / block).cast("int")), lambda b: F.slice(lines, b * block + 1, F.lit(block)))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)

    def starts(sizes: Column, first: Column) -> Column:
        return F.aggregate(sizes, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def spans(parts: Column) -> Column:
        begins = starts(F.transform(parts, total), F.lit(0).cast("long"))

        def inside(part: Column, b: Column) -> Column:
            own = F.transform(F.array(starts(F.transform(part, lambda x: F.octet_length(x).cast("long") + 1), F.get(begins, b))), lambda at: F.transform(part, lambda x, i: _span(b * block + i, F.get(at, i), x)))
            return F.get(own, 0)

        return F.flatten(F.transform(parts, inside))

    found = F.flatten(F.transform(F.array(blocks), spans))
    return F.when(F.size(lines) > 0, found)


def _span(line_no: Column, start: Column, line: Column) -> Column:
    return F.struct(line_no.cast("long").alias("line_no"), start.alias("byte_start"), F.octet_length(line).cast("long").alias("byte_length"), line.alias("line"))


def cut_spans(docs: DataFrame, start: Callable[[Column], Column], length: Callable[[Column], Column], *more: str) -> DataFrame:
    """(doc_id, line_no, byte_start, byte_length, reason, more) of all lines of docs (doc_id, text): `out of range` where the span
    (start, length), functions of a line's struct, leaves the text's bytes, `other text` where the bytes aren't the line's, else
    null. Each line is cut inside the row of its text, which isn't joined to its lines."""
    raw = F.col("text").cast("binary")

    def judged(s: Column) -> Column:
        at, size = start(s), length(s)
        cut = F.substring(raw, (at + 1).cast("int"), size.cast("int"))
        reason = F.when((at < 0) | (size < 0) | (at + size > F.octet_length("text")), "out of range").when(cut != s["line"].cast("binary"), "other text")
        return F.struct(s["line_no"].alias("line_no"), s["byte_start"].alias("byte_start"), s["byte_length"].alias("byte_length"), reason.alias("reason"))

    rows = docs.select("doc_id", F.explode(F.transform(spans_of(F.col("text")), judged)).alias("x"), *more)
    return rows.select("doc_id", "x.*", *more)


def any_prefix(text: Column, prefixes: tuple[str, ...]) -> Column:
    """Blanks at the end of a prefix don't count, so that `A ` stands for all that starts with A."""
    return reduce(lambda a, b: a | b, (text.startswith(p.rstrip(" ")) for p in prefixes))


def printed_number(line: Column) -> Column:
    return F.when(line.rlike("^ *[0-9]+ "), F.regexp_extract(line, "^ *([0-9]+) ", 1).cast("long")).otherwise(F.lit(-1))


def without_number(line: Column) -> Column:
    """The line without its printed number and the blanks around it; digits alone are no number."""
    return F.rtrim(F.when(line.rlike("^ *[0-9]+ "), F.regexp_replace(line, "^ *[0-9]+ +", "")).otherwise(line))


def structure_kind(line: Column) -> tuple[Column, Column]:
    """(kind, could it go on a rule): kind is rule-start, heading, cross-reference or null, whatever the state."""
    clean = without_number(line)
    start = clean.rlike("^R[0-9]+ (.* )?is .")
    heading = clean.rlike(r"^[0-9]+(\.[0-9]+)*[ \t]+[^ \t]") & ~clean.contains(". . .")
    cross = clean.rlike("^See  *[^ ]")
    first = F.substring(clean, 1, 1)
    goes_on = (printed_number(line) >= 0) & (clean != "") & (clean.startswith("or ") | first.isin(*GRAMMAR_MARKS) | clean.rlike("^[a-z][^ ]*$"))
    return F.when(start, "rule-start").when(heading, "heading").when(cross, "cross-reference"), goes_on & ~start


def looks_like_grammar(text: Column) -> Column:
    """A line of notation rather than prose. The order of the tests matters."""
    return (
        F.when(text == "", False).when(text.startswith("or "), True).when(F.substring(text, 1, 1).isin(*GRAMMAR_MARKS), True)
        .when(~text.rlike("[ \t]"), True).when(text.contains("...") | text.contains("]"), True)
        .when(any_prefix(text, PROSE_PREFIXES), False).otherwise(text.rlike("^[A-Za-z]"))
    )


def production_class(line: Column) -> Column:
    """heading, start, layout, boundary, or or sequence: what a line is to the productions."""
    text = F.ltrim(without_number(line))
    heading = text.rlike(r"^[0-9]+(\.[0-9]+)+[ \t]+.*[A-Za-z]") & ~text.contains(". . .")
    start = text.rlike("^R[0-9]+ *[^ ].* is  *[^ ]")
    layout = (text == "") | F.regexp_like(text, F.lit(f"^({'|'.join(LAYOUT_PREFIXES)})")) | text.rlike("^[0-9]+$")
    boundary = text.rlike("^[0-9]") | any_prefix(text, BOUNDARY_PREFIXES) | text.rlike("^C[0-9]") | ~looks_like_grammar(text)
    return F.when(heading, "heading").when(start, "start").when(layout, "layout").when(boundary, "boundary").when(text.startswith("or "), "or").otherwise("sequence")


REFERENCE = "^[a-z][a-z0-9_-]*$"


def _tokens(text_col: str) -> Column:
    return F.filter(F.split(text_col, " +"), lambda x: x != "")


def references(rows: DataFrame, text_col: str) -> DataFrame:
    """All columns of rows plus name and first_position: the references among a text's tokens, each once. They are found inside the row of the
    text, so nothing is shuffled."""
    tokens = _tokens(text_col)
    names = F.array_distinct(F.filter(tokens, lambda x: x.rlike(REFERENCE)))
    out = rows.withColumn("name", F.explode(names))
    return out.withColumn("first_position", (F.array_position(tokens, F.col("name")) - 1).cast("long"))


def notation_tokens(rows: DataFrame, text_col: str) -> DataFrame:
    """All columns of rows plus position, token and token_kind: 1 a reference, 6 a terminal, 0 rejected."""
    out = rows.select("*", F.posexplode(_tokens(text_col)).alias("position", "token"))
    kind = F.when(F.col("token").rlike(REFERENCE), 1).when(F.col("token").rlike("^[A-Z0-9_.!-/:-@\\[-`{-~]|^[^\\x00-\\x7F]"), 6).otherwise(0)
    return out.withColumn("position", F.col("position").cast("long")).withColumn("token_kind", kind)


def canonical_notation(items: DataFrame) -> DataFrame:
    """(lhs, notation) from items (lhs, alt, pos, item_kind, name): items of an alternative in order with one blank between them,
    an optional one as `[ x ]`, a repeat from 0 as `[ x ] ...`, from 1 as `x ...`, and ` or ` between alternatives."""
    kind, name = F.col("item_kind"), F.col("name")
    x = F.when(kind == "optional", F.concat(F.lit("[ "), name, F.lit(" ]"))).when(kind == "repeat0", F.concat(F.lit("[ "), name, F.lit(" ] ...")))
    x = x.when(kind == "repeat1", F.concat(name, F.lit(" ..."))).otherwise(name)
    alts = items.groupBy("lhs", "alt").agg(F.array_sort(F.collect_list(F.struct("pos", x.alias("x")))).alias("xs"))
    rules = alts.select("lhs", "alt", F.array_join("xs.x", " ").alias("x")).groupBy("lhs").agg(F.array_sort(F.collect_list(F.struct("alt", "x"))).alias("xs"))
    return rules.select("lhs", F.array_join("xs.x", " or ").alias("notation"))


def canonical_spacing(source: Column) -> Column:
    """Source notation with one blank around brackets and `...` and between all else."""
    return F.trim(F.regexp_replace(F.regexp_replace(source, r"(\[|\]|\.\.\.)", " $1 "), " +", " "))


def fnv1a32(key: Column) -> Column:
    """32-bit FNV-1a of a string's bytes."""
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(key)), lambda i: F.conv(F.hex(F.substring(key.cast("binary"), i, F.lit(1))), 16, 10).cast("long"))
    codes = F.when(F.octet_length(key) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * 16777619) % 4294967296)


def utf8_fault(data: Column) -> Column:
    """struct<fault_offset long, reason string> of the first fault in bytes; nulls if they are sound. Reasons: bad lead, truncated,
    bad continuation, overlong, surrogate, beyond range."""

    def first_fault(b: bytes | None) -> tuple[int | None, str | None]:
        if b is None:
            return None, None
        try:
            b.decode("utf-8")
            return None, None
        except UnicodeDecodeError as e:
            i, lead = e.start, b[e.start]
        if lead < 0xC0 or lead > 0xF7:
            return i, "bad lead"
        need = 1 if lead < 0xE0 else 2 if lead < 0xF0 else 3
        rest = b[i + 1 : i + 1 + need]
        if any(x & 0xC0 != 0x80 for x in rest):
            return i, "bad continuation"
        if len(rest) < need:
            return i, "truncated"
        point = int.from_bytes(bytes([lead & (0x3F >> need)]), "big")
        for x in rest:
            point = point << 6 | x & 0x3F
        return i, "surrogate" if 0xD800 <= point < 0xE000 else "beyond range" if point > 0x10FFFF else "overlong"

    @F.pandas_udf("fault_offset long, reason string")
    def faults(s: pd.Series) -> pd.DataFrame:
        found = [first_fault(b) for b in s]
        return pd.DataFrame({"fault_offset": pd.array([f[0] for f in found], "Int64"), "reason": np.array([f[1] for f in found], object)})

    return faults(F.when(~F.is_valid_utf8(data), data))


def codepoints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, cp, width): scalars of texts and their bytes; position counts from 0."""
    chars = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "")).alias("position", "ch")).where("ch <> ''")
    return chars.select("doc_id", F.col("position").cast("long"), F.ascii("ch").cast("long").alias("cp"), F.octet_length("ch").cast("long").alias("width"))


def spelled(cps: DataFrame, given: DataFrame) -> DataFrame:
    """(cp, spelling, fault) of scalars (cp, width) from a table of spellings (cp, spelling), one a scalar: the spelling if there is one, else
    the empty string. A scalar beyond ASCII without one, and a spelling that isn't ASCII, are faults."""
    rows = cps.hint("merge").join(given, "cp", "left")
    has, plain = F.coalesce(F.col("spelling") != "", F.lit(False)), F.octet_length("spelling") == F.length("spelling")
    fault = F.when(has & ~plain, "spelling beyond ASCII").when(~has & (F.col("width") > 1), "needs a spelling")
    return rows.select("cp", F.when(has & plain, F.col("spelling")).otherwise("").alias("spelling"), fault.alias("fault"))


def codepoint_ranges(rows: DataFrame, spec_col: str) -> DataFrame:
    """All columns of rows plus first_cp and last_cp, for `U+0041-U+005A,U+0061`; processor-defined and malformed
    entries give no rows."""
    part = rows.select("*", F.explode(F.split(spec_col, ",")).alias("part")).where(F.col("part").rlike("^U\\+[0-9A-Fa-f]{1,6}(-U\\+[0-9A-Fa-f]{1,6})?$"))
    ends = F.split("part", "-")
    value = [F.conv(F.substring(x, 3, 6), 16, 10).cast("long") for x in (ends[0], F.element_at(ends, -1))]
    out = part.withColumns({"first_cp": value[0], "last_cp": value[1]}).drop("part")
    return out.where("first_cp <= last_cp AND last_cp <= 1114111 AND NOT (first_cp <= 57343 AND last_cp >= 55296)")
