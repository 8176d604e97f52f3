"""Queries: spans, classifiers, tokens, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import text as T
from palimpsest.operators import groups as G
from palimpsest.plans.fixtures import query

SPANS = """+ spans as (select * from (select doc_id, line_no, cast(coalesce(sum(strlen(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_start,
 cast(strlen(line) as bigint) as byte_length, line, max(line_no) over (partition by doc_id) as last from lines) where not (line_no = last and line = ''))"""


@query("line_spans", SPANS + " select doc_id, line_no, byte_start, byte_length, line from spans", "lines")
def line_spans(t):
    return T.line_spans(t("documents"))


@query("span_lineage", SPANS + " select s.doc_id, s.line_no, s.byte_start, s.byte_length, true as intact, sha256(d.text) as doc_sha256 from spans s join documents d using (doc_id)", "lines")
def span_lineage(t):
    """Each line cut back out of its document by its bytes, and the document's hash."""
    rows = T.cut_spans(t("documents").withColumn("doc_sha256", F.sha2("text", 256)), lambda s: s["byte_start"], lambda s: s["byte_length"], "doc_sha256")
    return rows.select("doc_id", "line_no", "byte_start", "byte_length", F.col("reason").isNull().alias("intact"), "doc_sha256")


@query("clean_layout_controls", "select doc_id, translate(replace(text, 'a', chr(12)), chr(12) || chr(13), '  ') as clean from documents")
def clean_layout_controls(t):
    return t("documents").select("doc_id", F.translate(F.translate("text", "a", "\f"), "\f\r", "  ").alias("clean"))


NUMBER = "case when regexp_matches(line, '^ *[0-9]+ ') then cast(regexp_extract(line, '^ *([0-9]+) ', 1) as bigint) else -1 end"
CLEAN = "rtrim(case when regexp_matches(line, '^ *[0-9]+ ') then regexp_replace(line, '^ *[0-9]+ +', '') else line end, ' ')"
CLEANED = f"+ cleaned as (select page, line_no, line, {NUMBER} as number, {CLEAN} as clean from spec_lines)"


@query("strip_printed_number", CLEANED + " select page, line_no, number, number >= 0 as numbered, clean from cleaned", "spec_lines")
def strip_printed_number(t):
    number = T.printed_number(F.col("line"))
    return t("spec_lines").select("page", "line_no", number.alias("number"), (number >= 0).alias("numbered"), T.without_number(F.col("line")).alias("clean"))


KINDS = CLEANED + r"""
, kinds as (select page, line_no, line, number, clean, regexp_matches(clean, '^R[0-9]+ (.* )?is .') as st,
 number >= 0 and clean <> '' and (starts_with(clean, 'or ') or left(clean, 1) in ('[','(','.','+','-','*','/','=','_','''','"') or regexp_matches(clean, '^[a-z][^ ]*$')) as ct,
 regexp_matches(clean, '^[0-9]+(\.[0-9]+)*[ \t]+[^ \t]') and not contains(clean, '. . .') as hd, regexp_matches(clean, '^See  *[^ ]') as cr from cleaned)
, events as (select *, case when st then 1 when ct then null else 0 end as ev from kinds)
, owned as (select *, last_value(case when ev = 1 then regexp_extract(clean, '^(R[0-9]+)', 1) when ev = 0 then '' end ignore nulls) over (order by page, line_no rows between unbounded preceding and current row) as rule from events)
, classed as (select page, line_no, number, case when st then 'rule-start' when ct and coalesce(rule, '') <> '' then 'rule-continuation' when hd then 'heading' when cr then 'cross-reference' end as kind,
 case when st or ct then nullif(rule, '') end as owner from owned)"""

PRODUCTION = """+ texts as (select page, line_no, line, ltrim(%s, ' ') as x from spec_lines)
, tests as (select *, regexp_matches(x, '^[0-9]+(\\.[0-9]+)+[ \\t]+.*[A-Za-z]') and not contains(x, '. . .') as hd, regexp_matches(x, '^R[0-9]+ *[^ ].* is  *[^ ]') as st,
 x = '' or regexp_matches(x, '^(@LAYOUT@)') or regexp_matches(x, '^[0-9]+$') as ly,
 case when x = '' then false when starts_with(x, 'or ') then true when left(x, 1) in (@MARKS@) then true when not regexp_matches(x, '[ \\t]') then true
  when contains(x, '...') or contains(x, ']') then true when regexp_matches(x, '^(@PROSE@)') then false else regexp_matches(x, '^[A-Za-z]') end as gr,
 regexp_matches(x, '^([0-9]|@BOUNDARY@|C[0-9])') as bd from texts)
, classed as (select page, line_no, line, x, gr, case when hd then 'heading' when st then 'start' when ly then 'layout' when bd or not gr then 'boundary' when starts_with(x, 'or ') then 'or' else 'sequence' end as class from tests)""" % CLEAN
# The notation's fixed values, from where they are kept.
for _name, _values in {"LAYOUT": "|".join(T.LAYOUT_PREFIXES), "PROSE": "|".join(p.strip() for p in T.PROSE_PREFIXES), "BOUNDARY": "|".join(p.strip() for p in T.BOUNDARY_PREFIXES), "MARKS": ",".join("'" + c.replace("'", "''") + "'" for c in T.GRAMMAR_MARKS)}.items():
    PRODUCTION = PRODUCTION.replace(f"@{_name}@", _values)


@query("classify_production_lines", PRODUCTION + " select page, line_no, class from classed", "spec_lines")
def classify_production_lines(t):
    return t("spec_lines").select("page", "line_no", T.production_class(F.col("line")).alias("class"))


@query("prose_filter", PRODUCTION + " select page, line_no, gr as is_grammar from classed", "spec_lines")
def prose_filter(t):
    return t("spec_lines").select("page", "line_no", T.looks_like_grammar(F.ltrim(T.without_number(F.col("line")))).alias("is_grammar"))


TOKENS = r"""+ split as (select page, line_no, unnest(list_filter(regexp_split_to_array(line, ' +'), lambda x: x <> '')) as token,
 unnest(range(len(list_filter(regexp_split_to_array(line, ' +'), lambda x: x <> '')))) as position from spec_lines)
, tokens as (select page, line_no, position, token, case when regexp_matches(token, '^[a-z][a-z0-9_-]*$') then 1 when regexp_matches(token, '^([A-Z0-9_.!-/:-@\[-`{-~]|[^\x00-\x7F])') then 6 else 0 end as token_kind from split)"""


@query("tokenize_notation", TOKENS + " select * from tokens", "spec_lines")
def tokenize_notation(t):
    return T.notation_tokens(t("spec_lines"), "line").select("page", "line_no", "position", "token", "token_kind")


@query("extract_references", TOKENS + " select page, line_no, token as name, min(position) as first_position from tokens where token_kind = 1 group by all", "spec_lines")
def extract_references(t):
    return T.references(t("spec_lines"), "line").select("page", "line_no", "name", "first_position")


@query("canonical_notation", r"""+ a as (select lhs, alt, string_agg(case item_kind when 'optional' then '[ ' || name || ' ]' when 'repeat0' then '[ ' || name || ' ] ...' else name end, ' ' order by pos) as made,
 string_agg(case item_kind when 'optional' then '[' || name || case when name like '%7' then '' else ']' end when 'repeat0' then '[' || name || ']...' else name end, '  ' order by pos) as raw from rule_items group by lhs, alt)
 , g as (select lhs, string_agg(made, ' or ' order by alt) as notation, string_agg(raw, '   or ' order by alt) as raw from a group by lhs)
 select lhs, notation, notation = trim(regexp_replace(regexp_replace(raw, '(\[|\]|\.\.\.)', ' \1 ', 'g'), ' +', ' ', 'g')) as same from g""", "rule_items")
def canonical_notation(t):
    """Notation built from the structure of rules, against sources with other blanks; some sources lack a bracket."""
    source = F.when(F.col("item_kind") == "optional", F.concat(F.lit("["), "name", F.when(F.col("name").like("%7"), "").otherwise("]")))
    source = source.when(F.col("item_kind") == "repeat0", F.concat(F.lit("["), "name", F.lit("]..."))).otherwise(F.col("name"))
    alts = t("rule_items").groupBy("lhs", "alt").agg(F.array_sort(F.collect_list(F.struct("pos", source.alias("x")))).alias("xs"))
    raw = alts.select("lhs", "alt", F.array_join("xs.x", "  ").alias("x")).groupBy("lhs").agg(F.array_sort(F.collect_list(F.struct("alt", "x"))).alias("xs"))
    raw = raw.select("lhs", F.array_join("xs.x", "   or ").alias("raw"))
    rows = T.canonical_notation(t("rule_items")).hint("merge").join(raw, "lhs")
    return rows.select("lhs", "notation", (F.col("notation") == T.canonical_spacing(F.col("raw"))).alias("same"))


@query("normative_clause", "select pos, rule, case when regexp_matches(rule, '^R[0-9]{3,}$') and cast(substr(rule, 2) as bigint) >= 100 then cast(cast(substr(rule, 2) as bigint) // 100 as varchar) else clause end as owner_clause from semantic_items", "semantic_items")
def normative_clause(t):
    """Clause of a rule number of three digits or more; else the clause on record."""
    hundreds = F.regexp_extract("rule", "^R0*([1-9][0-9]*)[0-9]{2}$", 1)  # as text: a number may have any number of digits
    return t("semantic_items").select("pos", "rule", F.coalesce(F.nullif(hundreds, F.lit("")), "clause").alias("owner_clause"))


@query("affix_target", """select name, kind, case when kind in ('alias', 'list') and ends_with(name, suffix) and length(name) > length(suffix) then left(name, length(name) - length(suffix))
 when kind = 'scalar' and starts_with(name, prefix) and length(name) > length(prefix) then substr(name, length(prefix) + 1) end as target, kind in ('alias', 'list', 'scalar') as derives from classifications""", "classifications")
def affix_target(t):
    """Target by stripping a declared suffix or prefix; null if that is absent or leaves nothing."""
    e = """case when kind in ('alias', 'list') and endswith(name, suffix) and length(name) > length(suffix) then left(name, length(name) - length(suffix))
     when kind = 'scalar' and startswith(name, prefix) and length(name) > length(prefix) then substr(name, length(prefix) + 1) end"""
    return t("classifications").select("name", "kind", F.expr(e).alias("target"), F.col("kind").isin("alias", "list", "scalar").alias("derives"))


@query("corpus_policy_scan", r"""select doc_id, line_no, 'shout' as rule from lines where regexp_matches(line, '[A-Z]{3,}!!') and not regexp_matches(line, 'allow:')
 union all select doc_id, line_no, 'secret' from lines where regexp_matches(line, '(token|key|secret|password) *= *"') and not regexp_matches(line, 'allow:')""", "lines")
def corpus_policy_scan(t):
    """Lines that break a rule and aren't exempt. The patterns are constants of the plan, so each is compiled once."""
    line = F.col("line")
    rules = (("shout", "[A-Z]{3,}!!", "allow:"), ("secret", '(token|key|secret|password) *= *"', "allow:"))
    broken = F.array_compact(F.array(*(F.when(line.rlike(pattern) & ~line.rlike(exempt), rule) for rule, pattern, exempt in rules)))
    return t("lines").select("doc_id", "line_no", F.explode(broken).alias("rule"))


@query("corpus_policy_repeats")
def corpus_policy_repeats(t):
    """A rule with a back reference: a word followed by itself."""
    return t("lines").where(F.col("line").rlike(r"\b(\w{2,}) \1\b")).select("doc_id", "line_no", F.regexp_extract("line", r"\b(\w{2,}) \1\b", 1).alias("word"))


@query("doc_sha256", "select doc_id, sha256(text) as doc_sha256 from documents")
def doc_sha256(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("doc_sha256"))


@query("hash_gate", "select pos, case when not regexp_matches(source_hash, '^[0-9A-Fa-f]{64}$') then 'malformed' when source_hash = sha256(text) then 'match' else 'mismatch' end as verdict from semantic_items join documents on doc_id = pos", "semantic_items")
def hash_gate(t):
    """Expected hashes may have either case but are compared as they are."""
    rows = t("semantic_items").hint("merge").join(t("documents"), F.col("doc_id") == F.col("pos"))
    verdict = F.when(~F.col("source_hash").rlike("^[0-9A-Fa-f]{64}$"), "malformed").when(F.col("source_hash") == F.sha2("text", 256), "match").otherwise("mismatch")
    return rows.select("pos", verdict.alias("verdict"))


@query("sha256_format_check", "select pos, regexp_matches(source_hash, '^[0-9A-Fa-f]{64}$') as well_formed from semantic_items", "semantic_items")
def sha256_format_check(t):
    return t("semantic_items").select("pos", F.col("source_hash").rlike("^[0-9A-Fa-f]{64}$").alias("well_formed"))


# Runs of 16 pieces, so that small tables too have several levels.
FANOUT = 16
_LEVELS = "".join(
    f""", l{k} as (select source, ix // {FANOUT} as ix, case when {'false' if k == 1 else 'count(*) = 1 and ix // ' + str(FANOUT) + ' = 0'} then min(h) else sha256(string_agg(h, '' order by ix)) end as h from l{k - 1} group by source, ix // {FANOUT})"""
    for k in range(1, 9)
)


@query("group_digest", f"""with l0 as (select source, row_number() over (partition by source order by doc_id) - 1 as ix, sha256(text) as h from documents){_LEVELS}
 select l8.source, l8.h as digest, t.bytes, t.pieces from l8 join (select source, cast(sum(strlen(text)) as bigint) as bytes, count(*) as pieces from documents group by source) t on t.source is not distinct from l8.source""")
def group_digest(t):
    """Digest, size and number of a group's pieces in order: a tree over runs of their own hashes."""
    return G.tree_digests(t("documents"), "source", "doc_id", "text", FANOUT).withColumnRenamed("key", "source")


@query("expression_fingerprint", "select lhs, alt, sha256(string_agg(item_kind || ':' || name, ' ' order by pos)) as fingerprint from rule_items group by lhs, alt", "rule_items")
def expression_fingerprint(t):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "item_kind", "name").alias("x")))), lambda x: x["x"])
    return t("rule_items").groupBy("lhs", "alt").agg(F.sha2(F.array_join(parts, " "), 256).alias("fingerprint"))


@query("utf8_audit")
def utf8_audit(t):
    """Texts with faults planted by id: a stray byte, a lone surrogate, an overlong form, a cut-off end."""
    fault = F.expr("case doc_id % 5 when 0 then X'FF' when 1 then X'EDA080' when 2 then X'C0AF' when 3 then X'E282' else X'' end")
    raw = F.concat(F.col("text").cast("binary"), fault)
    rows = t("documents").select("doc_id", T.utf8_fault(raw).alias("f"), F.octet_length("text").cast("long").alias("sound_bytes"))
    return rows.select("doc_id", "sound_bytes", "f.fault_offset", "f.reason")


CPS = "+ cps as (select doc_id, unnest(range(length(text))) as position, unnest(string_split(text, '')) as ch from documents where text <> '') , pts as (select doc_id, position, cast(unicode(ch) as bigint) as cp, cast(strlen(ch) as bigint) as width from cps)"


@query("codepoint_decode", "with" + CPS[1:] + " select * from pts")
def codepoint_decode(t):
    return T.codepoints(t("documents"))


@query("utf8_boundaries", "with" + CPS[1:] + " select doc_id, count(*) filter (width > 1) as wide, cast(sum(width - 1) as bigint) as inner_bytes, count(*) as boundaries from pts group by doc_id")
def utf8_boundaries(t):
    """Bytes of each text at which a scalar starts, and those inside one."""
    return T.codepoints(t("documents")).groupBy("doc_id").agg(F.count(F.when(F.col("width") > 1, 1)).alias("wide"), F.sum(F.col("width") - 1).alias("inner_bytes"), F.count("*").alias("boundaries"))


@query("parse_codepoint_ranges", """select p_partkey, cast(65 + p_partkey % 20 as bigint) as first_cp, cast(70 + p_partkey % 20 + p_size as bigint) as last_cp from part
 union all select p_partkey, cast(8211 as bigint), cast(8211 as bigint) from part""")
def parse_codepoint_ranges(t):
    """Range texts made of part numbers: `U+0041-U+0046,U+2013,processor-defined`."""
    spec = F.concat(F.lit("U+"), F.hex(65 + F.col("p_partkey") % 20), F.lit("-U+"), F.hex(70 + F.col("p_partkey") % 20 + F.col("p_size")), F.lit(",U+2013,processor-defined"))
    return T.codepoint_ranges(t("part").select("p_partkey", spec.alias("spec")), "spec").drop("spec")


@query("byte_slice", "select doc_id, strlen(text) >= 8 as inside, case when strlen(text) >= 8 then hex(encode(text)[3:8]) end as bytes_hex from documents")
def byte_slice(t):
    """Bytes 2 to 7 of each text; null where the text ends before."""
    inside = F.octet_length("text") >= 8
    return t("documents").select("doc_id", inside.alias("inside"), F.when(inside, F.hex(F.substring(F.col("text").cast("binary"), 3, 6))).alias("bytes_hex"))


UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "+ words as (select doc_id, unnest(list_filter(regexp_split_to_array(line, ' +'), lambda x: x <> '')) as word from lines)"


@query("fold_key", WORDS + f" select distinct word, translate(word, '{UP}', '{LOW}') as key from words", "lines")
def fold_key(t):
    """Keys fold A to Z only; bytes beyond ASCII stay."""
    words = t("lines").select(F.explode(F.filter(F.split("line", " +"), lambda x: x != "")).alias("word")).distinct()
    return words.select("word", F.translate("word", UP, LOW).alias("key"))


@query("fnv1a32", """with recursive keys as (select distinct p_name as key from part), h as (select key, 0 as i, cast(2166136261 as hugeint) as v from keys
 union all select key, i + 1, (xor(v, cast(ascii(substr(key, i + 1, 1)) as hugeint)) * 16777619) % 4294967296 from h where i < length(key))
 select key, cast(v as bigint) as hash from h where i = length(key)""")
def fnv1a32(t):
    return t("part").select(F.col("p_name").alias("key")).distinct().select("key", T.fnv1a32(F.col("key")).alias("hash"))
