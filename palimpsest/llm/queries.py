"""The registered queries of the training-data operators, as their contracts word them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import fingerprint, html_cut, langid, mixing, ngram_join, pieces, quality_net, quality_rules, simhash, token_align, toxicity, vector_codes, warc_audit
from palimpsest.llm.common import held_out, table


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op3_html_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which records are damaged (page_id % 50 = 7: a first character is
    put before the html), lost (page_id % 50 = 9) or added (page_id % 50 = 13: the first replica lacks them)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    hurt = F.when(F.col("page_id") % 50 == 7, F.concat(F.lit("#"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))

    def without(remainder: int) -> DataFrame:
        return pages.where(F.coalesce(F.col("page_id") % 50 != remainder, F.lit(True)))

    return warc_audit.audit(without(13), without(9).withColumn("html", hurt))


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    refs = quality_rules.References(quality_rules.reference_counts(docs))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    return quality_rules.measure(docs, refs).select(*names)


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.learn_from(docs, labels)
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, the SHA-256 of what they decode to, and whether that is the text."""
    rows = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.load(), check=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "decoded_sha256", "exact")


def op8_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", F.col("quality").alias("label"))
    vectors = quality_net.word_vectors(docs)
    return quality_net.score(docs, quality_net.learn(docs, labels, vectors), vectors).select("doc_id", "held_out", "score", "predicted")


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    found = langid.identify(rows.select("doc_id", "text", "held_out"), langid.prototypes(rows.where(~F.col("held_out"))))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignments(table(spark, sf_dir, "documents"), token_align.load())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quartile_digest, op2_simhash_pivots, op3_html_minimum_cut, op4_warc_merkle_audit, op5_distribution_divergence, op6_subword_toxicity,
        op7_sentencepiece_lattice, op8_random_indexing_quality, op9_pareto_mix, op10_hyperdimensional_language,
        op11_ngram_join, op12_vector_codes, op13_token_alignment,
    )
}
_CRLF = "chr(13) || chr(10)"
_RECORD = f"""'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {_CRLF} || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF}
 || 'Content-Type: text/html' || {_CRLF} || 'Content-Length: ' || strlen(html) || {_CRLF} || {_CRLF} || html || {_CRLF} || {_CRLF}"""
_PLACED = """select page_id, page_id // 1000 as warc_file, cast(coalesce(sum(strlen(rec)) over (partition by page_id // 1000 order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as record_offset,
 cast(strlen(rec) as bigint) as record_length, sha256(rec) as record_sha256"""


def _codes_sql(rounds: int = 4) -> str:
    """Integer k-means of op12, a round being the assignment and then the means."""

    def nearest(book: str) -> str:
        return f"""select vec_id, part, min(d) as d, arg_min(entry, (d, entry)) as entry from (
 select x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) as d from x join {book} c on c.part = x.part and c.pos = x.pos group by x.vec_id, x.part, c.entry) group by vec_id, part"""

    steps = [
        """kept as (select vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)""",
        """x as (select vec_id, (i - 1) // (n // 4) as part, (i - 1) % (n // 4) as pos, cast(floor(1024 * cast(embedding[i] as double)) as bigint) as v
 from (select vec_id, embedding, len(embedding) as n, unnest(range(1, len(embedding) + 1)) as i from kept))""",
        """c0 as (select part, entry, pos, v from x join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < 256) using (vec_id))""",
    ]
    for t in range(rounds):
        steps.append(f"a{t} as materialized ({nearest(f'c{t}')})")
        steps.append(f"m{t} as (select a.part, a.entry, x.pos, cast(floor(cast(sum(x.v) as double) / count(*)) as bigint) as v from a{t} a join x on x.vec_id = a.vec_id and x.part = a.part group by a.part, a.entry, x.pos)")
        steps.append(f"c{t + 1} as materialized (select c.part, c.entry, c.pos, coalesce(m.v, c.v) as v from c{t} c left join m{t} m on m.part = c.part and m.entry = c.entry and m.pos = c.pos)")
    steps.append(f"last as ({nearest(f'c{rounds}')})")
    steps.append("""rows as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from last group by vec_id)""")
    return f"""with {", ".join(steps)} select r.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
 (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, pos)) from c{rounds}) as codebooks_sha256 from rows r join kept k on k.vec_id = r.vec_id"""


#: The others have no SQL: they are tested against brute force, exact round trips or held-out labels.
SQL: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op4_warc_merkle_audit": f"""with a as (select page_id, url, coalesce(html, '') as html from pages where page_id % 50 <> 13),
 b as (select page_id, url, case when page_id % 50 = 7 then '#' else '' end || coalesce(html, '') as html from pages where page_id % 50 <> 9),
 ra as (select page_id, {_RECORD} as rec from a), rb as (select page_id, {_RECORD} as rec from b)
 {_PLACED}, case page_id % 50 when 7 then 'corrupt' when 9 then 'missing' else 'intact' end as status from ra
 union all select * from ({_PLACED}, 'extra' as status from rb) where page_id % 50 = 13""",
}
