"""A corpus pipeline of five training-data operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, pieces, quality_net, simhash
from palimpsest.llm.common import materialize, spare, table

#: A document's quality is rejected below this probability.
MIN_QUALITY = 0.5


def apart(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns other than own under names that no operator uses, and those names."""
    names = {c: c if c in own else f"kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language, which only texts without a letter are not: a cosine tells little
    of a text of few trigrams. Prototypes are learned from all rows with a language. Null and empty texts go; repeated rows all stay or
    all go, with all their columns; an empty table stays empty."""
    rows, names = apart(docs, "doc_id", "text", "lang")
    found = langid.identify(rows, langid.prototypes(rows))
    return restored(found.where(F.col("lang_pred") != "und"), names)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, trained on the labelled ones, doesn't reject. Null and empty texts are judged as
    texts without a token; repeated rows all stay or all go; without labels of both kinds all have the labels' odds."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows, names = apart(docs, "doc_id", "text")
    vectors = quality_net.word_vectors(rows)
    judged = quality_net.score(rows, quality_net.learn(rows, labels, vectors), vectors)
    return restored(judged.where(F.col("score") >= MIN_QUALITY), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (SimHash candidates, verified to a Jaccard similarity of 0.8 or more over
    five-word shingles), that of the smallest id; documents without an id stay. Null, empty and blank texts are copies of one
    another; of repeated rows one stays."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and empty texts have size 0: they come along in whole copies and are never sampled; a null source is a
    source; rows that agree in id and text share their copies evenly; an empty table stays empty."""
    return mixing.repeat(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, in place of its text, and their number. Null and empty texts have none; repeated rows stay, and an
    empty table stays empty. Columns called ids or n_ids are kept, and the new ones get an underscore."""
    rows, names = apart(docs, "text")
    del names["text"]
    coded = pieces.encode(rows, pieces.load())
    ids, n_ids = spare(docs, "ids", "n_ids")
    return coded.select(*(F.col(n).alias(c) for c, n in names.items()), F.col("ids").alias(ids), F.size("ids").cast("long").alias(n_ids))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: SQL has no prototypes, networks or pieces. Near-dedup is tested against brute force, the mix against its odds, pieces against the library,
#: language and quality against held-out labels and plain versions of their vectors.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
