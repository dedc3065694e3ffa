"""A corpus pipeline: language ID, near-duplicate groups, pseudonyms, source mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; each is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import byte_bpe, language_id, mixing, ngram_join, pii
from strandline.llm.queries import pii_key
from strandline.llm.scratch import keep

#: Documents with a lower pooled probability have no language; an even guess among four has 0.25.
MIN_SCORE = 0.35


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (``und`` or a score under MIN_SCORE); ``lang`` becomes the predicted one.

    Null and empty texts, and those without letters, are ``und`` and go; rows with a null id are judged but not learned
    from; repeated rows are judged alike. An empty table, or one without labels, leaves nothing.
    """
    columns = _columns(docs)
    docs = docs.select(*columns)
    found = language_id.label(docs, language_id.fit(docs))
    known = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return known.select(*[F.col("lang_pred").alias("lang") if c == "lang" else c for c in columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row of the smallest ``doc_id`` stays.

    Rows that repeat an id, or have none, are documents of their own; those without words all stay.
    """
    return ngram_join.one_of_each(docs.select(*_columns(docs)), 5, 80)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates, addresses and keys become pseudonyms; ``n_chars`` follows the text. Every row stays; a null text stays null."""
    columns = _columns(docs)
    done = pii.pseudonymise(docs.select(*columns), pii_key(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else done


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents of which the schedule takes half the words or more; each file is in the order of their slots.

    Documents are dealt by hash, so every file is an even sample of the schedule. The mix takes a document 0, 1 or 2
    times. Rows without words are never taken; rows that repeat an id are documents of their own.
    """
    columns = _columns(docs)
    plan = mixing.mix(docs.select(*columns), carry=tuple(c for c in columns if c not in ("doc_id", "source")))
    sizes = plan.documents.select("rid", "size")
    copies = keep(mixing.scheduled(plan).join(sizes, "rid").filter("2 * taken >= size").select("rid", "first_slot"), "pipeline-slots")
    return plan.documents.join(copies.hint("shuffle_merge"), "rid").sortWithinPartitions("first_slot", "rid").select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their byte ends, and whether decoding them gives the text back; one row a row, a null text has no ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("doc"), "text")
    done = byte_bpe.encode(rows, path, verify=True, id_col="doc")
    return done.select("doc_id.doc_id", "doc_id.lang", "doc_id.source", "n_tokens", "ids", "ends", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", one_of_each_group),
    ("pii", pseudonymise),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Several stages (a trained network, Feistel pseudonyms, byte-pair merges) can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
