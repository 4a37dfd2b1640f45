"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.llm import langid, linededup, mixing, neardup, packing
from docstruct.llm.catalog import tokenizer_path
from docstruct.llm.scratch import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (null texts, or texts without a letter) go; lang becomes the network's.

    It learns from the documents' own labels; rows with a null label are told like others. Where no row has a label there
    is no language to tell: all texts with a letter stay, their lang null. Repeated rows stay; an empty table stays empty.
    """
    model = langid.train(langid.sample(docs))
    if not model.langs:
        return _documents(docs.where(F.col("text").rlike(r"\p{L}")))
    found = langid.identify(docs, model).where(F.col("lang_pred") != langid.UNDETERMINED)
    return _documents(found.withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 documents go from all of them. Rows that lose all lines stay with an empty text, as do null texts; repeated rows count each; an empty table stays empty."""
    return _documents(linededup.drop_common_lines(docs, keep=COLUMNS[:1] + COLUMNS[2:4]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 0.8 of their five-word shingles stays, that of the least doc_id.

    Null texts, and texts without words, are alike, so that one of them stays; of rows that repeat doc_id and text one
    stays, and of one doc_id's different texts all that are unlike others; rows with a null doc_id stay all; an empty
    table stays empty.
    """
    return _documents(neardup.keep_one(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share takes them, the last in part. Null texts have no words to take and go; a null source is a source; repeated rows are taken each; an empty table stays empty."""
    return _documents(mixing.repeat(mixing.mix(docs.select(*COLUMNS))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens. Null and empty texts are their end token alone; repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

#: Stages 1, 3 and 5 can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
