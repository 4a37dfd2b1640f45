"""All queries over the driver's tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docstruct.operators import lexicon, segment, stats
from docstruct.plans import identity_queries, lexicon_queries, match_queries, registry, segment_queries, sequence_queries, stats_queries, stream_queries, theme_queries

MODULES = (stats_queries, sequence_queries, segment_queries, lexicon_queries, identity_queries, theme_queries, match_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all documents, their lexicon fields, and the fields' shares by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    segments = segment.cut_segments(docs, segment.find_markers(docs, segment_queries.RULES, "text", ["doc_id"]), "text", ["doc_id"])
    terms = spark.createDataFrame(lexicon_queries.TERMS, "term string, field string, category string, term_rank int")
    fields = lexicon.match_tokens(segments, terms, "segment", ["doc_id", "segment_no"])
    return stats.distribution(fields.join(docs.select("doc_id", "lang"), "doc_id"), "field", ["lang"])
