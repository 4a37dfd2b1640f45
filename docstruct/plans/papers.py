"""From the files of Japanese papers to the registry: decoding, school and year, sections and questions, one row a school and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docstruct.functions.numerals import clean_marker, numeral_table
from docstruct.operators import classify, identity, segment, sequence
from docstruct.plans import packs
from docstruct.sources import corpus
from docstruct.streaming import jobs

#: Points of a year's rules and their order where points decide nothing.
YEAR_BONUS = {"reiwa": 8, "heisei": 7, "four_digits": 6, "kanji": 6, "letter_r": 5, "letter_h": 5}
YEAR_ORDER = {"kanji": 11, "four_digits": 9, "reiwa": 8, "letter_r": 8, "heisei": 7, "letter_h": 7, "two_digits": 5}
#: What is counted of a paper.
COUNTS = ("n_files", "n_sections", "n_questions", "n_chars")


def paper_rows(files: DataFrame, aliases: DataFrame, min_gap: int = 5) -> DataFrame:
    """(school, year, n_files, n_sections, n_questions, n_chars) of decoded files (path, text): chained from E8, E1 and E3, G1, Q1 and G2, and counted by school and year.

    aliases: (alias, entity, priority, alias_rank) of schools. A file without a school or a year counts under null; files
    that could not be decoded have no text and are left out.
    """
    docs = files.where("text IS NOT NULL").select("path", clean_marker(F.col("text")).alias("text"), F.element_at(F.split("path", "/"), -1).alias("name"))
    schools = identity.detect_entity(docs, aliases, "text", "path", ["path"]).select("path", F.col("entity").alias("school"))
    mentions = classify.year_candidates(docs, "text", ["path"], "name").withColumn("excluded", F.lit(False))
    # a file's name says its year before its text does
    named = mentions.withColumn("pos", F.when(F.col("zone") == "name", F.col("pos")).otherwise(F.col("pos") + 200))
    years = identity.select_year(named, ["path"], YEAR_BONUS, YEAR_ORDER, 2020, 2000).select("path", "year")
    numerals = numeral_table(docs.sparkSession)
    marks = sequence.lookup_numbers(segment.find_markers(docs, packs.SECTION_MARKERS, "text", ["path"], 1), "marker", numerals)
    sections = segment.select_markers(marks, ["path"], min_gap).groupBy("path").agg(F.count("*").alias("n_sections"))
    asked = sequence.lookup_numbers(segment.find_markers(docs, packs.QUESTION_MARKERS, "text", ["path"], 1, True), "marker", numerals)
    questions = asked.where("number IS NOT NULL").groupBy("path").agg(F.count("*").alias("n_questions"))
    papers = docs.select("path", F.length("text").cast("long").alias("n_chars"))
    for found in (schools, years, sections, questions):
        papers = papers.join(found, "path", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return papers.groupBy("school", "year").agg(F.count("*").alias("n_files"), *map(total, COUNTS[1:]))


def ingest_papers(spark: SparkSession, folder: str, registry: str, aliases: DataFrame, checkpoint: str, glob: str = "*.txt", files_a_batch: int | None = None) -> StreamingQuery:
    """New files below `folder` go through paper_rows() into the registry, once each: a school and year's counts are added to what earlier batches left, and a repeated batch changes nothing."""
    stream = corpus.stream_text_corpus(spark, folder, glob, files_a_batch=files_a_batch)
    return jobs.stream_ingest(stream, lambda batch: paper_rows(batch, aliases), registry, ["school", "year"], "school", checkpoint, COUNTS)
