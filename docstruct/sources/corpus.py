"""Reading text corpora and lexicons, and nested export."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Columns of Spark's binary files, which a stream of them must name.
FILES = "path string, modificationTime timestamp, length long, content binary"
#: Tasks to which a nested export deals its rows. It is a fixed number, as adaptive execution joins partitions by their compressed bytes, some tenth of what their rows take in memory.
PARTS = 256


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*.txt", encodings: tuple[str, ...] = ("utf-8", "shift_jis", "euc_jp")) -> DataFrame:
    """(path, text, encoding, error) of every file below path; the first encoding that fits wins, a file that none fits is a row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return decode_files(files, encodings)


def stream_text_corpus(spark: SparkSession, path: str, glob: str = "*.txt", encodings: tuple[str, ...] = ("utf-8", "shift_jis", "euc_jp"), files_a_batch: int | None = None) -> DataFrame:
    """S1 as a stream: the same rows of files that come to stand below path."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return decode_files((reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(path), encodings)


def decode_files(files: DataFrame, encodings: tuple[str, ...]) -> DataFrame:
    """(path, text, encoding, error) of binary files (path, content)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for encoding in encodings:
                    try:
                        rows.append((name, data.decode(encoding), encoding, None))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    rows.append((name, None, None, "no encoding fits"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 4, names=["path", "text", "encoding", "error"])

    return files.select("path", "content").mapInArrow(decode, "path string, text string, encoding string, error string")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(field, term, term_rank) of a JSON object of lists."""
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("field", "terms"))
    return parsed.select("field", F.posexplode("terms").alias("term_rank", "term"))


def merge_lexicons(base: DataFrame, add: DataFrame) -> DataFrame:
    """The terms of each field, base before add, first occurrence wins, ranked anew."""
    both = base.select("field", "term", F.struct(F.lit(0), "term_rank").alias("_o")).union(add.select("field", "term", F.struct(F.lit(1), "term_rank").alias("_o")))
    first = both.groupBy("field", "term").agg(F.min("_o").alias("_o"))
    return first.withColumn("term_rank", F.row_number().over(Window.partitionBy("field").orderBy("_o", "term")) - 1).drop("_o")


def export_nested(items: DataFrame, key: str, order: list[str], kind: str, columns: list[str]) -> DataFrame:
    """One row for each key: n_items, a map of kinds to counts, and the items in order as an array of structs; to be written as JSON."""
    kinds = items.groupBy(key, kind).agg(F.count("*").alias("_n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_n")))).alias("type_counts"))
    own = items.groupBy(key).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *columns])))).alias("items"))
    return own.join(kinds, key)


def tally(values: Column) -> Column:
    """A map of an array's values to how often they occur, in the values' order; the array is sorted and its runs are measured, so that many values cost no more than few."""
    let = lambda bound, body: F.transform(F.array(bound), body)[0]
    runs = lambda v, starts: F.transform(starts, lambda p, i: F.struct(F.get(v, p), (F.coalesce(F.get(starts, i + 1), F.size(v)) - p).cast("long")))
    begins = lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda p: (p == 0) | ~F.get(v, p).eqNullSafe(F.get(v, p - 1)))
    return F.when(F.size(values) > 0, F.map_from_entries(let(F.array_sort(values), lambda v: let(begins(v), lambda s: runs(v, s)))))


def export_documents(docs: DataFrame, sections: DataFrame, questions: DataFrame, key: str, section: str, order: str, kind: str, columns: list[str], parts: int = PARTS) -> DataFrame:
    """One nested row a document: its columns, n_sections, n_questions, type_counts (a map) and its sections in order, each with n_questions, type_counts and its questions in order.

    docs (key, ...), sections (key, section, ...), questions (key, section, order, kind, columns). Sections without
    questions and documents without sections stay, with empty lists and maps; questions of unknown sections count for
    nothing. Sections and questions are dealt once, by document, to the given number of parts, and are grouped there by
    section and then by document, so that a task holds its part of the rows however few bytes the shuffle takes.
    """
    other = [c for c in sections.columns if c not in (key, section)]
    asked = questions.where(F.col(key).isNotNull() & F.col(section).isNotNull()).select(key, section, F.struct(*dict.fromkeys([order, kind, *columns])).alias("_q"))
    known = sections.where(F.col(key).isNotNull()).select(key, section, F.struct(section, *other).alias("_s"))
    dealt = known.unionByName(asked, allowMissingColumns=True).repartition(parts, key)
    below = dealt.groupBy(key, section).agg(F.collect_list("_s").alias("_s"), F.array_sort(F.collect_list("_q")).alias("questions")).where(F.size("_s") > 0)
    below = below.withColumn("_kinds", F.transform("questions", lambda q: q[kind]))
    empty = lambda df, c: F.coalesce(F.col(c), F.expr(f"CAST({'map()' if c == 'type_counts' else 'array()'} AS {df.schema[c].dataType.simpleString()})"))
    below = below.withColumn("type_counts", tally(F.col("_kinds")))
    nested = lambda s: F.struct(*(s[c].alias(c) for c in [section, *other]), F.size("questions").cast("long").alias("n_questions"), empty(below, "type_counts").alias("type_counts"), F.col("questions").alias("questions"))
    below = below.select(key, (F.size("_s") * F.size("questions")).alias("_n"), "_kinds", F.transform("_s", nested).alias("_nested"))
    gathered = below.groupBy(key).agg(F.sum("_n").alias("n_questions"), F.flatten(F.collect_list("_kinds")).alias("_kinds"), F.flatten(F.collect_list("_nested")).alias("sections"))
    # maps have no order, so the struct is sorted by its section, which is unique in a document
    in_order = F.array_sort("sections", lambda a, b: F.when(a[section] < b[section], -1).when(a[section] > b[section], 1).otherwise(0))
    gathered = gathered.select(key, F.size("sections").alias("n_sections"), "n_questions", tally(F.col("_kinds")).alias("type_counts"), in_order.alias("sections"))
    out = docs.repartition(parts, key).join(gathered, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*docs.columns, zero("n_sections"), zero("n_questions"), empty(out, "type_counts").alias("type_counts"), empty(out, "sections").alias("sections"))


def read_period_index(spark: SparkSession, path: str) -> DataFrame:
    """(field, tier, term, term_rank) of a JSON object of periods, each with lists of strong and representative words."""
    kinds = "map<string, struct<strong: array<string>, representative: array<string>>>"
    parsed = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", kinds))).alias("_p", "_e"))
    tiers = F.array(*(F.struct(F.lit(t).alias("tier"), F.col("_e.value")[t].alias("terms")) for t in ("strong", "representative")))
    spread = parsed.select(F.col("_e.key").alias("field"), F.explode(tiers).alias("_t"))
    return spread.select("field", "_t.tier", F.posexplode("_t.terms").alias("term_rank", "term"))


def read_markdown_lexicon(spark: SparkSession, path: str, separators: str = "[,、，]") -> DataFrame:
    """(field, category, term, term_rank) of Markdown: '##' names the field, '###' the category (null before the first of a field), list lines hold terms. The first place of a term in its field and category counts."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.posexplode(F.split("value", "\r?\n")).alias("_pos", "_line"))
    heading = lambda marks: F.regexp_extract("_line", rf"^{marks}\s+(.*?)\s*$", 1)
    before = Window.partitionBy("_file").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    field = F.last(F.nullif(heading("##"), F.lit("")), ignorenulls=True).over(before)
    mark = F.when(F.col("_line").rlike(r"^##\s"), F.lit("")).when(F.col("_line").rlike(r"^###\s"), heading("###"))
    category = F.nullif(F.last(mark, ignorenulls=True).over(before), F.lit(""))
    listed = lines.withColumns({"field": field, "category": category}).where(F.col("_line").rlike(r"^\s*[-*]\s+") & F.col("field").isNotNull())
    body = F.regexp_replace("_line", r"^\s*[-*]\s+", "")
    terms = listed.select("field", "category", "_file", "_pos", F.posexplode(F.split(body, separators)).alias("_i", "_term")).withColumn("term", F.trim("_term")).where("term <> ''")
    first = terms.groupBy("field", "category", "term").agg(F.min(F.struct("_file", "_pos", "_i")).alias("_o"))
    return first.withColumn("term_rank", F.row_number().over(Window.partitionBy("field", "category").orderBy("_o", "term")) - 1).drop("_o")
