"""Bindings of sources and streams to the driver's tables. Each stream takes what its table has and stops; results go to the folder in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.plans import registry
from docstruct.plans.registry import query
from docstruct.sources import corpus, registry_table
from docstruct.streaming import jobs


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a local one only in local mode without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.mkdtemp(prefix="docstruct-") if local else spark.conf.get("spark.sql.warehouse.dir")
        if local:
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/docstruct/{uuid.uuid4().hex}/{name}"


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table as a stream of files; the pattern in the name lets one file stand for a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return jobs.file_stream(spark, f"{sf_dir}/{table}.parque[t]", schema)


def _drain(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """The stream's rows after its last batch; every batch replaces (complete) or adds to (append) what is stored, and a repeated one rewrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/{epoch}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")


def _stream_query(sql: str):
    def add(function):
        registry.QUERIES[function.__name__], registry.SQL[function.__name__] = function, sql
        return function

    return add


@_stream_query("SELECT lang, source, count(*) AS n_docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY ALL")
def r1_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "registry")
    chain = lambda batch: batch.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars"))
    jobs.stream_ingest(_stream(spark, sf_dir, "documents"), chain, path, ["lang", "source"], "lang", f"{path}.state", ("n_docs", "chars")).awaitTermination()
    return spark.read.schema("source string, n_docs long, chars long, lang string").parquet(path)


@_stream_query("SELECT DISTINCT sha256(text) AS content_sha256 FROM documents WHERE text IS NOT NULL")
def r2_dedupe_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _stream(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    seen = jobs.dedupe_with_ttl(docs.withColumn("ts", F.timestamp_seconds(F.lit(86400))), "text", "ts")
    return _drain(seen.select("content_sha256"), _folder(spark, "seen"), "append")


@_stream_query("""WITH RECURSIVE p AS (SELECT DISTINCT event_type, user_id % 50 AS user_group, epoch_us(ts) AS pos FROM events), k AS (SELECT event_type, user_group, min(pos) AS pos FROM p GROUP BY ALL
UNION ALL SELECT k.event_type, k.user_group, (SELECT min(p.pos) FROM p WHERE p.event_type = k.event_type AND p.user_group = k.user_group AND p.pos >= k.pos + 3600000000) FROM k WHERE k.pos IS NOT NULL)
SELECT event_type, user_group, min(event_id) AS event_id FROM (SELECT *, user_id % 50 AS user_group FROM events) JOIN k USING (event_type, user_group) WHERE epoch_us(ts) = k.pos GROUP BY event_type, user_group, k.pos""")
def r2_dedupe_with_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "fresh")
    events = _stream(spark, sf_dir, "events").withColumn("user_group", F.col("user_id") % 50)
    jobs.ttl_ingest(events, ["event_type", "user_group"], "ts", "event_id", 3600, path, f"{path}.state").awaitTermination()
    kept = spark.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    return kept.select("event_type", "user_group", "event_id")


@_stream_query("SELECT user_id, event_type AS label, count(*) AS n FROM events GROUP BY ALL")
def r3_running_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(jobs.running_distribution(_stream(spark, sf_dir, "events"), "event_type", ["user_id"]), _folder(spark, "running"), "complete")


@query("""WITH b AS (SELECT p_brand AS field, p_type AS term, p_partkey AS r, 0 AS o FROM part WHERE p_size > 25 UNION ALL SELECT p_brand, p_name, p_partkey, 1 FROM part UNION ALL SELECT p_brand, p_type, p_partkey, 1 FROM part),
f AS (SELECT field, term, min(o * 1000000000000 + r) AS k FROM b GROUP BY ALL)
SELECT field, term, row_number() OVER (PARTITION BY field ORDER BY k, term) - 1 AS term_rank FROM f""")
def s5_merge_lexicons(t):
    part = t("part")
    own = lambda c: part.select(F.col("p_brand").alias("field"), F.col(c).alias("term"), F.col("p_partkey").alias("term_rank"), "p_size")
    return corpus.merge_lexicons(own("p_type").where("p_size > 25"), own("p_name").union(own("p_type")))


@query("""WITH k AS (SELECT l_orderkey, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS kinds FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey),
i AS (SELECT l_orderkey, count(*) AS n_items, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS listed FROM lineitem GROUP BY l_orderkey)
SELECT * FROM i JOIN k USING (l_orderkey)""")
def s8_export_nested(t):
    nested = corpus.export_nested(t("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], "l_returnflag", ["l_partkey", "l_quantity"])
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("type_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    listed = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return nested.select("l_orderkey", "n_items", listed.alias("listed"), kinds.alias("kinds"))


@query("""WITH q AS (SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
t AS (SELECT o_custkey, o_orderkey, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS kinds FROM (SELECT o_custkey, o_orderkey, l_returnflag, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL),
l AS (SELECT o_custkey, o_orderkey, count(*) AS n, string_agg(l_linenumber || ':' || l_partkey, '+' ORDER BY l_linenumber, l_returnflag, l_partkey) AS items FROM q GROUP BY ALL),
s AS (SELECT o_custkey, count(*) AS n_sections, sum(coalesce(n, 0))::BIGINT AS n_questions, string_agg(o_orderkey || '(' || coalesce(n, 0) || ';' || coalesce(kinds, '') || ';' || coalesce(items, '') || ')', ' ' ORDER BY o_orderkey) AS sections
FROM orders LEFT JOIN l USING (o_custkey, o_orderkey) LEFT JOIN t USING (o_custkey, o_orderkey) GROUP BY o_custkey),
k AS (SELECT o_custkey, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS kinds FROM (SELECT o_custkey, l_returnflag, count(*) AS n FROM q GROUP BY ALL) GROUP BY ALL)
SELECT c_custkey, c_name, coalesce(n_sections, 0) AS n_sections, coalesce(n_questions, 0) AS n_questions, coalesce(kinds, '') AS kinds, coalesce(sections, '') AS sections FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN k ON k.o_custkey = c_custkey""")
def s8_export_documents(t):
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    dealt = lambda rows: rows.repartition(corpus.PARTS, "o_orderkey")
    items = dealt(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag")).join(dealt(orders), "o_orderkey")
    nested = corpus.export_documents(t("customer").select("c_custkey", "c_name"), orders, items, "c_custkey", "o_orderkey", "l_linenumber", "l_returnflag", ["l_partkey"])
    kinds = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    asked = lambda s: F.array_join(F.transform(s["questions"], lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), "+")
    listed = F.array_join(F.transform("sections", lambda s: F.concat(s["o_orderkey"].cast("string"), F.lit("("), s["n_questions"].cast("string"), F.lit(";"), kinds(s["type_counts"]), F.lit(";"), asked(s), F.lit(")"))), " ")
    return nested.select("c_custkey", "c_name", "n_sections", "n_questions", kinds("type_counts").alias("kinds"), listed.alias("sections"))


#: Queries over files that Spark derives from the tables: they write them to the shared folder and read them with a source.
_source_query = _stream_query


@_source_query("""SELECT lang, (doc_id // 100)::BIGINT AS part, sum(1 + length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_lines, sum(length(text) + 1)::BIGINT AS n_chars, 'utf-8' AS encoding FROM documents GROUP BY ALL""")
def s1_read_text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "texts")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"), "lang", F.expr("doc_id div 100").alias("part"))
    docs.repartition("lang", "part").write.partitionBy("lang", "part").text(path)  # a file for some hundred documents of a language
    found = corpus.read_text_corpus(spark, path)
    named = lambda key: F.regexp_extract("path", f"/{key}=([^/]+)/", 1)
    return found.select(named("lang").alias("lang"), named("part").cast("long").alias("part"), F.regexp_count("text", F.lit("\n")).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"), "encoding")


@_source_query("SELECT p_brand AS field, p_name AS term, (row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1)::INTEGER AS term_rank FROM (SELECT DISTINCT p_brand, p_name FROM part)")
def s6_read_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "lexicon")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    listed = part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("_terms"))
    listed.select(F.to_json(F.create_map("p_brand", "_terms")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # a file is one JSON object
    return corpus.read_lexicon(spark, path)


@_source_query("""SELECT o_orderpriority AS grp, year(o_orderdate)::INTEGER AS year, CASE WHEN o_orderpriority < '3' AND year(o_orderdate) >= 1995 THEN count(*) ELSE -1 END AS n, CASE WHEN o_orderpriority < '3' AND year(o_orderdate) >= 1995 THEN max(o_custkey) END AS last FROM orders GROUP BY o_orderpriority, year(o_orderdate)""")
def s7_write_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "registry")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("grp"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.max("o_custkey").alias("last"))
    registry_table.write_registry(rows.select("grp", "year", F.lit(-1).cast("long").alias("n")), path, "grp")
    for _ in range(2):  # the second time changes nothing
        registry_table.upsert_groups(rows.where("grp < '3' AND year >= 1995"), path, ["grp", "year"], "grp")
    return registry_table.read_registry(spark, path).select("grp", "year", "n", "last")
