"""Structured Streaming jobs: ingest into a registry, de-duplicate within a time to live, running distributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docstruct.functions.fold import Fold, fold_sorted
from docstruct.functions.positions import join_on
from docstruct.sources.registry_table import read_registry, remove, upsert_groups


def stream_ingest(stream: DataFrame, chain: Callable[[DataFrame], DataFrame], path: str, key: list[str], group: str, checkpoint: str, add: tuple[str, ...] = ()) -> StreamingQuery:
    """Every batch of new rows goes through `chain` and is upserted into the registry at path. A repeated batch changes nothing.

    Rows replace those of their key, except for the columns `add`, which are summed with what earlier batches left there;
    the column last_batch tells which batch a row has taken in, so that one is not added twice.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rows = chain(batch)
        if add:
            rows = rows.withColumn("last_batch", F.lit(epoch).cast("long"))
            old = read_registry(batch.sparkSession, path)
            if old is not None:
                known = old.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), *(F.col(c).alias(f"_was_{c}") for c in add), F.col("last_batch").alias("_last"))
                both = rows.join(known, [rows[k].eqNullSafe(known[f"_k{i}"]) for i, k in enumerate(key)], "left")
                done = F.coalesce(F.col("_last") >= epoch, F.lit(False))
                rows = both.select(*(F.when(done, F.col(f"_was_{c}")).otherwise(F.coalesce(f"_was_{c}", F.lit(0)) + F.col(c)).alias(c) if c in add else c for c in rows.columns))
        upsert_groups(rows, path, key, group)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_with_ttl(stream: DataFrame, content: str, ts: str, ttl: str = "3600 seconds") -> DataFrame:
    """R2: skip content that came already within the time to live, by the digest of its whole text; state is dropped behind the watermark."""
    return stream.withColumn("content_sha256", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["content_sha256"])


class KeptLately(Fold):
    """Of (at, kind, key) in order, those at least `ttl` behind the last one kept; kind 0 is what an earlier batch kept."""

    def __init__(self, ttl: int):
        self.ttl, self.last = ttl, None

    def step(self, at, kind, key):
        if kind == 0:
            self.last = at
        elif self.last is None or at - self.last >= self.ttl:
            self.last = at
            yield at, key


def ttl_ingest(stream: DataFrame, content: list[str], ts: str, key: str, ttl_seconds: int, path: str, checkpoint: str) -> StreamingQuery:
    """R2 with results that don't depend on how rows fall into batches: a row is kept unless equal content was kept less than ttl_seconds before it, by event time.

    Kept rows go to path/rows. A batch's rows and what was kept of their content before are one stream by content, which
    a fold reads in the order of time (then of the integer column `key`), carrying one time a content. State is a table of
    each content's last kept time; what is older than the newest event less the time to live is dropped with the next
    batch. Rows that come later than that are counted in path/marks (n_late) and kept out, as their past is gone; rows
    without a time are late, too. A repeated batch rewrites its own folders.
    """
    ttl = ttl_seconds * 1_000_000

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        mark = spark.read.parquet(f"{path}/marks/{epoch - 1}").first() if epoch else None
        rows = batch.withColumns({"_content": F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256), "_at": F.unix_micros(F.col(ts).cast("timestamp"))})
        on_time = F.col("_at").isNotNull() if mark is None or mark.newest is None else F.coalesce(F.col("_at") >= mark.newest - ttl, F.lit(False))
        fresh = rows.where(on_time)
        both = fresh.select("_content", "_at", F.lit(1).alias("kind"), F.col(key).cast("long").alias("key"))
        known = spark.read.parquet(f"{path}/state/{epoch - 1}") if epoch else None
        if known is not None:
            both = both.union(known.select("_content", "_at", F.lit(0), F.lit(None).cast("long")))
        kept = fold_sorted(both, ["_content"], ["_at", "kind", "key"], "at long, key long", lambda: KeptLately(ttl))
        kept.write.mode("overwrite").parquet(f"{path}/kept/{epoch}")
        kept = spark.read.parquet(f"{path}/kept/{epoch}")
        out = join_on(fresh.withColumn("_key", F.col(key).cast("long")), kept.select("_content", F.col("at").alias("_at"), F.col("key").alias("_key")), ["_content", "_at", "_key"], "left_semi")
        out.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/rows/{epoch}")
        counts = rows.agg(F.count("*").alias("n"), F.count_if(~on_time).alias("n_late"), F.greatest(F.max("_at"), F.lit(None if mark is None else mark.newest).cast("long")).alias("newest"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/{epoch}")
        newest = spark.read.parquet(f"{path}/marks/{epoch}").first().newest
        last = kept.select("_content", F.col("at").alias("_at"))
        last = last if known is None else last.union(known.select("_content", "_at"))
        last.groupBy("_content").agg(F.max("_at").alias("_at")).where(F.col("_at") > F.lit((newest or 0) - ttl)).write.mode("overwrite").parquet(f"{path}/state/{epoch}")
        for old in (f"{path}/state/{epoch - 2}", f"{path}/kept/{epoch - 1}"):
            remove(spark, old)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_distribution(stream: DataFrame, dim: str, by: list[str]) -> DataFrame:
    """Counts of each label within its group, kept up to date; to be written in update or complete mode."""
    return stream.groupBy(*by, F.col(dim).alias("label")).agg(F.count("*").alias("n"))


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    """New files of a folder, in any format that Spark streams."""
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(path)
