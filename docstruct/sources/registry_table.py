"""The registry: Parquet partitioned by group; only the groups of new rows are rewritten."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.operators.stats import upsert


def read_registry(spark: SparkSession, path: str) -> DataFrame | None:
    """The registry, with the columns of all its parts; None if nothing is written yet."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_registry(rows: DataFrame, path: str, group: str) -> None:
    """Replace the groups that rows have and leave the others. rows must not read from path."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def upsert_groups(new: DataFrame, path: str, key: list[str], group: str) -> None:
    """A10 on the stored registry: the touched groups (null is one) are written beside it first, as a plan must not overwrite what it reads; that folder goes once the registry has them."""
    spark = new.sparkSession
    old = read_registry(spark, path)
    if old is None:
        write_registry(new, path, group)
        return
    groups = new.select(F.col(group).cast(old.schema[group].dataType).alias("_group")).distinct()
    touched = old.join(groups, old[group].eqNullSafe(groups["_group"]), "left_semi")
    merged = upsert(touched, new.select(*(F.col(c).cast(old.schema[c].dataType).alias(c) if c in old.columns else F.col(c) for c in new.columns)), key)
    beside = f"{path.rstrip('/')}.next/{uuid.uuid4().hex}"
    merged.write.mode("overwrite").parquet(beside)
    write_registry(spark.read.parquet(beside), path, group)
    remove(spark, beside)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
