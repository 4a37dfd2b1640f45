"""Tables that cut the lineage of long jobs, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of this process in local mode, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="docstruct-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: lost executors cost a reread, not a rerun."""
    path = f"{shared_dir(df.sparkSession)}/docstruct/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables of stage() that nothing reads any more."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
