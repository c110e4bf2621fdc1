"""Driver tables, and tables cut off from their lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode, where any folder is shared, under one of our own if that is unset."""
    found, app, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId, spark.sparkContext.master
    if not found:
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="rankloom-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = f"file://{_own[app]}"
    return f"{found.rstrip('/')}/rankloom-{app}/{uuid.uuid4().hex[:12]}-{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` computed once, as a Parquet table in the shared folder."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table made by checkpointed(), once nothing will read it again."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
