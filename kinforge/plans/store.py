"""Where intermediate tables go: Parquet in the folder all executors share. That cuts lineage, survives lost executors, and lets later plans read just the columns they need and choose joins by size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where none is named, as in tests, a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_kinforge_dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark._kinforge_dir = tempfile.mkdtemp(prefix="kinforge-")
    return named.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, written and read again, for several readers or as the start of a loop's next step."""
    path = f"{folder(df.sparkSession)}/kinforge-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(value: object) -> int:
    """Deletes the tables that a kept DataFrame, or a dict, list or object of such, stands for; the number deleted."""
    if isinstance(value, DataFrame):
        path = getattr(value, "_kept_at", None)
        if path is None:
            return 0
        jvm = value.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(value.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        return 1
    if isinstance(value, dict):
        return sum(map(dropped, value.values()))
    if isinstance(value, (list, tuple)):
        return sum(map(dropped, value))
    return dropped(value.made) if hasattr(value, "made") else 0
