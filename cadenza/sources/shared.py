"""The folder for intermediate tables and streaming checkpoints that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where none is set, below a temporary one on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what several joins use is computed once, and lost executors don't take it along."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    """As many parts as the session shuffles into, or more: four for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over as many parts as the session shuffles into, or more. Files of a few MB are one split each, however
    many rows they hold; work that takes long for each row would run in as few tasks."""
    return df.repartition(shuffle_parts(df.sparkSession))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges. Sides that grow with the input are joined so: the sizes by which Spark decides
    to broadcast are those of compressed files and shuffles, and a driver gathers the many times larger rows."""
    return df.hint("merge")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in the file system that its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
