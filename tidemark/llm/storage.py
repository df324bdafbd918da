"""Tables that one job writes and later steps reread, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables that only the steps inside a with block read; removed at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        at = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        at.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(at, True)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return _reread(df, f"{self._path}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage: what follows survives the loss of any executor without
    computing df again. The result may be read as long as the folder is there, so
    what clears spark.checkpoint.dir after a job clears these too.
    """
    return _reread(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _reread(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
