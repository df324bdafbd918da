"""The folder that all executors share, tables written there between steps, and versions of tables that grow."""

from __future__ import annotations

import json
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


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: what follows has a short plan and survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Versions:
    """Numbered versions of what a table consists of, each one small JSON file, the newest of which holds.

    A version's file is written under a name of its own and then renamed to the
    version's, which fails if there is one. So a writer that dies leaves nothing that
    counts or is in the way, and of two writers of one version the later fails, to be
    run again from the newest one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at, fs = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("versions") if n.endswith(".json") and n[0].isdigit())

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/versions/{number}.json", wholetext=True).first()[0])

    def newest(self, none: dict) -> dict:
        """What the newest version says, with its number as `version`; none as version 0 if there is none."""
        known = self.numbers()
        return self.read(known[-1]) if known else none | {"version": 0}

    def publish(self, after: dict) -> None:
        """Make a version known, the one after what was read (its `version`)."""
        (draft, fs), (final, _) = self._at(f"versions/_{uuid.uuid4().hex}.json"), self._at(f"versions/{after['version']}.json")
        out = fs.create(draft, False)
        out.write(json.dumps(after).encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), plain)
        except Exception as e:
            fs.delete(draft, False)
            raise RuntimeError(f"version {after['version']} of {self.path} is there already: run it again") from e

    def remove(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)

    def keep_newest(self, keep: int) -> list[dict]:
        """Remove the files of all but the newest versions, and of writers that died; what the kept ones say."""
        known = self.numbers()[-keep:]
        for name in set(self.names("versions")) - {f"{v}.json" for v in known}:
            self.remove(f"versions/{name}")
        return [self.read(v) for v in known]
