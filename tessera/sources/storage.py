"""Tables that an engine keeps in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share: {master} has none")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or tempfile.mkdtemp(prefix="tessera-")
        _own[app] = found
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    files, at = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


class Space:
    """Writes intermediate tables once and reads them back, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str = "engine") -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> str:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return path

    def get(self, paths: list[str], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def stored(self, df: DataFrame) -> DataFrame:
        return self.get([self.put(df)], df.schema)
