"""Shared plumbing of the training-data operators: work tables, table readers and
word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import shared_folder
from ..shipping import ship

#: a word is a maximal run without ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the master is local (tests)."""
    return shared_folder(spark) + "/gavelworks"


class Work:
    """Intermediate tables in the shared folder.  They cut lineage like a
    checkpoint but are computed once; ``drop`` frees those no longer needed,
    the rest goes with the application (results are read from them until then)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        ship(spark)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{tag}"
        df.write.mode("overwrite").parquet(path)
        if self.n == 1:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = getattr(df, "_work_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str = "text"):
    return F.coalesce(F.col(c), F.lit(""))


def plus(schema: StructType, ddl: str, drop: tuple = ()) -> StructType:
    """A new schema: the fields without ``drop``, then those of ddl."""
    return StructType([f for f in schema.fields if f.name not in drop] + StructType.fromDDL(ddl).fields)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
