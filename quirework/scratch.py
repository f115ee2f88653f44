"""Tables written in the cluster's shared folder, to cut lineage so that a lost executor costs one read, not a recomputation."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one of this machine only where that is unset (tests, local mode)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quirework-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Writes intermediate results as Parquet below one fresh folder.

    ``drop`` removes a table that no later plan reads; the rest goes when the
    Python process ends, since a returned DataFrame may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quirework/{name}-{uuid.uuid4().hex}"
        _written.append((spark, self.root))
        self._count = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._quirework_path = path
        return read

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_quirework_path", None)
            if path:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, root in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, root)
        except Exception:  # the JVM may be gone; the folder is the cluster's scratch space
            return
