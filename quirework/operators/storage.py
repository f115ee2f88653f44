"""Tables as a database keeps them: selection by equality, upserts by conflict key, atomic writes, caches by fingerprint."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.scratch import delete


def passage_key() -> Column:
    """Conflict key of passages: the digest of paper and text."""
    return F.md5(F.concat(F.col("arxiv_id"), F.lit(":"), F.col("passage")))


#: Conflict keys of the tables; a table without one is only added to.
CONFLICT: dict[str, Callable[[], list[Column]]] = {
    "papers": lambda: [F.col("arxiv_id")],
    "techniques": lambda: [passage_key()],
    "cluster_metadata": lambda: [F.col("cluster_id")],
    "clusters": lambda: [F.col("arxiv_id"), F.col("cluster_id")],
}
#: Columns that a conflict changes; all where a table is not listed.
UPDATED = {"techniques": ["embedding", "score"]}


def select(df: DataFrame, columns: list[str], where: dict | None = None) -> DataFrame:
    """Columns ('*' for all) of the rows that equal every given value; only equality with plain values is known."""
    for name, value in (where or {}).items():
        if name not in df.columns or isinstance(value, (list, tuple, dict, set)):
            raise ValueError(f"only equality with one value is possible: {name}")
        df = df.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df if columns == ["*"] else df.select(*columns)


def last_wins(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row per key: the last in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc_nulls_last() for o in order))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upserted(old: DataFrame, new: DataFrame, keys: list[Column], order: list[Column], update: list[str] | None = None) -> DataFrame:
    """``old`` after ``new`` has been put in: new keys are added, the last new row of a known key changes ``update`` or, without it, every column.

    old holds each key once; rows whose key has a null part never conflict. One
    shuffle of both sides on the key, and one more window on the new rows.
    """
    key = F.struct(*keys) if len(keys) > 1 else keys[0]
    known = F.lit(True)
    for k in keys:
        known = known & k.isNotNull()
    fresh = last_wins(new.where(known), keys, order).withColumn("__k", key)
    loose = new.where(~known)
    columns = old.columns
    held = old.withColumn("__k", F.when(known, key))
    joined = held.select("__k", F.struct(*columns).alias("o")).join(fresh.select("__k", F.struct(*columns).alias("n")), "__k", "full")
    changed = update if update is not None else columns
    out = joined.select(
        *(
            F.when(F.col("o").isNull(), F.col(f"n.{c}")).when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in changed else F.col(f"o.{c}")).alias(c)
            for c in columns
        )
    )
    return out.unionByName(loose.select(*columns))


def upsert(name: str, old: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """The table of that name after an upsert; a table without conflict key is only added to. An empty ``new`` changes nothing."""
    if name not in CONFLICT:
        return old.unionByName(new.select(*old.columns))
    return upserted(old, new.select(*old.columns), CONFLICT[name](), order, UPDATED.get(name))


def write_atomic(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Writes beside the target and renames, so that a failed write leaves the old files."""
    spark = df.sparkSession
    staged = path.rstrip("/") + ".staged"
    df.write.mode("overwrite").format(fmt).options(**options).save(staged)
    swap(spark, staged, path)


def swap(spark: SparkSession, staged: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b):
        old = path.rstrip("/") + ".old"
        delete(spark, old)
        fs.rename(b, jvm.org.apache.hadoop.fs.Path(old))
        fs.rename(a, b)
        delete(spark, old)
    else:
        fs.rename(a, b)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """One JSON object in one file, put in the old one's place by a single rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    staged, target = jvm.org.apache.hadoop.fs.Path(path + ".staged"), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(staged), fs.makeQualified(target), how)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The object; a missing manifest is an error, since nothing can be resumed without it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"no manifest at {path}: the run cannot be resumed")
    return json.loads("".join(r.value for r in spark.read.text(path).collect()))  # one line


def cache_misses(wanted: DataFrame, cached: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """Rows without a cached row of the same key and fingerprint: unknown and stale ones."""
    return wanted.withColumn("fingerprint", fingerprint).join(cached.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")


def compare_and_swap(df: DataFrame, key: dict, previous: dict, changed: dict) -> DataFrame:
    """The rows with one row changed, if it still holds the previous values; otherwise an error at run time."""
    here, same = F.lit(True), F.lit(True)
    for c, v in key.items():
        here = here & F.col(c).eqNullSafe(F.lit(v))
    for c, v in previous.items():
        same = same & F.col(c).eqNullSafe(F.lit(v))
    safe = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("the row has changed since it was read")).cast("boolean"))
    return df.select(*(F.when(here, F.when(safe, F.lit(changed[c]).cast(df.schema[c].dataType))).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in df.columns))
