"""Tables as deltas and commits: what a batch adds to several tables becomes visible at once, once, and without rewriting them.

A store is a folder. Each commit is one small file that names the batch and, per
table, the folder of rows that it adds. The file is made under a number that only
one writer can take, so a commit is whole or absent, whatever fails around it. A
table is read as the rows of all commits, the last row of a conflict key winning.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkTypeError, PySparkValueError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.operators.storage import CONFLICT, UPDATED


def retried(work: Callable, tries: int = 3, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random):
    """work(), again after a failure, waiting twice as long each time; wrong values and types are errors of the caller and are not tried again."""
    if tries < 1:
        raise ValueError("at least one try is needed")
    for turn in range(tries):
        try:
            return work()
        except (ValueError, TypeError, PySparkValueError, PySparkTypeError):
            raise
        except Exception:
            if turn == tries - 1:
                raise
            sleep(first_wait * 2**turn * (1 + 0.1 * jitter()))


class Store:
    """Tables below one folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    def _at(self, name: str):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """Every commit in order: {"number", "batch", "tables": {name: folder}, "replaces": {name: number}}."""
        where, fs = self._at("_commits")
        if not fs.exists(where):
            return []
        files = sorted(n for s in fs.listStatus(where) if (n := s.getPath().getName()).endswith(".json"))
        if not files:
            return []
        rows = self.spark.read.text([f"{self.path}/_commits/{n}" for n in files], wholetext=True).collect()  # one small file a batch
        return sorted((json.loads(r.value) for r in rows), key=lambda c: c["number"])

    def _publish(self, number: int, commit: dict) -> bool:
        """Writes the commit file of this number; false if another writer has it."""
        where, fs = self._at(f"_commits/{number:012d}.json")
        try:
            out = fs.create(where, False)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps(commit, sort_keys=True).encode()))
        out.close()
        return True

    def commit(self, batch: str, tables: dict[str, DataFrame], replaces: dict[str, int] | None = None) -> bool:
        """Adds the rows of all tables under one batch name; false, and nothing is changed, if that batch is already in.

        Rows are written before the commit, so a failure leaves folders that no
        commit names, and a batch that comes again after one is added once.
        """
        known = self.commits()
        if any(c["batch"] == batch for c in known):
            return False
        folders = {}
        for name, rows in tables.items():
            folders[name] = f"{name}/{uuid.uuid4().hex}"
            rows.write.mode("errorifexists").parquet(f"{self.path}/{folders[name]}")
        number = known[-1]["number"] + 1 if known else 0
        while not self._publish(number, {"number": number, "batch": batch, "tables": folders, "replaces": replaces or {}}):
            if any(c["batch"] == batch for c in self.commits()):
                return False
            number += 1
        return True

    def rows(self, name: str) -> DataFrame | None:
        """All rows added to a table since it was last compacted, with the number of their commit as __commit; None if there is none."""
        known = [c for c in self.commits() if name in c["tables"]]
        since = max((c["replaces"][name] for c in known if name in c.get("replaces", {})), default=-1)
        out = None
        for c in known:
            if c["number"] > since:
                own = self.spark.read.parquet(f"{self.path}/{c['tables'][name]}").withColumn("__commit", F.lit(c["number"]).cast("long"))
                out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def read(self, name: str, order: list[str] | None = None) -> DataFrame | None:
        """The table: per conflict key the last row, in the order of commits and then of ``order`` within one; without a key all rows.

        Columns that a conflict does not change are those of the key's first row.
        One shuffle by key; two numbered rows a key leave it.
        """
        rows = self.rows(name)
        if rows is None or name not in CONFLICT:
            return rows.drop("__commit") if rows is not None else None
        columns = [c for c in rows.columns if c != "__commit"]
        parts = CONFLICT[name]()
        rows = rows.withColumn("__key", F.struct(*(p.alias(f"k{i}") for i, p in enumerate(parts))))
        whole = None
        for i in range(len(parts)):
            here = F.col(f"__key.k{i}").isNotNull()
            whole = here if whole is None else whole & here
        at = [F.col("__commit"), *(F.col(c) for c in order or [])]
        one = Window.partitionBy("__key")
        ranked = rows.where(whole).withColumn("__last", F.row_number().over(one.orderBy(*(c.desc_nulls_last() for c in at))))
        last = ranked.where("__last = 1").select("__key", *columns)
        loose = rows.where(~whole).select(*columns)
        changed = UPDATED.get(name)
        if changed is None:
            return last.select(*columns).unionByName(loose)
        firsts = rows.where(whole).withColumn("__first", F.row_number().over(one.orderBy("__commit", *(c.desc_nulls_last() for c in at[1:])))).where("__first = 1").select("__key", F.struct(*columns).alias("f"))
        both = last.select("__key", F.struct(*columns).alias("l")).join(firsts, "__key")
        return both.select(*(F.col(f"l.{c}" if c in changed else f"f.{c}").alias(c) for c in columns)).unionByName(loose)

    def compact(self, name: str, batch: str, order: list[str] | None = None) -> bool:
        """Adds a commit whose rows are the table as it is, and which stands for all commits before it; false if there is nothing to compact."""
        known = self.commits()
        now = self.read(name, order)
        return now is not None and self.commit(batch, {name: now}, {name: known[-1]["number"]})
