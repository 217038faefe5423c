"""Versioned tables: whole versions of a table, of which a pointer names the one that counts.

A version is written to a folder of its own and counts once its pointer file is there. Pointers are created, never
overwritten, so of two writers of one version one fails; readers see the version before until then. A
pointer tells the last batch merged: a batch that comes again changes nothing, and one may be left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Versions:
    """The table at ``path``, in folders v0, v1 ... with pointers beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        """Versions with a pointer, ascending."""
        return sorted(int(n) for n in self._names(f"{self.path}/_pointers") if n.isdigit())

    def last(self) -> tuple[int, int | None]:
        """The number of the version that counts, -1 if there is none, and the batch it ends with."""
        numbers = self.numbers()
        if not numbers:
            return -1, None
        stream = self._fs.open(self._path(f"{self.path}/_pointers/{numbers[-1]}"))
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()))["batch"]
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The version that counts; None if there is none."""
        number, _ = self.last()
        return None if number < 0 else self.spark.read.parquet(f"{self.path}/v{number}")

    def commit(self, table: DataFrame, batch: int | None = None) -> int:
        """Writes ``table`` as the next version and lets its pointer appear; what an attempt without a pointer left is overwritten."""
        number = self.last()[0] + 1
        table.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        out = self._fs.create(self._path(f"{self.path}/_pointers/{number}"), False)
        out.write(bytearray(json.dumps({"batch": batch}).encode()))
        out.close()
        return number

    def merge(self, new: DataFrame, key: list[str], order: Column, batch: int | None = None) -> int:
        """A version with the rows of ``new`` in place of those of their ``key``, unless those come later by ``order``; of several rows of a key the last counts.

        A batch that is no later than the last one merged changes nothing.
        """
        number, done = self.last()
        if batch is not None and done is not None and batch <= done:
            return number
        old = self.read()
        rows = new.withColumn("_new", F.lit(1)) if old is None else new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        last = F.row_number().over(Window.partitionBy(*key).orderBy(order.desc(), F.desc("_new")))
        return self.commit(rows.withColumn("_n", last).where("_n = 1").drop("_n", "_new"), batch)

    def insert(self, new: DataFrame, key: list[str], batch: int | None = None) -> int:
        """A version with the rows of ``new`` whose ``key`` is not there yet; a key that repeats within ``new`` stops the job."""
        number, done = self.last()
        if batch is not None and done is not None and batch <= done:
            return number
        many = F.count(F.lit(1)).over(Window.partitionBy(*key))
        told = F.concat_ws(" ", F.lit("several rows of one key:"), *(F.col(k).cast("string") for k in key))
        once = new.withColumn("_ok", F.when(many > 1, F.raise_error(told)).otherwise(F.lit(True))).where("_ok").drop("_ok")
        old = self.read()
        return self.commit(once if old is None else old.unionByName(once.join(old.select(*key), key, "left_anti")), batch)

    def clean(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions and their pointers, pointers first."""
        for number in self.numbers()[:-keep] if keep else []:
            self._fs.delete(self._path(f"{self.path}/_pointers/{number}"), False)
        standing = set(self.numbers())
        for name in self._names(self.path):
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) not in standing and int(name[1:]) < max(standing, default=0):
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
