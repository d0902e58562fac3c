"""A keyed table of scores that grows from run to run, with the provenance of every entry.

Each run appends a folder of entries under its version; nothing is rewritten, so a run that is lost
half-way leaves none. Of several entries of one key the latest version counts. An entry
tells what made it (model and parameters), and a reader that expects something else fails
instead of taking it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.storage import materialize


class WrongProvenance(ValueError):
    """Scores were made by something else than what is expected."""


def provenance(model: str, **parameters) -> str:
    return json.dumps({"model": model, "parameters": parameters}, sort_keys=True, separators=(",", ":"))


class ScoreCache:
    """path: a folder that all executors share; schema: key and value columns, as DDL."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"{schema}, _provenance string"
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs, self._root = root.getFileSystem(spark._jsc.hadoopConfiguration()), root

    def versions(self) -> list[int]:
        """Those that were written to their end."""
        if not self._fs.exists(self._root):
            return []
        done = [s.getPath() for s in self._fs.listStatus(self._root) if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def entries(self) -> DataFrame:
        """The latest entry of each key, with _version and _provenance."""
        found = self.versions()
        if not found:
            return self.spark.createDataFrame([], f"{self.schema}, _version int")
        every = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/version={v}" for v in found])
        every = every.withColumn("_version", F.regexp_extract(F.col("_metadata.file_path"), r"/version=(\d+)/", 1).cast("int"))
        values = [c for c in every.columns if c != self.key]
        # partial maxima, no window; of repeated keys in one version the least entry
        latest = every.groupBy(self.key).agg(F.max_by(F.struct(*values), F.struct("_version", -F.xxhash64(*values))).alias("_e"))
        return latest.select(self.key, "_e.*")

    def append(self, rows: DataFrame, made_by: str) -> int:
        """Writes rows as the next version, which supersedes earlier entries of their keys."""
        version = max(self.versions(), default=0) + 1
        columns = [c.split()[0] for c in self.schema.split(", ")][:-1]
        rows.select(*columns, F.lit(made_by).alias("_provenance")).write.parquet(f"{self.path}/version={version}")
        return version

    def scored(self, jobs: DataFrame, made_by: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """jobs with their scores and _version; keys that the cache has are not computed again.

        compute gets the rows of the missing keys, one for each, and returns key and value columns.
        Fails if an entry of one of the jobs was made by something else.
        """
        self.check(jobs, made_by)
        known = self.entries().drop("_provenance")
        missing = materialize(jobs.join(known.select(self.key), self.key, "left_anti").dropDuplicates([self.key]), "cache-misses")
        if not missing.isEmpty():
            self.append(compute(missing), made_by)
        return jobs.join(self.entries().drop("_provenance"), self.key, "left")

    def check(self, jobs: DataFrame, made_by: str) -> None:
        wrong = jobs.select(self.key).distinct().join(self.entries(), self.key).where(F.col("_provenance") != made_by)
        first = wrong.select(self.key, "_provenance").orderBy(self.key).limit(1).collect()
        if first:
            raise WrongProvenance(f"the entry of {first[0][0]} was made by {first[0][1]}, not by {made_by}")

    def reused(self, records: DataFrame, made_by: str) -> DataFrame:
        """records with their scores, nothing computed; fails if a record has none, an entry has no record, or one was made otherwise."""
        self.check(records, made_by)
        held = self.entries().drop("_provenance", "_version").withColumnRenamed(self.key, "_k")
        both = materialize(records.join(held, F.col(self.key) == F.col("_k"), "full_outer"), "reused")
        lost = both.agg(F.count_if(F.col("_k").isNull()).alias("a"), F.count_if(F.col(self.key).isNull()).alias("b")).first()
        if lost.a or lost.b:
            raise ValueError(f"{lost.a} records without a score, {lost.b} scores without a record")
        return both.drop("_k")
