"""Several tables published as one: all of a version or none.

Every table of a version is written to a folder of its own.  One row per table is then appended to the manifest, in a
single file, which is what makes the version visible: a job that ends before leaves the version before it in force.
Readers follow the manifest; folders that it no longer names are deleted after it is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import write_table

_MANIFEST = "sequence long, version string, name string, rows long, published_at timestamp"


class TableSet:
    """The versions of one set of tables below a shared folder."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def manifest(self) -> DataFrame:
        """One row per table of every published version."""
        path = f"{self.root}/manifest"
        if not self._exists(path):
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(path)

    def _current(self) -> dict:
        versions = self.manifest().groupBy("sequence", "version").agg(F.count(F.lit(1)).alias("n"))
        row = versions.orderBy(F.desc("sequence"), F.desc("version")).limit(1).collect()
        return row[0].asDict() if row else {"sequence": 0, "version": None}

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Writes all tables, then makes them the current version; returns its name."""
        version = uuid.uuid4().hex
        counts = {name: write_table(df, f"{self.root}/data/{version}/{name}", name, "parquet") for name, df in tables.items()}
        sequence = self._current()["sequence"] + 1
        rows = self.spark.createDataFrame(
            [(sequence, version, name, n) for name, n in counts.items()], "sequence long, version string, name string, rows long"
        )
        rows.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        self._drop_superseded()
        return version

    def _drop_superseded(self) -> None:
        versions = self.manifest().select("sequence", "version").distinct().orderBy(F.desc("sequence"), F.desc("version"))
        for row in versions.collect()[self.keep :]:
            self._delete(f"{self.root}/data/{row['version']}")

    def read(self) -> dict[str, DataFrame]:
        """The tables of the current version, by name."""
        version = self._current()["version"]
        names = [r["name"] for r in self.manifest().filter(F.col("version") == version).select("name").collect()]
        return {name: self.spark.read.parquet(f"{self.root}/data/{version}/{name}") for name in names}
