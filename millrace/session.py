"""Session defaults and the shared working folder of iterative jobs."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job of this package relies on or profits from.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts ride in Arrow batches: bound a batch by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults to an existing session."""
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "millrace", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a session that has it on the driver only."""
    package = Path(__file__).resolve().parent
    if any(Path(f).name == "millrace.zip" for f in spark.sparkContext.listFiles):
        return
    stem = Path(tempfile.mkdtemp(prefix="millrace-src-")) / package.name
    archive = shutil.make_archive(str(stem), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    root = configured or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


class Workspace:
    """Tables a job writes on the way, so that a lost executor replays one step only.

    A written table also cuts the lineage of loops and gives the optimizer real
    sizes, from which it decides by itself whether a join side can be broadcast.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"
        self._step = 0

    def path(self, label: str) -> str:
        self._step += 1
        return f"{self.root}/{self._step:04d}-{label}"

    def materialize(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
