"""Sessions, and the package's way to the Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(name: str = "canopyspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with what the engine relies on: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once an application; a cluster needs no install."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="canopy-")) / "canopyspark_src.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        context.addPyFile(str(archive))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine where the master is local."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all hosts share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="canopy-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/canopy-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in a stated number of parts, by some columns or in turn: where few bytes make much work, a small file would be
    one task, and a shuffle left to Spark would be merged to few."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) + 1
    return df.repartition(parts, *by)
