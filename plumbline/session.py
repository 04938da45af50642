"""Sessions: settings for runs on one machine, sending the package to executors, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A session on this machine, in UTC, with few shuffle partitions; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.parquet.compression.codec", "zstd").getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_plumbline_sent", False):
        return
    package = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline_package.zip"
    with zipfile.ZipFile(place, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(place))
    context._plumbline_sent = True


def kept(df: DataFrame, name: str) -> DataFrame:
    """df made now and read back, without its plan: from Parquet in spark.checkpoint.dir, or from executors' disks where that is unset."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
