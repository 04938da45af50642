"""Shared-folder tables that cut lineage, and small column helpers used by several operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import session

#: [\x20\x09-\x0D] as characters; the contracts name this set.
BLANKS = " \t\n\x0b\f\r"
LINE_BLANKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset on one machine, a temporary folder of this context's own.

    Unset on a cluster raises: executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not getattr(context, "_plumbline_folder", None):
            context._plumbline_folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        folder = context._plumbline_folder
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, *partitions: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read back, with its path. Any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
    return spark.read.schema(schema).parquet(path), path


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session with a setting, for plans that run while this lasts."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sorted_scans(spark: SparkSession):
    """While this lasts, scans of bucketed tables with one file a bucket tell the planner that buckets are sorted."""
    return setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")


class SortedRun:
    """A table in the shared folder, bucketed and sorted by one column, one file a bucket.

    Runs of equally many buckets meet in merge joins without another exchange or sort. The rows given must lie in
    tasks by the hash of the column already, or be dealt (dealt=True). Results that outlive it must be stored elsewhere.
    """

    def __init__(self, rows: DataFrame, key: str, buckets: int, name: str, dealt: bool = False):
        self.spark, self.key, self.buckets = rows.sparkSession, key, buckets
        self.table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.table}"
        rows = rows.repartition(buckets, key) if dealt else rows
        rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("compression", "zstd").option("path", self.path).saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        forget(self.spark, self.path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Let go of the shuffles of steps that are stored.

    Spark deletes a shuffle once the driver's heap has been collected, however long that takes; till then the files of
    all steps so far stand beside each other.
    """
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Text of one byte a character takes the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32(doc_id as text) mod folds is 0; a null id is held out too, so it never trains a model."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like those given that no column has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def keyed_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, no_id, text) for Python: a null id is 0 and marked, so that pandas keeps all ids whole numbers."""
    doc_id = F.col(key).cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), doc_id.isNull().alias("no_id"), F.col(text).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bounds on the Arrow batches that go to Python workers: texts are long, and memory beside the executor's heap is small.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
_HELD: dict[str, Callable[[], None]] = {}


def claim(owner: str, drop: Callable[[], None]) -> None:
    """In a Python worker: owner will keep caches that drop() empties; those of other owners are emptied now.

    Workers outlive stages, so the caches of one operator would stand beside those of the next.
    """
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    _HELD[owner] = drop
    if others:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context; they need not have it installed. Bounds Arrow batches."""
    session.ship(spark)
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        number = int(now.rstrip("b"))
        if number <= 0 or number > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def hashed_sample(rows: DataFrame, group: str, id_column: str, most: int) -> list[Row]:
    """Distinct (group, id) of `rows` drawn by hashed id, `most` or somewhat more of each group, lowest hash first.

    Group sizes come first, so that each group's share is a threshold on the hash and no group meets in one task. At
    most 4 * most rows a group come to the driver; groups are labels, and one number of each comes too.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(group).count().collect()
    if not sizes:
        return []
    drawn = F.pmod(F.xxhash64(id_column, F.lit(7)), F.lit(1 << 30))
    share = spark.createDataFrame([(r[0], min(1 << 30, int((1 << 30) * 2.0 * most / r[1]) + 1)) for r in sizes], rows.select(F.col(group).alias("_group")).schema.add("_share", "long"))
    near = rows.select(group, id_column).withColumn("_drawn", drawn).where(F.col("_drawn") < int(max((1 << 30) * 2.0 * most / min(r[1] for r in sizes) + 1, 1)))
    got = near.join(F.broadcast(share), F.col(group) == F.col("_group")).where("_drawn < _share").select(group, id_column, "_drawn").distinct().limit(4 * most * len(sizes)).collect()
    return sorted(got, key=lambda r: (str(r[group]), r["_drawn"], r[id_column]))
