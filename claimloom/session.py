"""Session helpers: a shared folder for tables that cut lineage, and dense ids over a global order."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Folders of tables that this process has written and not deleted yet.
_LEFT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; in local mode a temporary folder if it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="claimloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> SparkSession:
    """Bounds what goes to Python at once, in rows and bytes: texts can be long, and a batch is held several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def _delete(paths: list[str]) -> None:
    jvm = SparkContext._jvm
    if jvm is None:
        return
    active = SparkSession.getActiveSession()
    conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _LEFT.discard(path)


def drop_written() -> None:
    """Deletes every table that this process has written to the shared folder and still has there.

    Results that haven't been computed yet may read them: call it when those are done. It also runs as the process ends.
    """
    _delete(sorted(_LEFT))


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        drop_written()


class Stash:
    """Tables written to the shared folder: they cut lineage, survive lost executors, and are read again as plain scans.

    A result that is still to be computed may read them, so they stay until ``drop`` names them, or until ``drop_written``
    or the end of the process, which delete all.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        _LEFT.add(path)
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        _delete([df._stash_path for df in frames])

    def keep_only(self, *frames: DataFrame) -> None:
        """Deletes this stash's other tables: only these are still read."""
        kept = {df._stash_path for df in frames}
        _delete([p for p in self.paths if p in _LEFT and p not in kept])


def written(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: nothing above it is computed twice."""
    return Stash(df.sparkSession)(df)


def dense_ids(df: DataFrame, name: str, *order: str | Column, first: int = 1, step: Column | None = None) -> DataFrame:
    """``df`` with ``name``: consecutive numbers over a global order, or running sums of ``step`` before each row.

    Rows are range-partitioned, counted by partition (one number each goes to the driver), and numbered within it, so no
    task holds all rows.
    """
    ranged = written(df.withColumn("__step", step if step is not None else F.lit(1)).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("__part").agg(F.sum("__step")).collect())
    before = [(p, sum_) for (p, _), sum_ in zip(sizes, itertools.accumulate((n for _, n in sizes), initial=0), strict=False)]
    starts = df.sparkSession.createDataFrame(before, "__part int, __before long")
    inside = F.sum("__step").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = ranged.withColumn("__inside", inside).join(F.broadcast(starts), "__part")  # a row for each partition
    return numbered.withColumn(name, (F.col("__before") + F.col("__inside") - F.col("__step") + first).cast("long")).drop("__part", "__step", "__before", "__inside")
