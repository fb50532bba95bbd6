"""Tables in the shared folder that cut lineage, and running totals along a global order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Spark's setting to delete the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files a core that a table of rows with texts or sets, and a result, is written in at most; tables of some numbers a row take one.
FILES_A_CORE = 4
#: Hadoop's setting to end a write with an empty file `_SUCCESS`, which nobody looks for in a table that is read at once.
MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on one machine may it be unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
    if not getattr(spark, "_specloom_dir", None):
        spark._specloom_dir = tempfile.mkdtemp(prefix="specloom-")
    return spark._specloom_dir


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor.

    `keep` writes and reads back; the write's own shuffle files go as soon as it is done. With `few`, the last stage has so many tasks
    a core at most (see `in_few_files`), and with 0 as many as it has partitions. `drop` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/specloom/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, few: int = 0) -> DataFrame:
        path = f"{self.base}/{name}"
        if few:
            df = in_few_files(df, few)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").option(MARK, "false").parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_few_files(df: DataFrame, a_core: int = FILES_A_CORE) -> DataFrame:
    """df in `a_core` partitions a core at most, without a shuffle, so that a write does not make a file for each shuffle partition.

    On a local folder Hadoop starts processes for each new file, to set its mode; while one starts, it shares the executor's memory and
    counts as a second heap. The partitions that a task takes are done one after the other; a hash join by shuffle in that stage would
    hold the tables of all of them.
    """
    return df.coalesce(a_core * df.sparkSession.sparkContext.defaultParallelism)


def ranged(scratch: Scratch, df: DataFrame, name: str, *order) -> DataFrame:
    """df cut into blocks along `order` and kept, with the number of its block in `_pid`.

    Blocks are Spark's range partitions, so that a global running total needs one total a block and
    never a window over all rows. A last, random key spreads rows that are equal in `order`.
    """
    cut = df.withColumn("_salt", F.rand(7)).repartitionByRange(*order, F.col("_salt")).drop("_salt")
    return scratch.keep(cut.withColumn("_pid", F.spark_partition_id()), name)


def block_offsets(blocks: DataFrame, *sums) -> DataFrame:
    """One row a block: `_pid` and, for each (name, column), the sum over all earlier blocks.

    There are as many rows as blocks, so the window over all of them stays small.
    """
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("_pid").agg(*[F.sum(c).alias(n) for n, c in sums])
    return totals.select("_pid", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n, _ in sums])
