"""A place that the driver and all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a task takes together of a table it writes for itself: of a row group, as packed, and of a batch that Python gets; files that it unpacks at once.
GROUP, PIECE, FILES = 16 << 20, 4 << 20, 16
_BATCH, _UNPACKED = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
_GROUPS = {"parquet.block.size": GROUP, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, deleted when the application ends.

    Where that is unset, a folder of this machine serves if the master is local; on a cluster it is an error.
    """
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + os.path.join(tempfile.gettempdir(), "passaura-scratch")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    files = parent.getFileSystem(conf)
    files.mkdirs(parent)
    files.deleteOnExit(parent)
    return path


def written(found: DataFrame, name: str, compression: str = "snappy", of_files: bool = False) -> DataFrame:
    """A table written to a new scratch path and read from there: what is read several times is worked out once.

    Row groups, pages and the batches that Python gets end by their bytes: a hundred rows, which the writer takes together at least if it is let, can be
    hundreds of MB where a row is a file, and a task holds them several times, when it writes and when it reads. of_files: it is made of such a table, of
    which only a few rows are unpacked at once.
    """
    spark = found.sparkSession
    path = scratch_path(spark, name)
    own = {_BATCH: PIECE} | ({_UNPACKED: FILES} if of_files else {})
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        found.write.options(**_GROUPS).option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(found.schema).parquet(path)
