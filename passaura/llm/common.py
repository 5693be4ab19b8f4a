"""What the training-data operators share: session bounds and tables cut from their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and a Python worker; bounds a worker's memory.
BATCH_ROWS = 500
#: A key of over 1/HOT_SHARE of all rows is hot.
HOT_SHARE = 256
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let Python workers import this package."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, by spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves if the master is local; on a cluster that is an error, as
    executors would write where nobody else can read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "passaura-shared")
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: lost executors cost no recomputation.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(column: str):
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", rows: str | None = None) -> DataFrame:
    """left joined to right by a column of both that is unique in right, without one task for one hot key.

    Keys of over 1/HOT_SHARE of left's rows, which are fewer than HOT_SHARE, meet right's rows by broadcast; the rest
    is an ordinary join, in which no key has more rows than that. Null keys are left out of the count, so they should
    be few. `rows` is a column of right that says how many rows of left have the key; without it they are counted.
    left is read three times and right twice: both should be narrow and written.
    """
    counts = right.select(on, F.col(rows).alias("n_of_key")) if rows else written(left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n_of_key")), "key-counts")
    size = counts.agg(F.sum("n_of_key").alias("n"), F.max("n_of_key").alias("most")).first()
    if not size["n"] or size["most"] * HOT_SHARE <= size["n"] or size["n"] < HOT_SHARE:
        return left.join(right, on, how)
    hot = F.broadcast(counts.where(F.col("n_of_key") > F.lit(size["n"]) / HOT_SHARE).select(on))
    rest = left.join(hot, on, "left_anti").join(right, on, how)
    few = F.broadcast(right.join(hot, on, "left_semi"))
    return rest.unionByName(left.join(hot, on, "left_semi").join(few, on, how))
