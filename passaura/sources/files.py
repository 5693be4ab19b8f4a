"""Files of a folder, by extension, through Spark's readers (any file system Spark knows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as an image, in any case.
IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp")


def _glob(extensions: tuple[str, ...]) -> str:
    """A pattern of names with one of the extensions in any case."""
    either = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    return "*.{" + ",".join(map(either, extensions)) + "}"


def files(spark: SparkSession, path: str | DataFrame, *extensions: str) -> DataFrame:
    """(file, name, length, content) of a file, or of a folder's own files, with one of the extensions in any case; no order.

    Other files are not opened, and content is read only if it is used. path can be a table (file, content) too.
    """
    if isinstance(path, DataFrame):
        found = path.select(F.col("file").alias("path"), F.length("content").cast("long").alias("length"), "content")
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", _glob(extensions)).load(path)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    own = F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))
    return found.where(own.isin(*[x.lower() for x in extensions])).select(F.col("path").alias("file"), name.alias("name"), "length", "content")


def is_picture(content: Column) -> Column:
    """Whether bytes begin as a picture of one of the types does (JPEG, PNG, BMP, TIFF, WebP)."""
    start = F.hex(F.substring(content, 1, 12))
    return F.coalesce(start.rlike("^(FFD8FF|89504E470D0A1A0A|424D|49492A00|4D4D002A|52494646.{8}57454250)"), F.lit(False))


def fetched(addresses: DataFrame, hosts: tuple[str, ...], seconds: float = 10.0, largest: int = 32 << 20) -> DataFrame:
    """(path, content) of the addresses (path) of hosts on the given list; others, and those that fail or are larger, give no row.

    Nothing in this package calls this by itself: a sheet should not make executors call addresses unless a caller
    says which hosts it trusts. Redirects are not followed.
    """
    import urllib.error
    import urllib.request
    from urllib.parse import urlsplit

    import pandas as pd

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args, **kwargs):
            return None

    def over(frames):
        opener = urllib.request.build_opener(Stay)
        for frame in frames:
            rows = []
            for path in frame["path"]:
                parts = urlsplit(path or "")
                if parts.scheme not in ("http", "https") or (parts.hostname or "") not in hosts:
                    continue
                try:
                    with opener.open(path, timeout=seconds) as answer:
                        content = answer.read(largest + 1)
                except (urllib.error.URLError, OSError, ValueError):
                    continue
                if len(content) <= largest:
                    rows.append((path, content))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return addresses.select("path").distinct().mapInPandas(over, "path string, content binary")


def image_files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(file, name, length, ix) of the images of a folder, ix their place by path from 1; without contents, which `late.Fetch` gets where they are needed.

    Names are dealt out by range and counted there; a range's places then begin after those before it. So a folder of any size
    is many tasks, and the table of counts has a row for each range and folder.
    """
    from pyspark.sql import Window

    from .scratch import scratch_path

    folder = F.regexp_replace("file", r"[^/]*\z", "").alias("folder")
    named = files(spark, path, *IMAGE_TYPES).select("file", "name", "length", folder).repartitionByRange("folder", "file").withColumn("range", F.spark_partition_id())
    target = scratch_path(spark, "names")
    named.write.parquet(target)
    held = spark.read.schema(named.schema).parquet(target)
    before = Window.partitionBy("folder").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("folder", "range").agg(F.count("*").alias("n"))
    counts = counts.select("folder", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range", "folder").orderBy("file"))
    return held.withColumn("place", place).join(counts, ["folder", "range"]).select("file", "name", "length", (F.col("start") + F.col("place")).alias("ix"))


def decoded_images(spark: SparkSession, path: str) -> DataFrame:
    """(file, height, width, channels, data) of images as Spark decodes them: bytes in order blue, green, red; height null if it cannot."""
    found = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    ok = F.col("height") > 0
    return found.select(F.col("origin").alias("file"), *(F.when(ok, F.col(c)).alias(c) for c in ("height", "width", "nChannels", "data")))
