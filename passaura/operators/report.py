"""What is reported: the best row of each id, summaries, labels and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .elect import APPROVED, NO_IMAGE, REVIEW


def row_score(id_status: Column, status: Column, difference: Column) -> Column:
    """Less is better: 0 approved, 100 review, 200 no image, 300 else; 1000 more unless the id is found; plus the distance cut to a whole number (999 without)."""
    base = F.when(status == APPROVED, 0).when(status == REVIEW, 100).when(status == NO_IMAGE, 200).otherwise(300)
    off = F.when(F.coalesce(id_status == "ID - OK", F.lit(False)), 0).otherwise(1000)
    return base + off + F.coalesce(difference.cast("int"), F.lit(999))


def best_per_id(rows: DataFrame) -> DataFrame:
    """Of each id (null is one too) the row of least score, then least difference (none last), then first file."""
    score = row_score(F.col("id_status"), F.col("status"), F.col("difference"))
    order = Window.partitionBy("id").orderBy("score", F.asc_nulls_last("difference"), "file")
    return rows.withColumn("score", score).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def status_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of all rows and of each status, and their shares in percent, unrounded (0 of no rows)."""
    counts = {"approved": F.col("status") == APPROVED, "review": F.col("status") == REVIEW, "no_image": F.col("status") == NO_IMAGE}
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    share = lambda n: F.when(F.col("total") > 0, 100.0 * F.col(n) / F.col("total")).otherwise(0.0)
    return out.withColumns({f"{n}_pct": share(n) for n in counts})


def summary_text(summary: DataFrame, digits: int = 0) -> list[str]:
    """The summary as lines for a console; halves are rounded to even."""
    lines = []
    for r in summary.toLocalIterator():
        lines.append(f"Total: {r['total']}")
        lines += [f"{n}: {r[n]} ({r[n + '_pct']:.{digits}f}%)" for n in ("approved", "review", "no_image")]
    return lines


def batches(rows: DataFrame, by: str, order: str, size: int = 64) -> DataFrame:
    """rows with batch: their number within `by` in order, by `size`. Batches are dealt within a group, so no task holds all rows."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int"))


def labelled(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The columns of a report under their labels, in order, nulls as empty strings."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(label) for c, label in labels.items()))
