"""Tables out of the cells of sheets (file, row, col, raw)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import has_value, strict_name


def header_rows(cells: DataFrame, required: tuple[str, ...], within: int = 40) -> DataFrame:
    """(file, header_row): the first row up to `within` whose names hold all the required strict names; files without are left out."""
    names = cells.where((F.col("row") <= within) & has_value(F.col("raw"))).groupBy("file", "row").agg(F.collect_set(strict_name(F.col("raw"))).alias("names"))
    full = names.where(F.size(F.array_except(F.array(*map(F.lit, required)), "names")) == 0)
    return full.groupBy("file").agg(F.min("row").alias("header_row"))


def record_rows(cells: DataFrame, fields: dict[str, int], rows: DataFrame | None = None) -> DataFrame:
    """(file, row, *fields): the raw values of the columns (by number) of each row, or of those in rows (file, row).

    One grouped aggregation; a field with no cell is null.
    """
    own = cells if rows is None else cells.join(rows, ["file", "row"], "left_semi")
    return own.groupBy("file", "row").agg(*(F.max(F.when(F.col("col") == n, F.col("raw"))).alias(name) for name, n in fields.items()))
