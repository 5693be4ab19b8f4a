"""Which images belong to which record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plate import bound

#: The row that ends the last block; rows in EMU and their default height in points.
LAST_ROW, EMU, DEFAULT_HEIGHT = 99999, 12700, 15


def blocks(cells: DataFrame) -> DataFrame:
    """(file, first_row, end_row) of the blocks of a sheet: each begins where column A holds a whole number over 0."""
    starts = cells.where((F.col("col") == 1) & F.col("type").isin("int", "bool") & (F.col("raw").try_cast("bigint") > 0)).select("file", F.col("row").alias("first_row"))
    return with_ends(starts)


def with_ends(starts: DataFrame) -> DataFrame:
    """starts (file, first_row) with end_row: the next block's first row, LAST_ROW after the last."""
    after = F.lead("first_row", 1, LAST_ROW).over(Window.partitionBy("file").orderBy("first_row"))
    return starts.withColumn("end_row", after)


def images_in_blocks(starts: DataFrame, anchors: DataFrame) -> DataFrame:
    """(file, first_row, image_ix, anchor_row, media) of each anchor in the block whose rows hold it, with content if the anchors have it.

    starts (file, first_row), anchors (file, anchor_row, media, ord). The blocks of a file do not overlap, so
    the interval join is the last start at or before the anchor: one window over both, no pairs. Images
    count in order of the first appearance of their row in the drawing, then of their own.
    """
    rows = F.lit(None).cast("string"), F.lit(None).cast("int")
    events = starts.select("file", F.col("first_row").alias("row"), F.lit(0).alias("kind"), F.col("first_row").alias("start"), rows[0].alias("media"), rows[1].alias("ord"))
    more = [c for c in ("content",) if c in anchors.columns]
    events = events.unionByName(anchors.select("file", F.col("anchor_row").alias("row"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["first_row"].dataType).alias("start"), "media", F.col("ord").cast("int").alias("ord"), *more), allowMissingColumns=True)
    order = Window.partitionBy("file").orderBy("row", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = events.withColumn("first_row", F.last("start", ignorenulls=True).over(order)).where("kind = 1 and first_row is not null")
    held = held.withColumn("seen", F.min("ord").over(Window.partitionBy("file", "first_row", "row")))
    ix = F.row_number().over(Window.partitionBy("file", "first_row").orderBy("seen", "ord", "media"))
    return held.select("file", "first_row", ix.alias("image_ix"), F.col("row").alias("anchor_row"), "media", *more)


def images_from_row(records: DataFrame, anchors: DataFrame, row: int = 6) -> DataFrame:
    """Images of workbooks with one record: all anchors from a row on, counted in order of row, then drawing."""
    ix = F.row_number().over(Window.partitionBy("file").orderBy("anchor_row", "ord", "media"))
    return records.join(anchors.where(F.col("anchor_row") >= row), "file").withColumn("image_ix", ix)


def shifted_row(row: Column, offset: Column, height: Column) -> Column:
    """The row an image is for: the next one if it begins below half of its anchor's height (in EMU, default 15 points)."""
    return F.when(offset > 0.5 * F.coalesce(height, F.lit(DEFAULT_HEIGHT * EMU)), row + 1).otherwise(row)


def first_images(records: DataFrame, sources: list[str], anchors: DataFrame) -> DataFrame:
    """records with `image` and `origin`: the first of the source columns that has a value, else the row's first embedded image.

    records (file, sheet_row, ...), anchors (file, anchor_row, media, ord). Records without any keep nulls.
    """
    first = anchors.groupBy("file", F.col("anchor_row").alias("sheet_row")).agg(F.min_by("media", F.struct("ord", "media")).alias("__media"))
    joined = records.join(first, ["file", "sheet_row"], "left")
    named = [F.when(has, F.struct(F.col(c).alias("image"), F.lit(c).alias("origin"))) for c in sources for has in [F.coalesce(F.trim(c) != "", F.lit(False))]]
    embedded = F.when(F.col("__media").isNotNull(), F.struct(F.col("__media").alias("image"), F.lit("embedded").alias("origin")))
    return joined.withColumn("__first", F.coalesce(*named, embedded)).select(*records.columns, "__first.image", "__first.origin")


def by_ordinal(passages: DataFrame, images: DataFrame, each: int = 3) -> DataFrame:
    """(page, k, image_ix, media): the k-th passage of a page takes `each` images from each*k on.

    passages (page, k from 0), images (page, media, x0, y0) in order of y0, then x0.
    """
    n = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "media")) - 1
    placed = images.withColumn("n", n).select("page", "media", F.floor(F.col("n") / each).cast("int").alias("k"), (F.col("n") % each + 1).cast("int").alias("image_ix"))
    return passages.join(placed, ["page", "k"]).select("page", "k", "image_ix", "media")


def large_photos(images: DataFrame, large: int = 100_000, fair: int = 10_000, most: int = 6) -> DataFrame:
    """images (file, area, ord) with image_ix: by area, all that are large; in files without, the fair ones of the `most` largest."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("area"), "ord"))
    top = F.max("area").over(Window.partitionBy("file"))
    ranked = images.withColumns({"image_ix": rank, "top": top})
    keep = F.when(F.col("top") >= large, F.col("area") >= large).otherwise((F.col("area") >= fair) & (F.col("image_ix") <= most))
    return ranked.where(keep).drop("top")


def large_of(areas: Column, large: int = 100_000, fair: int = 10_000, most: int = 6) -> Column:
    """As large_photos of one file: areas is its array of struct(page, ord, area) in order; struct(s, n, page, ord) of those kept, in order of image_ix."""
    ranked = F.array_sort(F.transform(areas, lambda a, n: F.struct(F.negate(a["area"]).alias("s"), n.alias("n"), a["page"].alias("page"), a["ord"].alias("ord"))))

    def of(r: Column) -> Column:
        return F.when(F.get(r, F.lit(0))["s"] <= -large, F.filter(r, lambda x: x["s"] <= -large)).otherwise(F.filter(F.slice(r, 1, most), lambda x: x["s"] <= -fair))

    return bound(ranked, of)


def with_reference(images: DataFrame, sheet: DataFrame) -> DataFrame:
    """images (id, id_ok, ...) with the sheet's plate, date, time, category of the id, and id_status.

    Of repeated ids in the sheet (id, sheet_row, plate, date, time, category) the last row counts; empty ids
    never match. Ids out of form are not looked up.
    """
    named = sheet.where("id is not null and id <> ''")
    last = named.groupBy("id").agg(F.max_by(F.struct("plate", "date", "time", "category"), "sheet_row").alias("__ref"))
    joined = images.join(last, "id", "left")
    ref = F.when(F.col("id_ok"), F.col("__ref"))
    status = F.when(~F.col("id_ok"), "ID fora do padrão").when(F.col("__ref").isNull(), "ID não encontrado na planilha").otherwise("ID - OK")
    fields = [ref[c].alias(c) for c in ("plate", "date", "time", "category")]
    return joined.select(*images.columns, status.alias("id_status"), *fields)
