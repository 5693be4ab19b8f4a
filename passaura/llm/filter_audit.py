"""What each filter of a chain adds, in every order of the chain.

Documents become cells: how many of a part fail just these filters (a bit mask) and have these labels. All else is
worked out on the cells, of which there are few, however many documents there are. Cells are unpivoted against
the steps of all orders; a running bit-or over a cell's earlier steps says whether it was removed before, and sums by
condition give a step's documents removed, kept, failing again, and so on. The total of a filter's removals over all orders comes from a
window over filter and part.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named, prepare, spread_join, written

#: Filters of one audit: their orders are listed, 720 for six.
MOST_FILTERS = 6
CELLS = ("part", "mask", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """The production filters by letter, each true where a text fails it; a null text is empty.

    A: under 200 words. B: fewer than half of the words are distinct. C: over 3 % of the characters are A-Z. D: one of #$%&*|.
    Words are what lies between blanks (space and the characters 9 to 13); case counts.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, filters: dict[str, Column], part: Column, id_col: str = "doc_id", text_col: str = "text", repeats: str | None = None) -> DataFrame:
    """(id, part, mask, n): how many rows of docs with an id fail just these filters, bit k of mask for the k-th.

    A null filter is not failed. With `repeats`, that letter comes last: it fails texts that a smaller id has as well, anywhere in
    docs. Null texts are empty, null parts ''. A null id is no id: it neither repeats nor is repeated. Repeated rows
    count as often as they come, and do not repeat each other. Texts meet by a digest of 256 bits, and only ids, parts, masks and digests are
    shuffled, counted within a task before; a text or id with a great part of all rows meets its other side by broadcast.
    """
    prepare(docs.sparkSession)
    mask = F.lit(0)
    for k, fails in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(fails, 1 << k).otherwise(0))
    digest = F.unhex(F.sha2(F.coalesce(named(text_col), F.lit("")).cast("binary"), 256)) if repeats else F.lit(None).cast("binary")
    rows = docs.select(named(id_col).alias("id"), F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    rows = written(rows.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n")), "audit-rows")
    if not repeats:
        return rows.drop("digest")
    with_id = rows.where("id is not null")
    texts = written(with_id.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")), "audit-texts")
    joined = spread_join(with_id, texts, "digest", rows="rows")
    again = F.when(F.col("id") > F.col("first"), 1 << len(filters)).otherwise(0)
    return joined.select("id", "part", F.col("mask").bitwiseOR(again).alias("mask"), "n").unionByName(rows.where("id is null").drop("digest"))


def cells(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n) of failures() with labels: good if a row of the id has quality 1, toxic if one has toxic 1; without labels neither."""
    failed = written(failed, "audit-failures")
    has = lambda c: F.max(F.coalesce(named(c) == 1, F.lit(False)))
    marked = written(labels.where(named(id_col).isNotNull()).groupBy(named(id_col).alias("id")).agg(has("quality").alias("good"), has("toxic").alias("toxic")), "audit-labels")
    rows = spread_join(failed.where("id is not null"), marked, "id", "left").unionByName(failed.where("id is null").withColumns({"good": F.lit(None).cast("boolean"), "toxic": F.lit(None).cast("boolean")}))
    flags = [F.coalesce(x, F.lit(False)).alias(x) for x in ("good", "toxic")]
    return rows.groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the letters and step, from cells(): what the step's filter does there.

    (part, filter_order, step from 1, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), zeros included. kept: after
    this step; removed: here; redundant: failing this filter, removed before; unique_fails: failing this filter only; good_lost and
    toxic_lost: of those removed; shapley: the filter's removals over all orders. No cells: no rows.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"1 to {MOST_FILTERS} different letters")
    orders = F.split(F.lit(",".join(map("".join, itertools.permutations(letters)))), ",")
    steps = counted.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("step", "filter"))
    steps = steps.withColumns({"step": F.col("step") + 1, "bit": F.expr(f"shiftleft(1, instr('{letters}', filter) - 1)")}).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy(*CELLS, "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("failed", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    here, gone = F.col("fails") != 0, F.col("failed") != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    found = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~here & ~gone).alias("kept"), total(here & ~gone).alias("removed"), total(here & gone).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & ~gone & F.col("good")).alias("good_lost"), total(here & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", repeats: str | None = None) -> DataFrame:
    """interactions() of filters (and of `repeats`, see failures()) over docs with labels (id_col, quality, toxic).

    Other columns and their names do not matter; labels of unknown ids are passed over; an empty table gives no rows.
    """
    failed = failures(docs, filters, part, id_col, text_col, repeats)
    return interactions(cells(failed, labels, id_col), "".join(filters) + (repeats or ""))
