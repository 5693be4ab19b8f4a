"""Tables on pages, from the boxes of their words.

Lines and columns are found by sweeps over a page's words: a line begins where nothing reaches down from above, or
where a ruling line says so; a column begins where nothing reaches from the left. Cells are what stands in a line and column.
Spark deals words out by page and sorts them by it; the sweeps of many pages at once are done on arrays where they lie.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE, _BOX = ("file", "page"), ("x0", "y0", "x1", "y1")
#: Points without any word between two columns.
GAP = 3.0


def rows(words: DataFrame, rules: DataFrame | None = None, gap: float = GAP) -> DataFrame:
    """(file, page, line, cells): each line's cells from the left, an array of as many as the page has columns, '' where a line has none.

    words (file, page, word, x0, y0, x1, y1). Lines count from 0, downwards: words that overlap in height, or are joined by ones that do, are one line.
    Where a page has horizontal ruling lines, rules (file, page, y), words between two of them are one line, however many lines of text that is; there a
    word's middle counts. Words whose extents overlap, or are less than gap apart, anywhere on the page are one column.

    A cell's words are joined by blanks, downwards, then from the left. Words without a box or of nothing but white space are no words; repeated words
    come as often as they are; pages are read apart, so the order of rows and tasks does not matter; no words: no rows.
    """
    # what is no word is left out where sweeps are made: a filter here is moved to where words come from, and works them out once more for each condition
    own = words.select(*PAGE, F.coalesce("word", F.lit("")).alias("word"), *(F.col(c).cast("double").alias(c) for c in _BOX))
    if rules is not None:  # among the words, as rows without one, so that both are dealt out once
        own = own.unionByName(rules.select(*PAGE, F.col("y").cast("double").alias("y0")), allowMissingColumns=True)
    # a page's words are dealt out and put together once, by one whole number; all sweeps are made where they lie
    held = own.repartition(*PAGE).withColumn("key", F.xxhash64(*PAGE)).sortWithinPartitions("key")
    line, kind = ("bigint", pa.int64()) if rules is None else ("int", pa.int32())
    shape = held.select(*PAGE, F.lit(0).cast(line).alias("line"), F.array(F.lit("")).alias("cells")).schema

    def over(batches):
        return (_cells(pages, gap, kind) for pages in _whole(batches))

    return held.mapInArrow(over, shape)


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in order of their key as tables of whole pages."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        cut = ends[-1] if len(ends) else 0
        if held and len(keys) and (cut or held[-1].column("key")[0].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        if cut < len(keys):
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _cells(pages: pa.Table, gap: float, line_type: pa.DataType) -> pa.RecordBatch:
    """The lines of whole pages with their cells; a row without word is a ruling line at y0."""
    file, page, word, height = (pages.column(c).combine_chunks() for c in (*PAGE, "word", "y0"))
    files, numbers = (c.dictionary_encode(null_encoding="encode") for c in (file, page))
    _, every = np.unique(files.indices.to_numpy().astype("int64") * len(numbers.dictionary) + numbers.indices.to_numpy(), return_inverse=True)
    is_rule = word.is_null().to_numpy(zero_copy_only=False)
    boxed = functools.reduce(pc.and_, (pages.column(c).is_valid() for c in _BOX))
    place = np.flatnonzero(pc.and_kleene(boxed.combine_chunks(), pc.not_equal(pc.ascii_trim(word, " "), "")).fill_null(False).to_numpy(zero_copy_only=False))
    p, texts = every[place], word.take(pa.array(place))
    x0, y0, x1, y1 = (pages.column(c).to_numpy()[place] for c in _BOX)
    rank = pc.rank(texts, tiebreaker="dense").to_numpy()
    down, across = np.lexsort((rank, y1, x1, x0, y0, p)), np.lexsort((rank, y1, y0, x1, x0, p))
    line, col = np.empty(len(p), "int64"), np.empty(len(p), "int64")
    line[down], col[across] = _counted(p[down], y0[down], y1[down], 0.0), _counted(p[across], x0[across], x1[across], gap)
    if is_rule.any():  # rules at or above a word's middle; one without a place is above all
        middle, known = height.to_numpy(zero_copy_only=False).copy(), ~(is_rule & height.is_null().to_numpy(zero_copy_only=False))
        middle[place] = (y0 + y1) / 2
        order = np.lexsort((~is_rule, middle, known, every))
        seen, above = np.cumsum(is_rule[order]), np.empty(len(every), "int64")
        above[order] = seen - (seen - is_rule[order])[_first(every[order])]
        line = np.where((np.bincount(every, is_rule) > 0)[p], above[place], line)
    _, first, row = np.unique(p * (line.max(initial=0) + 1) + line, return_index=True, return_inverse=True)
    width = np.zeros(every.max() + 1, "int64")
    np.maximum.at(width, p, col + 1)
    ends = np.cumsum(width[p[first]])
    at = (ends - width[p[first]])[row] + col
    order = down[np.argsort(at[down], kind="stable")]
    taken, starts = np.unique(at[order], return_index=True)
    cell = pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(order)], pa.int32()), texts.take(pa.array(order))), " ")
    index = np.full(ends[-1] if len(ends) else 0, -1)
    index[taken] = np.arange(len(taken))
    cells = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), cell.take(pa.array(index, mask=index < 0)).fill_null(""))
    own, n = pa.array(place[first]), np.arange(len(first)) - _first(p[first])
    return pa.RecordBatch.from_arrays([file.take(own), page.take(own), pa.array(n, line_type), cells], [*PAGE, "line", "cells"])


def _first(p: np.ndarray) -> np.ndarray:
    """Of each place in sorted numbers the first with the same number."""
    return np.searchsorted(p, p)


def _counted(p: np.ndarray, start: np.ndarray, end: np.ndarray, gap: float) -> np.ndarray:
    """The groups of a page's extents, in order of page and start, from 0: one begins where a start lies beyond all ends before it by more than gap. NaN is beyond all numbers."""
    values, ranks = np.unique(end, return_inverse=True)
    before = values[np.maximum.accumulate(p * len(values) + ranks) - p * len(values)][:-1] + gap
    begins = np.ones(len(p), bool)
    begins[1:] = (p[1:] != p[:-1]) | (start[1:] > before) | (np.isnan(start[1:]) & ~np.isnan(before))
    n = np.cumsum(begins)
    return n - n[_first(p)]


#: The fields of a passage's row, by column.
FIELDS = ("id", "date", "time", "sp", "km", "plaza", "lane", "direction", "city", "code", "plate", "model", "axles", "fare", "responsible")


def passage_rows(table: DataFrame) -> DataFrame:
    """(file, page, FIELDS) of each page's first line whose first cell begins with ten digits; '' for missing cells; pages without such a line are left out."""
    found = table.where(F.trim(F.get("cells", F.lit(0))).rlike("^[0-9]{10,}"))
    first = found.groupBy(*PAGE).agg(F.min_by("cells", "line").alias("cells"))
    return first.select(*PAGE, *(F.trim(F.coalesce(F.get("cells", F.lit(k)), F.lit(""))).alias(n) for k, n in enumerate(FIELDS)))
