"""Extension: evaluating passages as their readings arrive. The record layouts themselves are batch files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import elect


def evaluate_stream(passages: DataFrame, reads: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", available_now: bool = True) -> StreamingQuery:
    """Evaluate each passage once all of its readings are in, that is when the watermark passes its window.

    reads is a stream (passage_id, image_ix, ocr_text, read_at); a passage's readings fall in one window of
    `late` length. Closed windows come as micro-batches and are evaluated like a batch; each has a folder epoch=N of path of its own,
    which a batch that is tried again writes anew, so no row comes twice.
    """
    grouped = reads.withWatermark("read_at", late).groupBy(F.window("read_at", late), "passage_id").agg(F.collect_list(F.struct("image_ix", "ocr_text")).alias("r"))

    def each(batch: DataFrame, epoch: int) -> None:
        own = batch.select("passage_id", F.inline("r"))
        known = passages.join(batch.select("passage_id").distinct(), "passage_id", "left_semi")
        elect.evaluate_by_distance(known, own).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = grouped.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()
