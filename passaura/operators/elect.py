"""Electing what is read: boxes, texts, and a record's best image.

A record's images are read in order and reading stops at the first that is good enough, so later ones do not
count. Here that is a filter by what comes before: all images are read at once, and the sequel of a stop drops.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plate as P

APPROVED, REVIEW, NO_IMAGE = "Aprovado - busca nas imagens", "Revisar", "Revisar - sem imagem"
MAX_DISTANCE, MIN_MATCHES, MIN_CONFIDENCE = 3, 4, 0.35
LEAST_RATIO, MOST_RATIO = 0.8, 6.0


def box_reason(confidence: Column, width: Column, height: Column) -> Column:
    """Why a detected box is not used: low confidence, too square, too wide; null if it is."""
    ratio = width / F.greatest(height, F.lit(1))
    return F.when(confidence < MIN_CONFIDENCE, "confidence").when(ratio < LEAST_RATIO, "too square").when(ratio > MOST_RATIO, "too wide")


def usable_boxes(boxes: DataFrame) -> DataFrame:
    """boxes (x1, y1, x2, y2, conf, ...), corners cut to whole numbers, that are confident and of a plate's shape."""
    whole = boxes.withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})
    return whole.where(box_reason(F.col("conf"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).isNull())


def top_boxes(boxes: DataFrame, by: tuple[str, ...] = ("passage_id", "image_ix"), n: int = 1) -> DataFrame:
    """The n most confident boxes of each image, box_ix breaking ties; only then the usable ones of them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("conf"), "box_ix"))
    return usable_boxes(boxes.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank"))


def with_joined(reads: Column, confidence: float | None = None) -> Column:
    """reads, an array of struct(text, confidence), and if it has more than one, their joint text with the mean confidence (or the given one)."""
    text = F.array_join(F.transform(reads, lambda r: r["text"]), "")
    mean = F.aggregate(reads, F.lit(0.0), lambda n, r: n + r["confidence"]) / F.size(reads) if confidence is None else F.lit(confidence)
    return F.when(F.size(reads) > 1, F.concat(reads, F.array(F.struct(text.alias("text"), mean.alias("confidence"))))).otherwise(reads)


def elected_text(candidates: DataFrame, by: tuple[str, ...] = ("passage_id", "image_ix"), enough: float = 0.0) -> DataFrame:
    """(by, ocr_text): what an image is read as, from its candidates (box_ix, variant_ix, cand_ix, text, confidence, mask).

    The first candidate that is a valid plate with confidence `enough` wins; else the best score (confidence,
    plus 5 if valid, less 2 for each character off seven) over -1, the first of equals; null if there is none.
    """
    text = P.normalize(F.col("text"), F.col("mask"))
    own = candidates.select(*by, F.struct("box_ix", "variant_ix", "cand_ix").alias("at"), text.alias("t"), "confidence").where("t <> ''")
    valid = P.is_valid(F.col("t"))
    score = F.col("confidence") + F.when(valid, 5.0).otherwise(0.0) - 2.0 * F.abs(F.length("t") - 7)
    own = own.withColumns({"valid": valid & (F.col("confidence") >= enough), "score": score})
    place = F.struct(F.negate(F.col("score")).alias("s"), "at")
    won = F.coalesce(F.min_by("t", F.when(F.col("valid"), F.col("at"))), F.min_by("t", F.when(F.col("score") > -1, place)))
    return own.groupBy(*by).agg(won.alias("ocr_text"))


def instrumented(boxes: DataFrame, candidates: DataFrame, by: tuple[str, ...] = ("passage_id", "image_ix")) -> DataFrame:
    """All that was seen and read of each image, for inspection: nothing stops early and no box is left out.

    boxes (by, box_ix, x1, y1, x2, y2, conf), candidates (by, mask, box_ix, variant_ix, cand_ix, text, confidence). A row of each image
    of boxes: n_boxes, n_accepted, the best text, score and place (best_text '' and -1, null places if no score is over -1, the first of equals), and `boxes`,
    nested: box_ix, conf, ratio, reason (null: accepted) and its variants: variant_ix, best_text, best_confidence, best_score, and
    its candidates: cand_ix, raw, text, confidence, valid, score. Candidates of boxes that are not accepted do not count, and have no variants.
    """
    w, h = F.col("x2").cast("int") - F.col("x1").cast("int"), F.col("y2").cast("int") - F.col("y1").cast("int")
    seen = boxes.select(*by, "box_ix", F.struct(F.col("conf").alias("conf"), (w / F.greatest(h, F.lit(1))).alias("ratio"), box_reason(F.col("conf"), w, h).alias("reason")).alias("seen"))
    # both are dealt out by image as they come; what follows is grouped where it lies
    read = candidates.select(*by, "box_ix", "variant_ix", F.struct("cand_ix", F.col("text").alias("raw"), "mask", "confidence").alias("c"))
    both = seen.unionByName(read, allowMissingColumns=True).repartition(*by)
    raw = F.when(F.col("c").isNotNull(), F.coalesce("c.raw", F.lit("")))
    both = both.withColumn("text", P.normalize(raw, F.col("c.mask"))).withColumn("valid", P.is_valid(F.col("text")))
    both = both.withColumn("score", F.col("c.confidence") + F.when(F.col("valid"), 5.0).otherwise(0.0) - 2.0 * F.abs(F.length("text") - 7))
    first = lambda *place: F.when(F.col("score") > -1, F.struct(F.negate("score").alias("s"), *place))
    one = F.when(F.col("c").isNotNull(), F.struct("c.cand_ix", "c.raw", "text", "c.confidence", "valid", "score"))
    variants = both.groupBy(*by, "box_ix", "variant_ix").agg(F.collect_list("seen").alias("seen"), F.array_sort(F.collect_list(one)).alias("candidates"), F.min_by(F.struct("text", "c.confidence", "score", "c.cand_ix"), first("c.cand_ix")).alias("b"))
    best = [F.coalesce("b.text", F.lit("")).alias("best_text"), F.coalesce("b.confidence", F.lit(0.0)).alias("best_confidence"), F.coalesce("b.score", F.lit(-1.0)).alias("best_score")]
    variant = F.when(F.size("candidates") > 0, F.struct("variant_ix", *best, "candidates"))
    held = variants.groupBy(*by, "box_ix").agg(F.flatten(F.collect_list("seen")).alias("seen"), F.array_sort(F.collect_list(variant)).alias("variants"))
    known = functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*by, "box_ix")))  # nulls are no place that a candidate could be at
    joined = held.select(*by, "box_ix", F.explode("seen").alias("seen"), F.when(known, F.col("variants")).otherwise(F.array().cast(held.schema["variants"].dataType)).alias("variants"))
    joined = joined.select(*by, "box_ix", F.col("seen.conf").alias("box_conf"), "seen.ratio", "seen.reason", F.when(F.col("seen.reason").isNull(), F.col("variants")).otherwise(F.array().cast(held.schema["variants"].dataType)).alias("variants"))
    # the first variant of a box with its most, and over boxes likewise
    top = F.array_min(F.transform(F.filter("variants", lambda v: v["best_score"] > -1), lambda v: F.struct(F.negate(v["best_score"]).alias("s"), v["variant_ix"].alias("variant_ix"), v["best_text"].alias("text"))))
    joined = joined.withColumn("top", top)
    place = F.when(F.col("top").isNotNull(), F.struct(F.col("top.s"), "box_ix", F.col("top.variant_ix"), F.col("top.text")))
    out = joined.groupBy(*by).agg(
        F.count("*").alias("n_boxes"), F.count_if(F.col("reason").isNull()).alias("n_accepted"), F.min(place).alias("w"), F.array_sort(F.collect_list(F.struct("box_ix", F.col("box_conf").alias("conf"), "ratio", "reason", "variants"))).alias("boxes")
    )
    return out.select(*by, "n_boxes", "n_accepted", F.coalesce("w.text", F.lit("")).alias("best_text"), F.coalesce(F.negate("w.s"), F.lit(-1.0)).alias("best_score"), F.col("w.box_ix").alias("best_box"), F.col("w.variant_ix").alias("best_variant"), "boxes")


def read_once(images: DataFrame, read) -> DataFrame:
    """images (content_sha, mask, ...) with the text that read() gives, each distinct image and mask read once.

    read takes a DataFrame (content_sha, mask) and adds ocr_text.
    """
    distinct = images.select("content_sha", "mask").distinct()
    found = read(distinct).select(F.col("content_sha").alias("__sha"), F.col("mask").alias("__mask"), "ocr_text")
    return images.join(found, (F.col("content_sha") == F.col("__sha")) & F.col("mask").eqNullSafe(F.col("__mask")), "left").drop("__sha", "__mask")


def _compared(passages: DataFrame, reads: DataFrame) -> DataFrame:
    """reads with the passage's mask and plate as normalised, the reading as normalised, and the distance (999 unread)."""
    expected = passages.select("passage_id", P.mask_of(F.col("expected_plate")).alias("mask"), "expected_plate")
    expected = expected.select("passage_id", "mask", P.normalize(F.col("expected_plate"), F.col("mask")).alias("plate"))
    joined = reads.join(expected, "passage_id")
    known = F.coalesce((F.trim("ocr_text") != "") & (F.col("ocr_text") != P.UNREAD), F.lit(False))
    joined = joined.select("passage_id", "image_ix", "plate", F.when(known, F.col("ocr_text")).alias("raw"), "mask")
    return joined.withColumn("read", P.normalize(F.col("raw"), F.col("mask")))


def _grouped(own: DataFrame, stop: Column, *best: Column) -> DataFrame:
    """A row of each passage: *best, total_images, images_with_ocr (those up to the first that meets `stop`), plate.

    One aggregation: of a passage's readings only the places are held together, and none are sorted.
    """
    place = F.struct("image_ix")  # a null place is the first
    found = own.groupBy("passage_id").agg(
        *best, F.count("*").alias("total_images"), F.first("plate").alias("plate"), F.min(F.when(stop, place)).alias("stop"), F.collect_list(F.when(F.col("raw").isNotNull(), place)).alias("places")
    )
    seen = F.size(F.filter("places", lambda x: F.col("stop").isNull() | (x <= F.col("stop"))))
    return found.withColumn("images_with_ocr", seen).drop("stop", "places")


def _evaluated(passages: DataFrame, best: DataFrame, approved: Column, shown: Column, raw: Column, *more: Column) -> DataFrame:
    """A row of the evaluation for each passage; those without images are for review."""
    own = passages.select("passage_id").join(best, "passage_id", "left")
    none = F.col("total_images").isNull()
    status = F.when(none, NO_IMAGE).when(approved, APPROVED).otherwise(REVIEW)
    return own.select(
        "passage_id", F.coalesce(F.when(~none, shown), F.lit(P.UNREAD)).alias("plate_result"), F.coalesce(raw, F.lit("")).alias("ocr_raw"), status.alias("status"),
        F.coalesce(F.col("best.difference"), F.lit(P.UNREAD_COST)).alias("difference"), F.col("best.image_ix").cast("int").alias("image_used"),
        F.coalesce("total_images", F.lit(0)).cast("int").alias("total_images"), F.coalesce("images_with_ocr", F.lit(0)).cast("int").alias("images_with_ocr"), *more,
    )


def evaluate_by_distance(passages: DataFrame, reads: DataFrame, show: str = "expected", raw: str = "raw", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """The evaluation of passages (passage_id, expected_plate) by reads (passage_id, image_ix, ocr_text).

    The reading of least distance counts, the earliest of equals; reading stops at distance 0; a distance up
    to max_distance approves. An approved passage shows its expected plate or, with show="read", what was
    read. ocr_raw is the reading as it came or, with raw="normalized", as compared. A reading at 999 (nothing
    to compare with) elects nothing. total_images counts all images, images_with_ocr readable ones up to the stop.
    """
    own = _compared(passages, reads).withColumn("difference", P.distance(F.col("plate"), F.col("read")))
    entry = F.struct("image_ix", "difference", "read", "raw")
    # the first at distance 0 is the least of all by difference and place, so what follows it cannot be elected
    rank = F.when(F.col("raw").isNotNull() & (F.col("difference") < P.UNREAD_COST), F.struct("difference", "image_ix"))
    best = _grouped(own, F.col("difference") == 0, F.min_by(entry, rank).alias("best"))
    approved = F.coalesce(F.col("best.difference") <= max_distance, F.lit(False))
    read = F.nullif(F.col("best.read"), F.lit(""))
    shown = read if show == "read" else F.when(approved, F.col("plate")).otherwise(read)
    return _evaluated(passages, best, approved, shown, F.col("best.raw" if raw == "raw" else "best.read"))


def evaluate_by_matches(passages: DataFrame, reads: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """As evaluate_by_distance, by coinciding characters: most matches, then least distance, then the earliest.

    Reading stops at min_matches, which also approve. The column matches is added.
    """
    own = _compared(passages, reads).withColumns({"difference": P.distance(F.col("plate"), F.col("read")), "matches": P.matches(F.col("plate"), F.col("read"))})
    stop = F.col("matches") >= min_matches
    entry = F.struct("image_ix", "difference", "read", "raw", "matches")
    counts = F.col("raw").isNotNull() & ((F.col("matches") > 0) | (F.col("difference") < P.UNREAD_COST))
    rank = F.when(counts, F.struct(F.negate("matches").alias("m"), "difference", "image_ix"))
    # what stops has more matches than all before it, so it is elected if reading stops
    first = F.min_by(F.struct(F.when(counts, entry).alias("e")), F.when(stop, F.struct("image_ix", rank.alias("r"))))
    best = _grouped(own, stop, F.min_by(entry, rank).alias("most"), first.alias("first"))
    best = best.withColumn("best", F.when(F.col("first").isNotNull(), F.col("first.e")).otherwise(F.col("most")))
    approved = F.coalesce(F.col("best.matches") >= min_matches, F.lit(False))
    shown = F.when(approved, F.col("plate")).otherwise(F.nullif(F.col("best.read"), F.lit("")))
    return _evaluated(passages, best, approved, shown, F.col("best.raw"), F.coalesce("best.matches", F.lit(0)).alias("matches"))
