"""Detecting and reading plates in images, through backends.

A detector is made once in a worker by make(); detect(contents) takes a list of image bytes and gives for each
its boxes, (x1, y1, x2, y2, conf). A reader's read(content, box) gives for each variant of the image (as is,
equalised, ...) its texts, a list of (text, confidence). No backend is part of this package: models, image
arithmetic and their libraries belong to it, and nothing here makes up a reading.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plain
from ..functions import plate as P
from . import elect

#: Images of a batch; readings that a task keeps.
BATCH, KNOWN = 64, 1000


class Detector(Protocol):
    def detect(self, contents: list[bytes]) -> list[list[tuple[float, float, float, float, float]]]: ...


class Reader(Protocol):
    def read(self, content: bytes, box: tuple[int, int, int, int]) -> list[list[tuple[str, float]]]: ...


_BOXES = "content_sha string, box_ix int, x1 double, y1 double, x2 double, y2 double, conf double"
_TEXTS = "content_sha string, mask string, box_ix int, variant_ix int, cand_ix int, text string, confidence double"


#: What gives an image's bytes by its file and part (null: the file itself), in the task that needs them.
Fetcher = Callable[[str, str | None], bytes]
_REF = ("file", "part")


def _bytes(frame: pd.DataFrame, fetch: Fetcher | None) -> list[bytes | None]:
    """The contents of a frame's images: its own column, or fetched."""
    if fetch is None:
        return [None if x is None else bytes(x) for x in frame["content"]]
    return [fetch(file, part) for file, part in zip(frame["file"], frame["part"], strict=True)]


def _held(fetch: Fetcher | None) -> tuple[str, ...]:
    return _REF if fetch else ("content",)


def hashed(images: DataFrame, fetch: Fetcher) -> DataFrame:
    """(file, part, content_sha) of images (file, part)."""

    def over(frames):
        for frame in frames:
            for k in range(0, len(frame), BATCH):
                part = frame.iloc[k : k + BATCH]
                yield part.assign(content_sha=[hashlib.sha256(x).hexdigest() for x in _bytes(part, fetch)])

    return images.select(*_REF).mapInPandas(over, "file string, part string, content_sha string")


def boxes(images: DataFrame, make: Callable[[], Detector], batch: int = BATCH, fetch: Fetcher | None = None) -> DataFrame:
    """The boxes of images (content_sha, content), detected by batches; a null image has none. With fetch, of images (content_sha, file, part)."""

    def over(frames):
        detector = make()
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                own = [(sha, x) for sha, x in zip(part["content_sha"], _bytes(part, fetch), strict=True) if x is not None]
                found = detector.detect([x for _, x in own]) if own else []
                rows = [(sha, n, *map(float, box)) for (sha, _), each in zip(own, found, strict=True) for n, box in enumerate(each, 1)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in _BOXES.split(", ")])

    return images.select("content_sha", *_held(fetch)).mapInPandas(over, _BOXES)


def _joined(texts, confidence: float | None) -> list[tuple[str, float]]:
    """A variant's texts and, if they are several, their joint text with the mean confidence (or all with the given one)."""
    own = [(t, float(c) if confidence is None else confidence) for t, c in texts]
    return [*own, ("".join(t for t, _ in own), sum(c for _, c in own) / len(own))] if len(own) > 1 else own


def candidates(images: DataFrame, make: Callable[[], Reader], confidence: float | None = None, fetch: Fetcher | None = None) -> DataFrame:
    """The texts of images (content_sha, mask, content or file and part, box_ix, x1, y1, x2, y2), with the joint text of variants read in parts."""

    def over(frames):
        reader = make()
        for frame in frames:
            for k in range(0, len(frame), BATCH):
                part, rows = frame.iloc[k : k + BATCH], []
                for r, content in zip(part.itertuples(index=False), _bytes(part, fetch), strict=True):
                    for v, texts in enumerate(reader.read(content, (r.x1, r.y1, r.x2, r.y2)), 1):
                        rows += [(r.content_sha, r.mask, r.box_ix, v, n, t, c) for n, (t, c) in enumerate(_joined(texts, confidence), 1)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in _TEXTS.split(", ")])

    return images.mapInPandas(over, _TEXTS)


def readings(images: DataFrame, detector: Callable[[], Detector], reader: Callable[[], Reader], top: int = 1, enough: float = 0.0, confidence: float | None = None, fetch: Fetcher | None = None) -> DataFrame:
    """(passage_id, image_ix, ocr_text) of images (passage_id, image_ix, mask, content): null where nothing is read.

    Each distinct image is detected once, by batches, and read once for each mask, the `top` most confident usable boxes of it up to a valid text. Images are dealt
    out by digest and lie beside their copies, so what is read goes to all of them where it was read: one exchange, no join. Copies of one image are one
    task's, which holds a batch of them. With fetch (see `sources.late`), images have file and part in the place of content: tasks fetch the bytes they
    look at, and only names and digests are shuffled.
    """
    if fetch:
        digests = hashed(images.select(*_REF).distinct(), fetch).withColumnsRenamed({"file": "_file", "part": "_part"})
        keyed = images.join(digests, (F.col("file") == F.col("_file")) & F.col("part").eqNullSafe(F.col("_part")))
    else:
        keyed = images.withColumn("content_sha", F.sha2("content", 256))
    own = keyed.select("passage_id", "image_ix", "mask", "content_sha", *_held(fetch))

    content = fetch or (lambda x: x)

    def over(batches):
        eyes, reads = detector(), reader()
        sha, seen, known = None, None, {}  # the image at hand, its bytes and boxes, its texts by mask
        for batch in batches:
            shas, masks, texts = batch.column("content_sha").to_pylist(), batch.column("mask").to_pylist(), [None] * batch.num_rows
            held = [batch.column(c) for c in _held(fetch)]
            first = [n for n, x in enumerate(shas) if x is not None and x != (shas[n - 1] if n else sha)]
            for k in range(0, max(len(first), 1), BATCH):
                part = first[k : k + BATCH]
                found = _detected({n: content(*(c[n].as_py() for c in held)) for n in part}, eyes)
                for n in range(part[0] if k else 0, first[k + BATCH] if k + BATCH < len(first) else len(shas)):
                    if shas[n] is None:
                        continue
                    if n in found:
                        sha, seen, known = shas[n], found[n], {}
                    if masks[n] not in known:
                        known[masks[n]] = _elected(*seen, masks[n], reads, top, enough, confidence)
                    texts[n] = known[masks[n]]
            yield pa.RecordBatch.from_arrays([batch.column("passage_id"), batch.column("image_ix"), pa.array(texts, pa.string())], ["passage_id", "image_ix", "ocr_text"])

    # images without bytes have no digest and are dealt out by their own place
    dealt = own.repartition(F.coalesce("content_sha", F.concat_ws("/", "passage_id", "image_ix"))).sortWithinPartitions("content_sha", "mask")
    return dealt.mapInArrow(over, own.select("passage_id", "image_ix").schema.add("ocr_text", "string"))


def _detected(contents: dict[int, bytes | None], detector: Detector) -> dict[int, tuple[bytes | None, list]]:
    """Images with their boxes, by their numbers; none of a null image."""
    own = {n: x for n, x in contents.items() if x is not None}
    found = dict(zip(own, detector.detect(list(own.values())), strict=True)) if own else {}
    return {n: (x, found.get(n, [])) for n, x in contents.items()}


def _elected(content: bytes | None, boxes: list, mask: str | None, reader: Reader, top: int, enough: float, confidence: float | None) -> str | None:
    """The text of an image with these boxes, as elect.top_boxes and elect.elected_text choose it; what follows a valid one is not read, if the reader reads on demand."""
    ranked = sorted(enumerate(boxes, 1), key=lambda b: (-b[1][4], b[0]))[:top]
    best, most = None, -1.0
    for _, (*corners, conf) in sorted(ranked):
        x1, y1, x2, y2 = map(int, corners)
        ratio = (x2 - x1) / max(y2 - y1, 1)
        if conf < elect.MIN_CONFIDENCE or not elect.LEAST_RATIO <= ratio <= elect.MOST_RATIO:
            continue
        for texts in reader.read(content, (x1, y1, x2, y2)):
            for raw, c in _joined(texts, confidence):
                text = plain.normalize(raw, mask)
                valid = plain.is_valid(text)
                if valid and c >= enough:
                    return text
                score = c + (5.0 if valid else 0.0) - 2.0 * abs(len(text) - 7)
                if text and score > most:
                    best, most = text, score
    return best


def read_until(images: DataFrame, detector: Callable[[], Detector], reader: Callable[[], Reader], stop: str = "distance", least: int = elect.MIN_MATCHES, top: int = 1, enough: float = 0.0, confidence: float | None = None, fetch: Fetcher | None = None) -> DataFrame:
    """(passage_id, image_ix, ocr_text, skipped) of images (passage_id, image_ix, mask, expected_plate, content or file and part), read until one is good enough.

    A passage's images are read in order, by one task, until a reading is at distance 0 (stop="distance") or has `least` matches
    (stop="matches"); the rest is skipped: neither fetched nor detected nor read. The evaluations do not count what comes after a stop, so they
    give the same for these rows as for those of `readings`. A task keeps the texts of its last images by content, so copies are read once there.
    With fetch no bytes are shuffled. Rows of equal place are taken in order of file and part; null contents are unread; no images: no rows.
    """
    if stop not in ("distance", "matches"):
        raise ValueError("stop is distance or matches")
    schema = "passage_id long, image_ix int, ocr_text string, skipped boolean"

    def over(frames):
        eyes, reads, known = detector(), reader(), {}
        passage, done = None, False
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.passage_id != passage:
                    passage, done = r.passage_id, False
                if done:
                    rows.append((r.passage_id, r.image_ix, None, True))
                    continue
                mask = r.mask if isinstance(r.mask, str) else None
                content = fetch(r.file, r.part) if fetch else None if r.content is None else bytes(r.content)
                text = None
                if content is not None:
                    key = hashlib.sha256(content).digest(), mask
                    if key not in known:
                        if len(known) >= KNOWN:
                            known.pop(next(iter(known)))
                        known[key] = _elected(*_detected({0: content}, eyes)[0], mask, reads, top, enough, confidence)
                    text = known[key]
                rows.append((r.passage_id, r.image_ix, text, False))
                if text and text.strip() and text != P.UNREAD:
                    plate = r.expected_plate if isinstance(r.expected_plate, str) else ""
                    own = plain.mask_of(plate)
                    expected, seen = plain.normalize(plate, own), plain.normalize(text, own)
                    done = plain.distance(expected, seen) == 0 if stop == "distance" else plain.matches(expected, seen) >= least
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    own = images.select(F.col("passage_id").cast("long").alias("passage_id"), F.col("image_ix").cast("int").alias("image_ix"), "mask", "expected_plate", *_held(fetch))
    order = ("passage_id", "image_ix", *(_REF if fetch else ()))
    return own.repartition("passage_id").sortWithinPartitions(*order).mapInPandas(over, schema)


def diagnostics(found: DataFrame) -> DataFrame:
    """boxes with width, height, ratio, the reason why a box is not used (null: it is), and whether it is."""
    w, h = F.col("x2").cast("int") - F.col("x1").cast("int"), F.col("y2").cast("int") - F.col("y1").cast("int")
    reason = elect.box_reason(F.col("conf"), w, h)
    return found.select("*", w.alias("width"), h.alias("height"), (w / F.greatest(h, F.lit(1))).alias("ratio"), reason.alias("reason"), reason.isNull().alias("accepted"))
