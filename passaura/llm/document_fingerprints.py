"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its lines (paragraphs). Each paragraph is hashed to a wide vector, and the
fingerprint is the sum of the vectors, lane by lane, modulo powers of two. So the order of paragraphs
does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector.
The first IDENTITY lanes, modulo 2**32, are the output of SHAKE-128 over the whole paragraph: equal
sums mean equal multisets. The LIKENESS lanes, modulo 2**32, hold for each pair of neighbouring words a
hashed +1 or -1 (no text is long enough to wrap them, even if it repeats one pair); the squared length of the difference of two fingerprints there estimates how
many word pairs the texts do not share, and with it their likeness.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, prepare, written

IDENTITY, LIKENESS = 16, 128
#: Rows of a stretch of the id order, within which neighbours are found.
STRETCH, MOST_STRETCHES = 1000, 50_000
_BASE, _CHUNK = 0x9E3779B97F4A7C15 | 1, 1 << 20
_POWERS: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _CHUNK + 1)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _pair_hashes(data: bytes) -> np.ndarray:
    """A hash for each pair of neighbouring words of a line; a line of one word: that word's; none: nothing."""
    words, lines, at, line = [], [], 0, 0
    while at < len(data):
        stop = min(at + _CHUNK, len(data))
        while stop < len(data) and data[stop] not in b" \t\n\v\f\r":
            stop += 1
        raw = np.frombuffer(data, np.uint8, stop - at, at)
        blank = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
        first, last = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        up, down = _powers(len(raw) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[: len(raw)])))
        words.append(_mixed((sums[last] - sums[first]) * down[first]))
        breaks = np.cumsum(raw == 10)
        lines.append(line + breaks[first])
        line, at = line + int(breaks[-1]), stop
    if not words:
        return np.zeros(0, np.uint64)
    w, n = np.concatenate(words), np.concatenate(lines)
    if not len(w):
        return w
    same = np.concatenate(([False], n[1:] == n[:-1], [False]))
    alone = w[~same[:-1] & ~same[1:]]
    return np.concatenate((alone, _mixed(w[:-1] + np.uint64(3) * w[1:])[same[1:-1]]))


def _signs(hashes: np.ndarray) -> np.ndarray:
    """The sum of the +1 and -1 lanes of these hashes, modulo 2**32."""
    ones, n = np.zeros(LIKENESS, np.int64), len(hashes)
    for k in range(0, n, 1 << 13):
        part = hashes[k : k + (1 << 13)]
        wide = np.stack((part, _mixed(part + np.uint64(0x632BE59BD9B4E019))), axis=1)
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1)
        for j in range(0, len(bits), 255):
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return (2 * ones - n).astype(np.uint32)


class Fingerprint:
    """A sum of paragraph vectors. Supports + and -, insert and delete, equality and likeness."""

    __slots__ = ("identity", "signs")

    def __init__(self, identity: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.identity = np.zeros(IDENTITY, np.uint32) if identity is None else identity
        self.signs = np.zeros(LIKENESS, np.uint32) if signs is None else signs

    @classmethod
    def of(cls, paragraphs: list[str]) -> Fingerprint:
        encoded = [x.encode() for x in paragraphs]
        if not encoded:
            return cls()
        wide = np.frombuffer(b"".join(hashlib.shake_128(x).digest(4 * IDENTITY) for x in encoded), "<u4").reshape(-1, IDENTITY)
        return cls(wide.sum(axis=0, dtype=np.uint32), _signs(_pair_hashes(b"\n".join(encoded))))

    @classmethod
    def from_bytes(cls, data: bytes) -> Fingerprint:
        return cls(np.frombuffer(data, "<u4", IDENTITY).astype(np.uint32), np.frombuffer(data, "<u4", LIKENESS, 4 * IDENTITY).astype(np.uint32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.identity + other.identity, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.identity - other.identity, self.signs - other.signs)

    def insert(self, paragraph: str) -> Fingerprint:
        return self + Fingerprint.of([paragraph])

    def delete(self, paragraph: str) -> Fingerprint:
        return self - Fingerprint.of([paragraph])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bytes(self) == bytes(other)

    def __hash__(self) -> int:
        return hash(bytes(self))

    def __bytes__(self) -> bytes:
        return self.identity.astype("<u4").tobytes() + self.signs.astype("<u4").tobytes()

    def hex(self) -> str:
        return bytes(self).hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints; else one less the estimated share of word pairs that differ, at least 0."""
        if self == other:
            return 1.0
        a, b, d = (float((x.astype(np.int32).astype(np.float64) ** 2).sum()) for x in (self.signs, other.signs, self.signs - other.signs))
        return max(0.0, 1.0 - d / (a + b)) if a + b else 0.0


def paragraphs_of(text: str | None) -> list[str]:
    """The lines of a text, empty ones too; an empty or null text has none."""
    return text.split("\n") if text else []


def fingerprint_column(text):
    """The fingerprint of a text column, as bytes."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([bytes(Fingerprint.of(paragraphs_of(x))) for x in texts.to_pylist()], pa.binary())

    return of.asNondeterministic()(text)


def merged(prints: DataFrame, by: list[str], column: str = "fingerprint") -> DataFrame:
    """Sums of fingerprints by group: those of the union of the groups' paragraphs.

    Lanes are summed in the JVM with partial aggregation, so a hot group is added up where it lies.
    Null fingerprints count as empty.
    """
    hexed = F.hex(column)
    lanes = range(IDENTITY + LIKENESS)
    swapped = lambda at: F.concat(*(F.substring(hexed, at + i + 1, 2) for i in (6, 4, 2, 0)))  # noqa: E731  little-endian
    sums = [F.pmod(F.coalesce(F.sum(F.conv(swapped(8 * k), 16, 10).cast("long")), F.lit(0)), F.lit(1 << 32)).alias(f"l{k}") for k in lanes]
    out = prints.groupBy(*by).agg(*sums)
    back = lambda k: [F.substring(F.lpad(F.hex(f"l{k}"), 8, "0"), i + 1, 2) for i in (6, 4, 2, 0)]
    return out.select(*by, F.unhex(F.concat(*(x for k in lanes for x in back(k)))).alias(column))


def _bounds(docs: DataFrame, key: str) -> tuple[list[int], dict[int | None, int]]:
    """Keys that cut the ascending order into stretches of about STRETCH rows, and into how many stretches one hot key (or null) falls.

    There are about MOST_STRETCHES at most.
    """
    n = docs.count()
    nulls = docs.where(F.col(key).isNull()).count()
    pieces = min(MOST_STRETCHES, -(-n // STRETCH))
    if pieces < 2:
        return [], {}
    size = n / pieces
    steps = max(1, int((n - nulls) / size))
    at = docs.approxQuantile(key, [k / steps for k in range(1, steps)], 0.1 / steps) if steps > 1 else []
    found = sorted(int(x) for x in at)
    parts: dict[int | None, int] = {x: found.count(x) + 1 for x in found if found.count(x) > 1}
    if nulls > size:
        parts[None] = -(-nulls // int(size))
    return sorted(set(found)), parts


def in_stretches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, stretch, lent) dealt out and sorted so that each row is followed by the next one.

    Rows are in descending order of key, null keys last; of equal keys in order of a hash of the text. A key that
    fills several stretches is cut by that hash, so no task holds more than its stretches, and texts move once; only
    rows that are alike in key and text stay together. The first row of each stretch is lent to the stretch before
    (that of the first to the last), where it comes at the end.
    """
    spark = prepare(docs.sparkSession)
    ids = docs.select(named(key).cast("long").alias("k"), F.xxhash64(named(text)).alias("h"))
    cuts, parts = _bounds(ids, "k")
    # the stretches from the largest key down: of each run of keys between cuts, and of a hot key by its hash
    bounds = np.array(cuts, np.int64)
    hot = np.array(sorted(x for x in parts if x is not None), np.int64)
    wide = np.tile(np.array([1, 0], np.int64), len(cuts) + 1)  # runs 2 j: keys up to cut j; 2 j + 1: the hot key of cut j, apart; last: null
    for x, n in parts.items():
        wide[-1 if x is None else 2 * int(np.searchsorted(bounds, x)) + 1] = n
    wide[-1] = max(1, wide[-1])
    order = [x for j in range(len(cuts), -1, -1) for x in ((2 * j + 1, 2 * j) if j < len(cuts) else (2 * j,))] + [len(wide) - 1]
    starts = np.zeros(len(wide), np.int64)
    starts[order] = np.concatenate(([0], np.cumsum(wide[order])[:-1]))

    def place(keys: pa.Array, hashes: pa.Array) -> np.ndarray:
        null = keys.is_null().to_numpy(zero_copy_only=False)
        k, h = keys.fill_null(0).to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        run = 2 * np.searchsorted(bounds, k) + np.isin(k, hot)
        run[null] = len(wide) - 1
        part = ((h >> np.int64(40)) + (1 << 23)) * wide[run] >> 24  # hashes ascend with their part
        return (starts[run] + part).astype(np.int32)

    @F.arrow_udf("int")
    def stretch(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(place(keys, hashes))

    first = F.min(F.struct(F.col("k").isNull().alias("none"), (-F.col("k")).alias("k"), "h")).alias("first")
    heads = written(ids.select("k", "h", stretch(F.col("k"), F.col("h")).alias("s")).groupBy("s").agg(first), "stretch-heads").orderBy("s").collect()
    before = {(None if r["first"]["none"] else -r["first"]["k"], r["first"]["h"]): heads[i - 1]["s"] for i, r in enumerate(heads)}

    @F.arrow_udf("array<int>")
    def stretches(keys: pa.Array, hashes: pa.Array) -> pa.Array:
        own = place(keys, hashes).tolist()
        lent = map(before.get, zip(keys.to_pylist(), hashes.to_pylist(), strict=True))
        return pa.array([[s] if x is None else [s, x] for s, x in zip(own, lent, strict=True)], pa.list_(pa.int32()))

    rows = docs.select(named(key).cast("long").alias("key"), named(text).alias("text"))
    rows = rows.withColumn("s", stretches.asNondeterministic()(F.col("key"), F.xxhash64("text")))
    rows = rows.select("key", "text", F.posexplode("s").alias("lent", "stretch"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stretch")
    return dealt.sortWithinPartitions("stretch", "lent", F.desc_nulls_last("key"), F.xxhash64("text"))


def against_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last third (code points, rounded down) replaced by as many of the first code
    points of the text that follows in descending order of key, all of them if it has fewer; after the
    last comes the first. Its fingerprint is made from the text's own by deleting the paragraphs from
    the cut on and inserting the new ones. Null texts are empty; the key must be an integer, null ones come last, and
    rows of equal key follow each other in order of a hash of their texts; repeated rows come out as often as they go
    in; long texts are taken whole; other columns are ignored; an empty table gives no rows.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def result(key, text: str, own: Fingerprint, after: str, other: Fingerprint) -> tuple:
        k = len(text) // 3
        cut = len(text) - k
        edited, changed = text, own
        if k:
            edited = text[:cut] + after[:k]
            line = text.rfind("\n", 0, cut) + 1
            changed = own - Fingerprint.of(text[line:].split("\n")) + Fingerprint.of(edited[line:].split("\n"))
        return key, len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes(own), bytes(changed), own.likeness(changed), own.likeness(other)

    def over(batches):
        held = None  # the last row that waits for the one after it
        for batch in batches:
            rows = []
            for key, text, lent, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                now = (key, text, Fingerprint.of(paragraphs_of(text)))
                if held:
                    rows.append(result(*held, *now[1:]))
                held = None if lent else now
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    ready = in_stretches(docs, key, text)
    return ready.mapInArrow(over, "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")
