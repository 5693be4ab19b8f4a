"""Substring deduplication: content-defined chunks nominate places, windows of words settle them.

A 32-bit gear hash rolls over the bytes of a text, so it depends on the last 32 bytes alone. A chunk ends
before a word where the hash's masked bits are zero: an insertion moves only the bounds near it, and a passage
is cut alike wherever it stands. Where SEQUENCE neighbouring chunks stand in another document too, a passage may
repeat. There each window of over_words + 1 words is compared by digest, with its white space: of all
occurrences of a window the first, in order of document id and place, is the original, and the words of the
others are removed. A window with too few bounds to hold SEQUENCE whole chunks, such as one word again and again, meets
its copies by its own digest. So what goes lies in a passage of over `over_words` words that stands as a whole at one
earlier place, all of the passage goes, and shorter repeats stay.
Words are runs between white space; a Chinese or Japanese character is a word by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, prepare, written
from .document_fingerprints import _mixed, _powers

#: A chunk ends before one in 2**BITS of the words.
BITS = 2
#: Passages over OVER_WORDS words go; they are looked for where SEQUENCE chunks in a row are shared.
OVER_WORDS, SEQUENCE = 50, 3
#: The masked bits of the hash, from SHIFT on, depend on the last REACH bytes.
SHIFT = 20
REACH = SHIFT + BITS
_BLOCK, _NO_ID = 1 << 19, 1 << 62
#: The code points of Chinese and Japanese characters, which are written without spaces.
_UNSPACED = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))


def _gear() -> np.ndarray:
    """256 random 32-bit words by a fixed rule: the digest of each byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([k]), 2024) & 0xFFFFFFFF for k in range(256)], np.uint32)


_GEAR = _gear()
_MIXED = _mixed(np.arange(1, 257, dtype=np.uint64))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' words, each shifted left by its distance, modulo 2**32."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def words_at(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start and end."""
    n = len(raw)
    blank = _BLANK[raw]
    new = ~blank
    new[1:] &= blank[:-1]
    if n and raw.max() > 0xE2:
        at = np.flatnonzero((raw > 0xE2) & (raw < 0xF0))
        code = (raw[at] & np.uint32(15)) << np.uint32(12) | (raw[at + 1] & np.uint32(63)) << np.uint32(6) | raw[at + 2] & np.uint32(63)
        three = at[np.logical_or.reduce([(code >= a) & (code <= b) for a, b in _UNSPACED])]
        four = np.flatnonzero(raw == 0xF0)
        four = four[(raw[four + 1] > 0x9F) & (raw[four + 1] < 0xC0)]  # from U+20000 on
        new[three] = new[four] = True
        after = np.concatenate((three + 3, four + 4))
        after = after[after < n]
        new[after[~blank[after]]] = True
    ends = ~blank
    ends[:-1] &= blank[1:] | new[1:]
    return np.flatnonzero(new), np.flatnonzero(ends) + 1


def bounds_of(raw: np.ndarray, starts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which of the words that start there a chunk ends before; never the first."""
    if not len(starts):
        return np.zeros(0, bool)
    out = (gear_hashes(raw)[starts - 1] >> np.uint32(SHIFT)) & np.uint32((1 << bits) - 1) == 0
    out[0] = False
    return out


def sequences_of(raw: np.ndarray, starts: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Where the chunks of a text end, and the digest (signed) of each SEQUENCE chunks in a row, or of all if there are fewer."""
    ends = np.append(starts[bound], len(raw))
    data, at, digest = raw.tobytes(), [0, *ends.tolist()], xxhash.xxh3_64_intdigest
    size = min(SEQUENCE, len(ends))
    return ends, [digest(data[a:b]) - (1 << 63) for a, b in zip(at, at[size:], strict=False)]


def windows_of(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, over_words: int = OVER_WORDS) -> np.ndarray:
    """The digest (signed) of each over_words + 1 words in a row, from the first's start to the last's end."""
    n = len(starts) - over_words
    if n <= 0:
        return np.zeros(0, np.int64)
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.take(_MIXED, raw, out=sums[1:])
    sums[1:] *= up[: len(raw)]
    np.cumsum(sums, out=sums)
    first, last = starts[:n], stops[over_words:]
    return _mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64)


def sparse(starts: np.ndarray, bound: np.ndarray, over_words: int = OVER_WORDS) -> np.ndarray:
    """The windows without SEQUENCE whole chunks that no text outside has a part in.

    The hash at a bound up to REACH bytes into a window sees what is before it, so such bounds do not count.
    """
    n = max(0, len(starts) - over_words)
    before = np.concatenate(([0], np.cumsum(bound)))
    own = np.searchsorted(starts, starts[:n] + REACH)
    end = np.arange(over_words + 1, over_words + 1 + n)
    return np.flatnonzero(before[end] - before[np.minimum(own, end)] <= SEQUENCE)


def met_by(text: str | None, bits: int = BITS, over_words: int = OVER_WORDS) -> list[int]:
    """The digests by which a text meets others that may share a passage: of sequences of chunks, and of sparse windows."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    starts, stops = words_at(raw)
    if len(starts) <= over_words:
        return []
    bound = bounds_of(raw, starts, bits)
    few = sparse(starts, bound, over_words)
    own = windows_of(raw, starts, stops, over_words)[few].tolist() if len(few) else []
    return sequences_of(raw, starts, bound)[1] + own


def nominated(text: str, shared: list[int], bits: int = BITS, over_words: int = OVER_WORDS) -> np.ndarray:
    """The distinct digests of the windows that lie where sequences of chunks are shared, and of the shared sparse ones.

    A shared passage reaches into the chunks beside its whole ones. Up to REACH bytes into it the hash still sees
    what is before it, so bounds may differ there; it may begin as many bytes before the chunk before.
    """
    raw, shared = np.frombuffer(text.encode(), np.uint8), np.array(shared, np.int64)
    starts, stops = words_at(raw)
    windows = windows_of(raw, starts, stops, over_words)
    if not len(windows):
        return windows
    bound = bounds_of(raw, starts, bits)
    ends, sequences = sequences_of(raw, starts, bound)
    hit = np.flatnonzero(np.isin(np.array(sequences, np.int64), shared))
    bounds = np.concatenate((np.zeros(2, np.int64), ends, ends[-1:]))  # of chunk k: from bounds[k + 1] to bounds[k + 2]
    size = min(SEQUENCE, len(ends))
    edge = np.zeros(len(ends) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + size, -1)
    flag = np.concatenate(([False], np.cumsum(edge[:-1]) > 0, [False]))
    take = np.zeros(len(windows), bool)
    for a, b in np.flatnonzero(np.diff(flag.astype(np.int8))).reshape(-1, 2).tolist():
        low = np.searchsorted(starts, bounds[a] - REACH)
        high = np.searchsorted(stops, bounds[b + 2], "right") - over_words
        take[low : max(low, high)] = True
    few = sparse(starts, bound, over_words)
    take[few[np.isin(windows[few], shared)]] = True
    return np.unique(windows[take])


def cut_text(text: str, copies: set[int], over_words: int = OVER_WORDS) -> tuple[str, int]:
    """The text without its repeated passages, and how many words went.

    A window is a copy if its digest is in copies or came before in the text. In the second case the words of
    the occurrence that came first stay, also where the two overlap.
    """
    data = text.encode()
    raw = np.frombuffer(data, np.uint8)
    starts, stops = words_at(raw)
    windows = windows_of(raw, starts, stops, over_words)
    n, size = len(windows), over_words + 1
    if not n:
        return text, 0
    _, first, which = np.unique(windows, return_index=True, return_inverse=True)
    at, origin = np.arange(n), first[which]
    known = np.isin(windows, np.fromiter(copies, np.int64, len(copies)))
    low = np.where(known, at, np.maximum(at, origin + size))
    hit = known | (origin < at)
    if not hit.any():
        return text, 0
    edge = np.bincount(low[hit], minlength=len(starts) + 1) - np.bincount(at[hit] + size, minlength=len(starts) + 1)
    flag = np.concatenate(([0], np.cumsum(edge)[:-1] > 0, [0])).astype(np.int8)
    bounds = [*starts.tolist(), len(data)]
    parts, done, gone = [], 0, 0
    for a, b in np.flatnonzero(np.diff(flag)).reshape(-1, 2).tolist():
        parts.append(data[done : bounds[a]])
        done, gone = bounds[b], gone + b - a
    parts.append(data[done:])
    return b"".join(parts).decode(), gone


_PAIRS = pa.schema([("digest", pa.int64()), ("id", pa.int64()), ("kind", pa.int8())])
_ONE, _COPY, _FIRST = 0, 1, 2


def _first_of_block(digests_of):
    """(digest, id, kind) of each distinct digest of a row, as digests_of makes them of the columns after the id.

    Kind: _COPY if a row with a smaller id in the same block has it, _FIRST if one with a greater id has it, else
    _ONE. Only the smallest id of a block needs to meet those of other blocks, so a digest that very many rows
    share comes to its task once for each block.
    """

    def flush(digests: list, ids: list):
        d, i = np.concatenate(digests), np.concatenate(ids)
        order = np.lexsort((i, d))
        d, i = d[order], i[order]
        new = np.concatenate(([True], d[1:] != d[:-1]))
        head = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        other = i != i[head]
        kind = np.where(other, _COPY, _ONE).astype(np.int8)
        kind[head[other]] = _FIRST
        use = new | other
        return pa.record_batch([d[use], i[use], kind[use]], schema=_PAIRS)

    def over(batches):
        digests, ids, n = [], [], 0
        for b in batches:
            for i, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = np.unique(np.array(digests_of(*row), np.int64))
                digests.append(own)
                ids.append(np.full(len(own), i, np.int64))
                n += len(own)
            if n >= _BLOCK:
                yield flush(digests, ids)
                digests, ids, n = [], [], 0
        if n:
            yield flush(digests, ids)

    return over


def _shared(owners: bool):
    """(id, digest) of the copies among rows sorted by digest and id; with owners, of those that are copied too."""
    out = pa.schema([("id", pa.int64()), ("digest", pa.int64())])

    def over(batches):
        last, owner, told = None, None, True
        for b in batches:
            if not b.num_rows:
                continue
            d, i, kind = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            # known copies lie anywhere among the rows: only the others say who comes first
            own = np.flatnonzero(kind != _COPY)
            use = kind == _COPY
            if len(own):
                dd, ii = d[own], i[own]
                start = np.concatenate(([last is None or dd[0] != last], dd[1:] != dd[:-1]))
                at = np.maximum.accumulate(np.where(start, np.arange(len(dd)), -1))
                first = np.where(at >= 0, ii[np.maximum(at, 0)], owner if owner is not None else 0)
                use[own] = ii != first
                if owners:
                    group = np.cumsum(start)  # 0: that of the last batch's end
                    copied = np.bincount(group, weights=(ii != first) | (kind[own] == _FIRST)) > 0
                    if copied[0] and not told:
                        yield pa.record_batch([np.array([owner], np.int64), np.array([last], np.int64)], schema=out)
                    use[own[np.flatnonzero(start)[copied[1:]]]] = True
                    told = bool(copied[-1] or len(copied) == 1 and told)
                last, owner = dd[-1], first[-1]
            if use.any():
                yield pa.record_batch([i[use], d[use]], schema=out)

    return over


def _met(rows: DataFrame, digests_of, owners: bool) -> DataFrame:
    """(id, shared): of each id that has any, the digests that a smaller id has too, or with owners that any other id has.

    rows are the id, what digests_of takes, and columns that it ignores. One shuffle of (digest, id) pairs, dealt out by digest; pairs already
    known to be copies go anywhere.
    """
    pairs = rows.mapInArrow(_first_of_block(digests_of), "digest long, id long, kind byte")
    key = F.when(F.col("kind") == _COPY, F.xxhash64("id", "digest")).otherwise(F.col("digest"))
    dealt = pairs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    found = dealt.sortWithinPartitions("digest", "id").mapInArrow(_shared(owners), "id long, digest long")
    return found.groupBy("id").agg(F.collect_set("digest").alias("shared"))


def _key(id_col: str, text_col: str) -> Column:
    """The id, or for null ids a number from _NO_ID on by the text."""
    return F.coalesce(named(id_col).cast("long"), F.lit(_NO_ID).bitwiseOR(F.shiftrightunsigned(F.xxhash64(named(text_col)), 2)))


def _shares(rows: DataFrame, bits: int, over_words: int) -> DataFrame:
    """(id, shared): what each of rows (id, text) may meet others by (met_by), so far as some other id has it too."""
    return _met(rows, lambda text: met_by(text, bits, over_words), True)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, over_words: int = OVER_WORDS, drop_emptied: bool = False) -> DataFrame:
    """docs with repeated passages cut from the text, and a last column `removed_words` (or `_removed_words`).

    The id is an integer below 2**62; the row with the smallest keeps what repeats. Rows of equal id count as one
    document: what only they share stays. Null ids come last, told apart by their texts, so equal texts
    without id count as one document. Null and empty texts stay as they are. Long texts are read whole. A text
    of which nothing but white space is left stays as that, or its row goes with drop_emptied. Other columns stay; an
    empty table stays empty.
    """
    prepare(docs.sparkSession)
    name = fresh(docs, "removed_words")
    places = written(_shares(docs.select(_key(id_col, text_col).alias("id"), named(text_col).alias("text")), bits, over_words), "shared-chunks")
    # Both joins take all columns of these rows (under plain names), so that Spark deals the texts out by id once for the two
    kept = {c: "text" if c == text_col else f"c{k}" for k, c in enumerate(docs.columns)}
    keyed = docs.select(_key(id_col, text_col).alias("id"), *(named(c).alias(x) for c, x in kept.items()))
    near = keyed.join(places.select(F.col("id").alias("at"), "shared"), F.col("id") == F.col("at"), "inner")
    near = near.select("id", "text", "shared", *(x for x in kept.values() if x != "text"))
    copies = _met(near, lambda text, shared, *_: nominated(text or "", shared, bits, over_words), False).select(F.col("id").alias("at"), "shared")

    @F.arrow_udf("struct<text:string,words:long>")
    def cut(texts: pa.Array, copies: pa.Array) -> pa.Array:
        texts, gone = texts.to_pylist(), []
        for k, own in enumerate(copies.to_pylist()):
            words = 0
            if texts[k]:
                texts[k], words = cut_text(texts[k], set(own or ()), over_words)
            gone.append(words)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["text", "words"])

    out = keyed.join(copies, F.col("id") == F.col("at"), "left").withColumn("cut", cut.asNondeterministic()(F.col("text"), F.col("shared")))
    if drop_emptied:
        out = out.where((F.col("cut.words") == 0) | F.col("cut.text").rlike(r"\S"))
    return out.select(*((F.col("cut.text") if x == "text" else F.col(x)).alias(c) for c, x in kept.items()), F.col("cut.words").alias(name))
