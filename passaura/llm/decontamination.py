"""Benchmark decontamination: a broadcast hash set of test n-grams held against every document.

Words are runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII. A window is `width`
consecutive words of an item; a shorter item is one window. A document word inside any occurrence of
a window is hit. Windows are looked up by a rolling hash and each find is verified word by word.
Equal items count once, and an item of over `block_chars` characters is cut into parts that overlap by all but one
word of a window. The benchmark is sent to the workers in blocks of about `block_chars` characters (dealt by hash), so no
broadcast grows with it. One block is the usual case: documents are read once and nothing is shuffled. With more,
each is held against the documents, and what it hits is kept as a narrow table of text hashes, items and places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, prepare, spread_join, written

WIDTH, BLOCK_CHARS = 13, 4_000_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # A-Z too: texts are not folded where spans are cut
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; folding bytes keeps UTF-8 sequences whole, as all their bytes are over 127."""
    return (text or "").encode().translate(_FOLD).split()


class WindowIndex:
    """The windows of some benchmark items, by length: sorted hashes and where each window starts."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        self.names, ids, owner, starts = [], [], [], {}
        for name, text in items:
            own = words_of(text)
            if not own:
                continue
            length = min(width, len(own))
            starts.setdefault(length, []).extend(range(len(ids), len(ids) + len(own) - length + 1))
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own]
            owner += [len(self.names)] * len(own)
            self.names.append(None if name is None else str(name))
        self.ids, self.owner = np.array(ids, np.uint64), np.array(owner, np.int32)
        self.windows = {}
        for length, at in starts.items():
            at = np.array(at, np.int64)
            h = self._hash(self.ids, at, length)
            order = np.argsort(h, kind="stable")
            self.windows[length] = (h[order], at[order])

    @staticmethod
    def _hash(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(length):
            h = (h + ids[at + k]) * _MULT
            h ^= h >> np.uint64(29)
        return h

    def find(self, ids: np.ndarray):
        """(start, length, item number) of each occurrence in ids; 0 stands for a word no item has."""
        gaps = np.concatenate(([0], np.cumsum(ids == 0)))
        for length, (hashes, at) in self.windows.items():
            if len(ids) < length:
                continue
            p = np.flatnonzero(gaps[length:] == gaps[:-length])
            if not len(p):
                continue
            h = self._hash(ids, p, length)
            k = np.searchsorted(hashes, h)
            seen = hashes[np.minimum(k, len(hashes) - 1)] == h
            for p, k, h in zip(p[seen].tolist(), k[seen].tolist(), h[seen], strict=True):
                while k < len(hashes) and hashes[k] == h:
                    if np.array_equal(ids[p : p + length], self.ids[at[k] : at[k] + length]):
                        yield p, length, self.owner[at[k]]
                    k += 1


class _Ids(dict):
    def __missing__(self, word):
        return 0


_FOUND = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<first:int,last:int,begin:int,stop:int>>>"
_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "begin", "stop")])))])


def scan(texts: list[str | None], before: list[dict | None], index: WindowIndex) -> list[dict]:
    """What each text has of the index, added to what earlier blocks found."""
    each = [words_of(x) for x in texts]
    lengths = np.array([len(x) for x in each], np.int64)
    flat: list[bytes] = []
    for own in each:
        flat += own
        flat.append(b"")  # between texts: no window runs over it
    ids = np.fromiter(map(_Ids(index.vocabulary).__getitem__, flat), np.uint64, len(flat))
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    hit, items = np.zeros(len(flat) + 1, np.int64), {}
    for p, length, item in index.find(ids):
        hit[p] += 1
        hit[p + length] -= 1
        items.setdefault(int(np.searchsorted(first, p, "right")) - 1, set()).add(item)
    for k, x in enumerate(before):
        for s in x["spans"] if x else ():
            hit[first[k] + s["first"]] += 1
            hit[first[k] + s["last"]] -= 1
            items.setdefault(k, set())
    covered = np.cumsum(hit) > 0
    out = []
    for k, text in enumerate(texts):
        x = {"n_words": int(lengths[k]), "n_hit": 0, "items": before[k]["items"] if before[k] else [], "spans": []}
        if k in items:
            own = covered[first[k] : first[k] + lengths[k]].astype(np.int8)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own, [0]))))
            at = [m.span() for m in _WORD.finditer(text)]
            x["n_hit"] = int(own.sum())
            x["spans"] = [{"first": int(a), "last": int(b), "begin": at[a][0], "stop": at[b - 1][1]} for a, b in edges.reshape(-1, 2)]
            x["items"] = sorted({*x["items"], *(index.names[i] for i in items[k] if index.names[i] is not None)})
        out.append(x)
    return out


def _look(shared):
    """A column of what texts have of the shared index, added to what a second column says was found before."""

    @F.arrow_udf(_FOUND)
    def look(texts: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array(scan(texts.to_pylist(), before.to_pylist(), shared.value), _TYPE)

    return look.asNondeterministic()


def parts_of(text: str, width: int, block_chars: int) -> list[str]:
    """A text as it is, or if it is over-long its words in parts of about block_chars characters with the same windows."""
    if len(text) <= block_chars:
        return [text]
    own, out, first = words_of(text), [], 0
    while first < len(own):
        last, size = first, 0
        while last < len(own) and (size < block_chars or last - first < width):
            size += len(own[last]) + 1
            last += 1
        out.append(b" ".join(own[first:last]).decode())
        if last == len(own):
            break
        first = last - width + 1
    return out


def item_parts(benchmark: DataFrame, item_col: str, text_col: str, width: int, block_chars: int) -> DataFrame:
    """(i, t) of the benchmark's items: equal ones once, over-long ones in parts, null texts left out."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([parts_of(x, width, block_chars) for x in texts.to_pylist()], pa.list_(pa.string()))

    items = benchmark.select(named(item_col).alias("i"), named(text_col).alias("t")).where("t is not null").distinct()
    return written(items.select("i", F.explode(cut.asNondeterministic()(F.col("t"))).alias("t")).distinct(), "benchmark-parts")


def _hits(docs: DataFrame, text: str, shared) -> DataFrame:
    """(text_key, items, spans, n) of the distinct texts that a block hits."""
    key = F.struct(F.xxhash64(named(text)).alias("a"), F.xxhash64(F.lit("b"), named(text)).alias("b"))
    found = docs.select(key.alias("text_key"), _look(shared)(named(text), F.lit(None).cast(_FOUND)).alias("found")).where("found.n_hit > 0")
    return written(found.groupBy("text_key").agg(F.first("found.items").alias("items"), F.first("found.spans").alias("spans"), F.count("*").alias("n")), "contamination")


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with a struct column: n_words, n_hit, items (sorted ids), spans of hit words.

    A span has word positions (first, last exclusive) and code point positions (begin, stop). The
    column is called `found`, with leading underscores if docs has that name already; it is the last.
    Null and empty texts have no words; long ones are taken whole. Items without words have no window; an item whose id
    is null hits words but is not listed. Repeated rows, on either side, change nothing for other rows. Empty documents
    stay empty, and an empty benchmark hits nothing.
    """
    spark = prepare(docs.sparkSession)
    name = fresh(docs, "found")
    items = item_parts(benchmark, item_col, item_text_col, width, block_chars)
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1

    def index(k: int) -> WindowIndex:
        return WindowIndex([tuple(x) for x in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()], width)

    if blocks == 1:
        return docs.withColumn(name, _look(spark.sparkContext.broadcast(index(0)))(named(text_col), F.lit(None).cast(_FOUND)))
    found = None
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(index(k))
        own = _hits(docs, text_col, shared)
        found = own if found is None else found.unionByName(own)
        shared.destroy()
    at = fresh(docs, "text_key")
    found = written(found.groupBy(F.col("text_key").alias(at)).agg(F.flatten(F.collect_list("items")).alias("i"), F.flatten(F.collect_list("spans")).alias("s"), F.max("n").alias("n")), "contamination")
    before = F.when(F.col("i").isNotNull(), F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.col("i").alias("items"), F.col("s").alias("spans")))
    n = fresh(docs, "text_rows")
    found = written(found.select(at, before.alias(name), F.col("n").alias(n)), "contamination")
    keyed = docs.withColumn(at, F.struct(F.xxhash64(named(text_col)).alias("a"), F.xxhash64(F.lit("b"), named(text_col)).alias("b")))
    nothing = spark.sparkContext.broadcast(WindowIndex([], width))
    joined = spread_join(keyed, found, at, "left", rows=n)
    return joined.select(*(named(c) for c in docs.columns), _look(nothing)(named(text_col), F.col(name)).alias(name))


def is_contaminated(found):
    """At least one hit word, and hit words are a twentieth of all words or more."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", **how) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit spans cut from them.

    Documents that are not contaminated stay as they are. A cut span leaves one space. Nulls, empty texts and
    tables, repeated rows and names as for `contamination`.
    """
    found = contamination(docs, benchmark, text_col, **how)
    name = found.columns[-1]
    if remove == "documents":
        return found.where(~is_contaminated(F.col(name))).drop(name)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            for s in reversed(own or ()):
                text = text[: s["begin"]] + " " + text[s["stop"] :]
            out.append(text)
        return pa.array(out, pa.string())

    spans = F.when(is_contaminated(F.col(name)), F.col(name)["spans"])
    return found.withColumn(text_col, cut(named(text_col), spans)).drop(name)
