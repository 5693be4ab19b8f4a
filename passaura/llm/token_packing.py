"""Token ids in packed fixed-width rows.

Documents become token ids, ids longer than a row are split without loss into whole rows and a rest, and the
pieces are packed by best-fit decreasing: longest first, each into the fullest row that still takes it.
A segment tree over remaining capacities finds that row. A packed row has its ids padded to the width (a row
of the id matrix, little-endian), the cumulative lengths of its segments, the position ids, which begin at 0
in each segment, and the document and offset that each segment is from.

`packed`: a task packs the documents of its own partition, block by block, so nothing is shuffled, and memory holds one
block. A block leaves at most a few part-filled rows.

`packed_globally`: one plan for all rows, whatever the partitions and files. Pieces of equal length are alike to the plan, so it is made from the counts of
lengths (at most as many as a row is wide) and says which rows take which ranks of each length; a piece's rank follows from counts of
buckets by a hash. Token ids go through two shuffles, those of whole rows through none.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe
from .common import named, prepare, written

#: Ids of a row, tokens of a block.
WIDTH, BLOCK = 2048, 1 << 21


class Tokenizer:
    """Ids of a vocabulary as numbers of two bytes, four if it needs them, and one beyond it to pad with."""

    def __init__(self, vocabulary: byte_bpe.Vocabulary):
        self.vocabulary = vocabulary
        self.pad = vocabulary.size
        self.dtype = np.dtype("<u2" if self.pad < 1 << 16 else "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        return np.array(self.vocabulary.encode(text), self.dtype) if text else np.zeros(0, self.dtype)


class CapacityTree:
    """Rows by remaining capacity under a segment tree that finds the least capacity not below a length."""

    def __init__(self, width: int):
        self.size = 1
        while self.size < width + 1:
            self.size *= 2
        self.rows: list[deque[int]] = [deque() for _ in range(width + 1)]
        self.some = bytearray(2 * self.size)

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.size + capacity
        while node and not self.some[node]:
            self.some[node] = 1
            node //= 2

    def take(self, length: int) -> tuple[int, int] | None:
        """A row of the least capacity that holds length, the first put of equals, and its capacity; None if there is none."""
        node = self.size + length
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.size
        row = self.rows[capacity].popleft()
        if not self.rows[capacity]:
            self.some[node] = 0
            node //= 2
            while node and not (self.some[2 * node] or self.some[2 * node + 1]):
                self.some[node] = 0
                node //= 2
        return row, capacity


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers, longest pieces first, the earlier of equals first."""
    tree, rows = CapacityTree(width), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[k]
        found = tree.take(n)
        if found:
            row, capacity = found
            rows[row].append(k)
        else:
            row, capacity = len(rows), width
            rows.append([k])
        if capacity > n:
            tree.put(capacity - n, row)
    return rows


_SCHEMA = pa.schema([("ids", pa.binary()), ("n_ids", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])
SCHEMA = "ids binary, n_ids int, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, offsets array<long>"


def packed_block(docs: list[tuple[object, np.ndarray]], width: int, pad: int, dtype: np.dtype) -> pa.RecordBatch:
    """The packed rows of some documents (id, token ids)."""
    pieces = [(d, at, ids[at : at + width]) for d, ids in docs for at in range(0, len(ids), width)]
    return packed_rows([[pieces[k] for k in row] for row in best_fit_decreasing([len(x[2]) for x in pieces], width)], width, pad, dtype)


def packed_rows(rows: list[list[tuple[object, int, np.ndarray]]], width: int, pad: int, dtype: np.dtype) -> pa.RecordBatch:
    """Rows of pieces (id, offset, token ids) as SCHEMA."""
    columns: list[list] = [[] for _ in _SCHEMA]
    for own in rows:
        ids = np.full(width, pad, dtype)
        positions = np.zeros(width, "<u2" if width <= 1 << 16 else "<u4")
        ends = np.cumsum([0] + [len(x[2]) for x in own])
        for (_, _, x), at in zip(own, ends, strict=False):
            ids[at : at + len(x)] = x
            positions[at : at + len(x)] = np.arange(len(x))
        for column, value in zip(columns, (ids.tobytes(), int(ends[-1]), ends.tolist(), positions.tobytes(), [x[0] for x in own], [x[1] for x in own]), strict=True):
            column.append(value)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def packed(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Packed rows of docs: SCHEMA. ids are `width` little-endian numbers of two bytes (four if the vocabulary needs it).

    Unused places at the end of a row hold the pad id, one beyond the vocabulary, and position 0; n_ids says how
    many are used. Ids of documents are integers, null ones stay null. Null and empty texts have no segment; long ones
    are read whole in time by their length, whatever they are made of (see byte_bpe for runs of white space), and split into rows;
    repeated rows are packed as often as they come; other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def over(batches):
        tokenizer = Tokenizer(byte_bpe.vocabulary(shared.value))
        held, n = [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text)
                if not len(ids):
                    continue
                held.append((i, ids))
                n += len(ids)
                if n >= block:
                    yield from pieces(held, tokenizer)
                    held, n = [], 0
        if n:
            yield from pieces(held, tokenizer)

    def pieces(held, tokenizer):
        out = packed_block(held, width, tokenizer.pad, tokenizer.dtype)
        for k in range(0, out.num_rows, 256):
            yield out.slice(k, 256)

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(over, SCHEMA)


def planned(counts: dict[int, int], width: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The rows of best-fit decreasing for so many pieces of each length: segments (length, first rank, rows, times, first row), and the number of rows.

    A segment's pieces, from its first rank on, go to its rows from the first on, `times` to each. Rows of equal room are taken in their order, by runs: a
    row that takes a piece and has room for another takes that too, as none has less room that suffices.
    """
    runs: dict[int, deque[tuple[int, int]]] = {}  # by room: (first row, rows)
    rooms: list[int] = []
    segments, made = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = deque()
                bisect.insort(rooms, room)
            runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            begun = k < len(rooms)
            if begun:
                room = rooms[k]
                first, n = runs[room].popleft()
            else:
                room, first, n = width, made, -(-left // (width // length))
                made += n
            times = room // length
            full, rest = min(n, left // times), 0
            put(room - times * length, first, full)
            if full:
                segments.append((length, rank, full, times, first))
            left, rank = left - full * times, rank + full * times
            if full < n and left:
                rest = left
                segments.append((length, rank, 1, rest, first + full))
                put(room - rest * length, first + full, 1)
                left, full = 0, full + 1
            if begun and full < n:
                runs[room].appendleft((first + full, n - full))
            elif begun and not runs[room]:
                del runs[room]
                rooms.remove(room)
    return segments, made


_PIECES = "id long, offset long, length int, digest binary, ids binary"
#: Pieces of a bucket, about.
BUCKET = 20_000


def packed_globally(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """As `packed`, by one plan for all of docs: SCHEMA. The rows are the same for any partitions and files of docs.

    Pieces of equal length are ranked by a bucket of a hash, id, offset and a digest of their ids. Rows full of one long document come first from it and are not
    shuffled. Null ids stay null and come last in their bucket; repeated rows are packed as often as they come, and do not matter to each other.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def cut(batches):
        tokenizer = Tokenizer(byte_bpe.vocabulary(shared.value))
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text)
                for at in range(0, len(ids), width):
                    own = ids[at : at + width].tobytes()
                    out.append((i, at, len(own) // tokenizer.dtype.itemsize, hashlib.blake2b(own, digest_size=16).digest(), own))
            for k in range(0, len(out), 1000):
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[k : k + 1000], strict=True), kinds, strict=True)], names=["id", "offset", "length", "digest", "ids"])

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    pieces = written(rows.mapInArrow(cut, _PIECES), "packing-pieces")
    counts = {r["length"]: r["n"] for r in pieces.where(F.col("length") < width).groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    segments, _ = planned(counts, width)
    buckets = max(1, sum(counts.values()) // BUCKET)
    part = pieces.where(F.col("length") < width).withColumn("bucket", F.pmod(F.xxhash64("id", "offset", "digest"), F.lit(buckets)))
    starts = part.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(F.col("id").asc_nulls_last(), "offset", "digest"))
    ranked = part.withColumn("place", place).join(starts, ["length", "bucket"]).withColumn("rank", F.col("start") + F.col("place") - 1)
    plan = F.broadcast(spark.createDataFrame(segments or [(0, 0, 0, 1, 0)], "length int, first long, n long, times long, row long"))  # a few for each length
    own = ranked.join(plan, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n") * F.col("times")))
    own = own.withColumn("row", (F.col("row") + F.floor((F.col("rank") - F.col("first")) / F.col("times"))).cast("long")).select("row", "length", "rank", "id", "offset", "ids")

    def assembled(batches):
        tokenizer = Tokenizer(byte_bpe.vocabulary(shared.value))
        held, row, done = [], None, []
        for b in batches:
            for r, _, _, i, at, ids in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if r != row or r is None:
                    if held:
                        done.append(held)
                    held, row = [], r
                    if len(done) >= 256:
                        yield packed_rows(done, width, tokenizer.pad, tokenizer.dtype)
                        done = []
                held.append((i, at, np.frombuffer(ids, tokenizer.dtype)))
        if held:
            done.append(held)
        if done:
            yield packed_rows(done, width, tokenizer.pad, tokenizer.dtype)

    whole = pieces.where(F.col("length") == width).select(F.lit(None).cast("long").alias("row"), "length", F.lit(0).cast("long").alias("rank"), "id", "offset", "ids")
    met = own.repartition("row").sortWithinPartitions("row", F.desc("length"), "rank")
    return whole.mapInArrow(assembled, SCHEMA).unionByName(met.mapInArrow(assembled, SCHEMA))


def unpacked(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, offset, ids array<long>) of each segment of packed rows: what packing was given, for checks and reading back.

    Null doc_ids stay null; a long document comes back in its segments; repeated rows as often as they come; an empty table gives no rows.
    """

    def over(batches):
        for b in batches:
            out = []
            for ids, cu, docs, offsets in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                row = np.frombuffer(ids, "<u2" if len(ids) == 2 * width else "<u4")
                out += [(d, o, row[p:q].tolist()) for d, o, p, q in zip(docs, offsets, cu, cu[1:], strict=False)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))], names=["doc_id", "offset", "ids"])

    return rows.select("ids", "cu_seqlens", "doc_ids", "offsets").mapInArrow(over, "doc_id long, offset long, ids array<long>")


def write_packed(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: each file's `ids` column, end to end, is an id matrix of the given width; what path held goes."""
    rows.write.mode("overwrite").parquet(path)
