"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within `radius` bits are linked; a document's class is the set it reaches over links.
The comparison is exact and complete. Two fingerprints that differ in at most r of 64 bits agree on
b - r of any b blocks of bits, so every pair meets in the bucket of one choice of blocks; b follows
from the number of fingerprints and changes only the work, never the result. A bucket is a run of
tiles in order of population count; tile pairs are compared with exclusive-or and bit counts, and a
pair of tiles is skipped if the counts differ by more than the radius, as each differing bit moves
the count by one at most. Buckets over `tile` rows are dealt out as tile pairs to many tasks.
Links never leave a task as pairs: each task returns a spanning star of what it has joined.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, named, prepare, spread_join, written

WIDTH, RADIUS, TILE = 4, 4, 4096
_SUB = 256


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, repeats included; fewer words make one run."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half the hashes; no words: 0. Signed, as Spark's long."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for j in range(0, len(bits), 255):  # a byte holds the sum of 255 bits
            ones += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprint_column(text, width: int = WIDTH):
    """The fingerprint of a text column, as a long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x, width) for x in texts.to_pylist()], pa.int64())

    return of.asNondeterministic()(text)


def block_masks(rows: int, radius: int, tile: int) -> list[int]:
    """Masks of block choices such that any two words within the radius agree under one of them.

    The number of blocks grows until a random bucket stays under a quarter of a tile.
    """
    b = radius + 1
    while b < 16 and rows / 2 ** (64 * (b - radius) / b) > tile / 4:
        b += 1
    edges = [round(64 * k / b) for k in range(b + 1)]
    blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(b)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(x)) for x in combinations(blocks, b - radius)]


def tile_roots(words: np.ndarray, radius: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each word the smallest position that it reaches over links within the radius.

    With `side`, only words of different sides are compared (the pair of two tiles).
    """
    counts = np.bitwise_count(words)
    order = np.argsort(counts, kind="stable")
    w, c = words[order], counts[order].astype(np.int64)
    s = None if side is None else side[order]
    parent = list(range(len(w)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    labels = np.arange(len(w))
    for i in range(0, len(w), _SUB):
        a = slice(i, i + _SUB)
        for j in range(i, len(w), _SUB):
            b = slice(j, j + _SUB)
            if c[j] - c[min(i + _SUB, len(w)) - 1] > radius:
                break
            near = np.bitwise_count(w[a, None] ^ w[None, b]) <= radius
            if s is not None:
                near &= s[a, None] != s[None, b]
            x, y = np.nonzero(near)
            x, y = labels[i + x], labels[j + y]
            keep = x != y
            if keep.any():
                pairs = np.unique(np.minimum(x, y)[keep] * len(w) + np.maximum(x, y)[keep])
                for p, q in zip((pairs // len(w)).tolist(), (pairs % len(w)).tolist(), strict=True):
                    p, q = root(p), root(q)
                    parent[max(p, q)] = min(p, q)
                labels = np.fromiter(map(root, range(len(w))), np.int64, len(w))
    out = np.empty(len(w), np.int64)
    out[order] = order[labels]
    return out


def _compare(radius: int):
    """Over rows sorted by group: (fp, root fp) of each fingerprint joined to another of its group."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(words: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = tile_roots(words.view(np.uint64), radius, side if side.any() else None)
        moved = at != np.arange(len(at))
        return words[moved], words[at[moved]]

    def over(batches):
        held: list[tuple] = []  # batches from the start of the last group on
        for batch in batches:
            if not batch.num_rows:
                continue
            g, words, side = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            held.append((g, words, side))
            if held[0][0][0] == g[-1]:
                continue
            g, words, side = (np.concatenate(x) for x in zip(*held, strict=True))
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            found = [stars(words[p:q], side[p:q]) for p, q in zip([0, *cuts[:-1]], cuts, strict=True) if q - p > 1]
            last = cuts[-1]
            held = [(g[last:], words[last:], side[last:])]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.record_batch([a, b], schema=out)
        if held:
            _, words, side = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(words) > 1:
                a, b = stars(words, side)
                yield pa.record_batch([a, b], schema=out)

    return over


def links(words: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Spanning stars (a, b) of the links among the distinct fingerprints `fp` of words."""
    spark = words.sparkSession
    masks = block_masks(words.count(), radius, tile)
    choices = F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)))
    dealt = words.select("fp", F.explode(choices).alias("x")).select("fp", "x.k", "x.v")
    hot = written(dealt.groupBy("k", "v").count().where(F.col("count") > tile).select("k", "v"), "hot-buckets")
    group = F.xxhash64("k", "v").alias("g")  # equal hashes of two buckets only add comparisons
    cold = dealt.join(hot, ["k", "v"], "left_anti").select(group, "fp", F.lit(0).alias("side"))
    if not hot.isEmpty():
        inner = dealt.join(hot, ["k", "v"]).withColumn("c", F.bit_count("fp"))
        sizes = inner.groupBy("k", "v", "c").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("n"))
        tiled = inner.join(sizes, ["k", "v", "c"]).select("k", "v", "c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("s"), "fp")
        tiles = sizes.select("k", "v", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
        left, right = (tiles.select("k", "v", F.col("c").alias(f"c{i}"), F.col("s").alias(f"s{i}")) for i in (0, 1))
        near = (F.col("c1") - F.col("c0")).between(0, radius) & ((F.col("c0") < F.col("c1")) | (F.col("s0") <= F.col("s1")))
        pairs = left.join(right, ["k", "v"]).where(near).withColumn("g", F.xxhash64("k", "v", "c0", "s0", "c1", "s1"))
        same = (F.col("c0") == F.col("c1")) & (F.col("s0") == F.col("s1"))
        first = pairs.select("k", "v", F.col("c0").alias("c"), F.col("s0").alias("s"), "g", F.lit(0).alias("side"))
        second = pairs.where(~same).select("k", "v", F.col("c1").alias("c"), F.col("s1").alias("s"), "g", F.lit(1).alias("side"))
        cold = cold.unionByName(tiled.join(first.unionByName(second), ["k", "v", "c", "s"]).select("g", "fp", "side"))
    ready = cold.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g").sortWithinPartitions("g")
    return ready.mapInArrow(_compare(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b); root is the smallest node it reaches.

    Alternates large and small stars, each a grouped minimum and a join, and cuts the lineage after
    each round with a written table. Ends when a round changes nothing, after about log n rounds.
    """
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n")), "stars")
        large = spread_join(both, least, "a", rows="n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large.distinct(), "links")
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "stars")
        small = spread_join(large, least, "a", rows="n").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classed(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row of docs, and (fp, root, component_id, keeper) of each fingerprint.

    root names the class; component_id is its smallest id, and keeper the fingerprint of the row that has it.
    """
    own = written(docs.select(named(id_col).alias("doc_id"), fingerprint_column(named(text_col), width).alias("fp")), "fingerprints")
    words = written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    found = components(links(words.select("fp"), radius, tile))
    rooted = written(words.join(found, words.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "classes")
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("fp").alias("fp"))).alias("first")
    smallest = written(rooted.groupBy("root").agg(first, F.count("*").alias("n")), "class-ids")
    joined = spread_join(rooted.select("fp", "root"), smallest, "root", rows="n")
    return own, written(joined.select("fp", "root", F.col("first.id").alias("component_id"), F.col("first.fp").alias("keeper")), "class-members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs; component_id is the smallest id reachable.

    Null and wordless texts have fingerprint 0 and link like any other. Repeated rows come out as
    often as they go in. Rows with a null id belong to their class, whose id is the smallest that is
    not null (null if all are). Other columns are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    own, classes = _classed(docs, id_col, text_col, width, radius, tile)
    return spread_join(own, classes.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """The rows of docs that stay: one of each class, that of the smallest id; of rows with that id one.

    All columns are kept as they are. Rows without an id come after those with one: they stay only if no row of
    their class has one, and then one of them does. Null and empty texts are one class. An empty table stays empty.
    """
    prepare(docs.sparkSession)
    _, classes = _classed(docs, id_col, text_col, width, radius, tile)
    own, key, fp, n = (fresh(docs, x) for x in ("own_fp", "stay_id", "stay_fp", "copy_n"))
    stay = classes.where("fp = keeper").select(F.col("component_id").alias(key), F.col("fp").alias(fp))
    keyed = docs.withColumn(own, fingerprint_column(named(text_col), width))
    joined = keyed.join(stay, named(id_col).eqNullSafe(F.col(key)) & (F.col(own) == F.col(fp)), "left_semi")
    one = Window.partitionBy(named(id_col), F.col(own)).orderBy(F.xxhash64(named(text_col)))  # limited to one before the shuffle, too
    return joined.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*(named(c) for c in docs.columns))
