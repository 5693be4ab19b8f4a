"""How far the sources of a language differ in their words, by an index of corrections.

Each language keeps its V terms of enough documents. A group (language, source) has for each of them a smoothed
probability in whole billionths, p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), and two groups differ by the sum of
f(p, q) = floor((p - q)^2 / (p + q)) over all kept terms. All of it is in whole numbers, so it is exact and no order of sums matters.

Most counts are zero. Let p0 be a group's p for count 0. A pair starts at V * f(p0, q0), as if all counts were, and postings
of terms correct it:

* a term of the first group adds f(p, q0) - f(p0, q0), which depends on its count alone, so the group's postings are
  a short histogram of counts, and a pair meets histograms, not postings; the second group's terms likewise;
* a term of both adds what these two have got wrong together: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). Here alone
  postings of a term meet, and nothing is emitted where this is zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, named, prepare, spread_join, written

SCALE = 1_000_000_000
#: Documents of its language that a term needs; ranks of terms that are told.
MIN_DOCS, TOP = 10, 10
#: Groups of terms that a task counts before it hands them on; bytes of a text that are cut into words at once.
HELD, STRETCH = 200_000, 1 << 20
#: Pairs of a language are dealt out by so many shares of its sources.
SHARES = 16
#: Every byte that is no part of a term becomes a space; A-Z become small. Bytes from 128 on are parts of other characters.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, stretch by stretch: letters a-z and all characters beyond ASCII, A-Z as small ones; others stand between terms."""
    data, at = text.encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while at < len(data):
        stop = data.find(b" ", at + STRETCH) if at + STRETCH < len(data) else -1
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def _batches(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (occurrences, documents) in held.items():
        terms = list(occurrences)
        for at in range(0, len(terms), BATCH_ROWS * 20):
            own = terms[at : at + BATCH_ROWS * 20]
            columns = [[lang] * len(own), [source] * len(own), [x.decode("utf-8", "surrogatepass") for x in own], [occurrences[x] for x in own], [documents[x] for x in own]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=["lang", "source", "term", "n", "docs"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) from (lang, source, text): occurrences and documents of a term, to be summed over tasks and what a task hands on."""

    def over(batches):
        held, size = {}, 0
        for b in batches:
            for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(occurrences)
                own: set[bytes] = set()
                for words in words_of(text):
                    occurrences.update(words)
                    own.update(words)
                documents.update(own)
                size += len(occurrences)
                if size >= HELD:
                    yield from _batches(held)
                    held, size = {}, 0
        yield from _batches(held)

    return docs.mapInArrow(over, "lang string, source string, term string, n long, docs long")


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first): what a group has of the kept terms of its language.

    lang_n: occurrences in the language; first: true in one of a term's rows. Sums are made by group and term, then
    by term, so that a term that all tasks and groups have is many keys first and few rows after.
    """
    sums = counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = sums.select("*", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return sums.where(F.col("lang_docs") >= min_docs).drop("docs", "lang_docs")


def _div(a: Column, b: Column) -> Column:
    """floor(a / b) of whole a >= 0 and b > 0."""
    return F.call_function("div", a, b)


def _p(n: Column, total: Column, kept: Column) -> Column:
    """p of a count, where total is N and kept V; null if V is 0. In decimals, as a billion times a count can pass 64 bits."""
    whole = lambda x, digits: x.cast(f"decimal({digits},0)")
    return F.when(kept > 0, 1 + _div(whole(F.lit(SCALE), 10) * whole(n + 2, 19), whole(total + 2 * kept, 19)))


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); the square of two p's difference is within 64 bits."""
    return _div((p - q) * (p - q), p + q)


def _other(a: str, b: str) -> list[Column]:
    """An unordered pair as (one, two), by name."""
    return [F.least(a, b).alias("one"), F.greatest(a, b).alias("two")]


def pair_values(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """(lang, one, two, value) of each pair of groups of a language, one < two.

    groups: (lang, source, kept, zero), zero being p of count 0; scored: (lang, source, term, n, p, zero). Both are read several times.
    """
    share = F.pmod(F.hash("source"), F.lit(SHARES))
    many = groups.select("lang", F.col("source").alias("two"), F.col("zero").alias("zero_two"), F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    pairs = groups.select("lang", F.col("source").alias("one"), F.col("zero").alias("zero_one"), "kept", share.alias("share")).join(many, ["lang", "share"]).where("one != two")
    pairs = written(pairs.select("lang", "one", "two", "zero_one", "zero_two", "kept"), "divergence-pairs")
    zeros = _f(F.col("zero_one"), F.col("zero_two"))
    base = pairs.where("one < two").select("lang", "one", "two", F.coalesce(F.col("kept") * zeros, F.lit(0)).alias("value"))
    # one group's terms against the other's zeros: by the counts that occur, not by the terms
    counts = scored.groupBy("lang", F.col("source").alias("one"), "p").agg(F.count("*").alias("terms"))
    single = counts.join(pairs.where("kept > 0"), ["lang", "one"]).select("lang", *_other("one", "two"), (F.col("terms") * (_f(F.col("p"), F.col("zero_two")) - zeros)).alias("value"))
    single = single.where("value != 0").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    # terms of both
    left = scored.select("lang", "term", F.col("source").alias("one"), F.col("p").alias("p"), F.col("zero").alias("p0"))
    right = scored.select("lang", "term", F.col("source").alias("two"), F.col("p").alias("q"), F.col("zero").alias("q0"))
    p, p0, q, q0 = map(F.col, ("p", "p0", "q", "q0"))
    both = left.join(right, ["lang", "term"]).where("one < two").select("lang", "one", "two", (_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)).alias("value"))
    both = both.where("value != 0").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    return base.unionByName(single).unionByName(both).groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, q, value, rank) of each group (language, source) of docs.

    Part `pair`: item is each other source of the language, value how far the two differ (0 without kept terms), q null. Part `term`: item is a kept term that the
    group has more of than its language (p over the language's q), value what it adds, ranks to `top`. Ranks go by value, the largest
    first, then by item. Null languages, sources and texts are ''; empty texts count as documents, so their group is told; repeated rows
    count as often as they come; long texts are read whole, by stretches; other columns do not matter; an empty table gives no rows.
    A pair of sources is a row of the result, so rows grow with the square of a language's sources; texts are read once and not shuffled.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(*(F.coalesce(named(c), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    found = written(postings(rows, min_docs), "divergence-postings")
    langs = found.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("kept"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total", "kept"])
    groups = written(groups.withColumn("zero", _p(F.lit(0), F.col("total"), F.col("kept"))).withColumn("group", F.struct("lang", "source")), "divergence-groups")
    sizes = groups.where("terms > 0").select("group", "total", "lang_total", "kept", "zero", "terms")
    scored = spread_join(found.drop("first").withColumn("group", F.struct("lang", "source")), sizes, "group", rows="terms")
    scored = scored.select("lang", "source", "term", "n", _p(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _p(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "zero")
    scored = written(scored, "divergence-scored")
    pairs = pair_values(groups.select("lang", "source", "kept", "zero"), scored)
    sides = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("side")
    pairs = pairs.select("lang", sides, "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", F.lit(None).cast("long").alias("q"), "value")
    terms = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "q", _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))
