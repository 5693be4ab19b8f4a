"""Divergence of sources against whole numbers worked out term by term."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from passaura.llm import source_divergence as div

DOCS = "lang string, source string, text string, term string, n int, Value int"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plainly(docs, min_docs, top):
    count, held = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in docs:
        w = words_of(text)
        count[lang or "", source or ""].update(w)
        held[lang or ""].update(set(w))
    out = []
    for lang in {x for x, _ in count}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        v, own = len(kept), {s: c for (x, s), c in count.items() if x == lang}
        whole = sum(own.values(), collections.Counter())

        def p(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, ps = p(whole), {s: p(c) for s, c in own.items()}
        for s in own:
            pairs = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(ps[s][t], q[t]), t) for t in kept if own[s][t] and ps[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def diverged(spark, docs, **how):
    found = div.divergence(spark.createDataFrame([(*d, "x", 1, 2) for d in docs], DOCS), **how)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found.collect())


@pytest.mark.parametrize("min_docs", [1, 3, 10])
def test_against_term_by_term(spark, min_docs):
    """A source and a language with a third of all rows, ties, nulls, groups without terms, a language without kept terms."""
    r = random.Random(min_docs)
    vocabulary = ["the", "The", "é", "É", "wörd", "日本", "a1b", "x-y", "tie1", "tie2", *(chr(97 + k) * r.randint(1, 3) for k in range(26))]
    docs = [(r.choice(["en", "en", "de", None, ""]), r.choice(["s0", "s1", "s2", "s3", None]), " ".join(r.choice(vocabulary[: r.randint(1, 36)]) for _ in range(r.randint(0, 30)))) for _ in range(200)]
    docs += [("en", "hot", r.choice(["the the", "zz tie", ""])) for _ in range(150)] + [("en", "none", None), ("en", "none2", "123 !"), ("fr", "a", "seul"), ("fr", "b", "deux"), ("it", "one", "uno"), ("en", "é", "wörd"), ("en", "Z", "wörd")]
    assert diverged(spark, docs, min_docs=min_docs, top=5) == plainly(docs, min_docs, 5)


def test_what_tasks_hand_on_in_pieces(spark, monkeypatch):
    """Held terms are handed on early and summed all the same; long texts are cut between terms."""
    r = random.Random(1)
    docs = [("en", f"s{k % 3}", " ".join(f"w{'abcdefghij'[r.randint(0, 9)] * r.randint(1, 9)}" for _ in range(50))) for k in range(60)]
    monkeypatch.setattr(div, "HELD", 20)
    monkeypatch.setattr(div, "STRETCH", 64)
    assert diverged(spark, docs) == plainly(docs, 10, 10)


def test_words_of_stretches():
    for text in ("", "a", " a ", "A" * 100, "ab " * 1000, "日本 " * 500, "x" * 5000 + " y", "\ud800 a"):
        whole = b" ".join(w for words in div.words_of(text) for w in words).decode("utf-8", "surrogatepass")
        assert whole.split(" ") == words_of(text) or not whole and not words_of(text)


def test_long_text(spark):
    docs = [("en", "a", "Word other " * 2_000_000), ("en", "b", "y" * 4_000_000), *(("en", "b", "word") for _ in range(10)), *(("en", "c", "other word") for _ in range(10))]
    assert diverged(spark, docs) == plainly(docs, 10, 10)


def test_empty(spark):
    assert diverged(spark, []) == []
    assert diverged(spark, [(None, None, None)]) == []


def test_counts_beyond_64_bits(spark):
    """p of counts whose product with a billion needs over 64 bits."""
    n, total = 123_456_789_012_345, 987_654_321_098_765
    got = spark.createDataFrame([(n, total, 77), (0, 0, 1)], "n long, total long, kept long").select(div._p(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()
    assert [x.p for x in got] == [1 + 10**9 * (n + 2) // (total + 154), 1 + 10**9]
