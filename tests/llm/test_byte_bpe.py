"""Long runs of white space: ids and counts of the merge rule itself, in time by the length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from passaura.llm import byte_bpe, edit_token_counts, token_packing

from .test_operators import PLAIN, RANKS


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.read(open(RANKS, "rb").read())


def merged(blank, n):
    """The ids of a pre-token of n blanks: by the ranks, two line breaks are one token and no other blanks merge."""
    one = PLAIN(blank)
    return PLAIN("\n\n") * (n // 2) + one * (n % 2) if blank == "\n" else one * n


@pytest.mark.parametrize("n", [1_000_000, 2_000_000, 5_000_000])
@pytest.mark.parametrize("blank", [" ", "\t", "\n", "　"])
def test_runs_of_millions(vocabulary, blank, n):
    """At both ends and in the middle; the last blank before something goes with that."""
    began = time.perf_counter()
    run = blank * n
    for text, want in (
        (run, merged(blank, n)), (f"a{run}", PLAIN("a") + merged(blank, n)), (f"{run}b 1", merged(blank, n - 1) + PLAIN(f"{blank}b 1")),
        (f"x y{run}b{run}!{blank}", PLAIN("x y") + merged(blank, n - 1) + PLAIN(f"{blank}b") + merged(blank, n - 1) + PLAIN(f"{blank}!{blank}")),
    ):
        assert vocabulary.encode(text) == want
    assert time.perf_counter() - began < 60


def test_mixed_runs(vocabulary, monkeypatch):
    """Cut out from three blanks on, runs of mixed blanks beside letters, digits, marks and contractions give the library's ids."""
    monkeypatch.setattr(byte_bpe, "LONG", 3)
    monkeypatch.setattr(byte_bpe, "_RUN", byte_bpe.re.compile(byte_bpe._RUN.pattern.replace("10000", "3")))
    r = random.Random(2)
    bits = [" ", "\t", "\n", "\r\n", "　", "\xa0", "\x85", " ", "\x1c", "a", "é", "1", "!", "'ll", "'", "。", "​"]
    for _ in range(3000):
        text = "".join(r.choice(bits[: r.choice([3, 8, 17])]) * r.choice([1, 1, 2, 5]) for _ in range(r.randint(0, 30)))
        assert vocabulary.encode(text) == PLAIN(text)


def test_counts_of_long_runs():
    counter = edit_token_counts.Counter.read(open(RANKS, "rb").read())
    for blank in (" ", "\t", "\n", "　"):
        n = 1_500_000
        tree = edit_token_counts.TokenTree(f"ab{blank * n}cd ef", counter)
        tail = lambda k: len(PLAIN("ab") + merged(blank, k - 1) + PLAIN(f"{blank}cd ef"))  # noqa: B023, E731
        assert tree.n_tokens == tail(n)
        tree.edit(2, 12, "")
        assert (tree.n_tokens, tree.n_chars) == (tail(n - 10), n - 10 + 7)
        tree.edit(1000, 1000, blank * 5)
        assert tree.n_tokens == tail(n - 5)


def test_tables_with_long_runs(spark):
    """Both operators on a table with such a row: the row comes out right and no task dies."""
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1, F.concat(F.lit("a"), F.repeat(F.lit("\n"), 1_200_000), F.lit("b"))).otherwise("plain text").alias("text"))
    got = {}
    for x in token_packing.unpacked(token_packing.packed(rows, RANKS)).collect():
        got.setdefault(x.doc_id, []).append((x.offset, x.ids))
    want = PLAIN("a") + merged("\n", 1_199_999) + PLAIN("\nb")
    assert [i for _, ids in sorted(got[1]) for i in ids] == want and got[0] == got[2] == [(0, PLAIN("plain text"))]
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("stop"), F.lit("c d").alias("text")))
    counts = {x.doc_id: x.counts for x in edit_token_counts.edit_counts(rows.withColumn("edits", edits), RANKS, "edits").collect()}
    assert counts[1].n_tokens == len(want) and counts[1].n_tokens_edited == len(want) + 1


def test_the_first_put_is_taken():
    tree = token_packing.CapacityTree(10)
    for row, capacity in ((1, 5), (2, 5), (3, 4), (4, 5)):
        tree.put(capacity, row)
    assert [tree.take(5), tree.take(4), tree.take(1), tree.take(6), tree.take(2), tree.take(1)] == [(1, 5), (3, 4), (2, 5), None, (4, 5), None]
