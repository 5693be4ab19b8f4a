"""One packing plan for all rows: as best-fit decreasing piece by piece, and the same for any layout."""

import collections
import random

from passaura.llm import token_packing

from .test_operators import PLAIN, RANKS, docs_of, texts  # noqa: F401


def test_plans_are_best_fit_decreasing():
    """Rows by their pieces' lengths are those of taking the pieces one after another."""
    r = random.Random(11)
    for _ in range(400):
        width = r.choice([1, 2, 7, 16, 33, 100])
        lengths = [r.choice([r.randint(1, width), max(1, width // 3), width]) for _ in range(r.randint(0, 120))]
        counts = collections.Counter(lengths)
        segments, made = token_packing.planned(counts, width)
        rows, taken = collections.defaultdict(list), collections.Counter()
        for length, first, n, times, row in segments:
            assert first == taken[length] and n > 0 and times > 0
            taken[length] += n * times
            for k in range(n):
                rows[row + k] += [length] * times
        assert taken == counts and set(rows) == set(range(made)) and all(sum(x) <= width for x in rows.values())
        want = [sorted(lengths[k] for k in row) for row in token_packing.best_fit_decreasing(lengths, width)]
        assert sorted(map(sorted, rows.values())) == sorted(want)


def test_plans_of_many_pieces_are_short():
    r = random.Random(1)
    segments, made = token_packing.planned({k: r.randint(1, 10**9) for k in range(1, 2048)}, 2048)
    assert len(segments) < 40_000 and made > 10**8


def shown(df):
    return sorted((bytes(r.ids), r.n_ids, tuple(r.cu_seqlens), bytes(r.position_ids), tuple(-1 if i is None else i for i in r.doc_ids), tuple(r.offsets)) for r in df.collect())


def test_any_layout_gives_the_same_rows(spark, texts, monkeypatch):
    """Ties, repeated rows, null ids, null and empty texts, texts of several rows; read back without loss, in as many rows as the plan says."""
    monkeypatch.setattr(token_packing, "BUCKET", 7)
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(texts)] + [(None, "no id", "x", 1, "y"), (3, texts[3], "x", 1, "y"), (3, texts[3], "x", 1, "y")]
    schema = docs_of(spark, []).schema
    one = token_packing.packed_globally(spark.createDataFrame(rows, schema).repartition(1), RANKS, width=64)
    other = token_packing.packed_globally(spark.createDataFrame(rows[::-1], schema).repartition(5), RANKS, width=64)
    got = shown(one)
    assert got == shown(other)
    back = collections.defaultdict(list)
    for r in token_packing.unpacked(one, 64).collect():
        back[r.doc_id].append((r.offset, r.ids))
    for k, t in enumerate(texts):
        n = 3 if k == 3 else 1
        own = sorted(back.get(k, []))
        assert len(own) % n == 0 and [i for x in own[::n] for i in x[1]] == PLAIN(t or "")
    assert back[None] == [(0, PLAIN("no id"))]
    lengths = [len(ids) for own in back.values() for _, ids in own]
    assert len(got) == len(token_packing.best_fit_decreasing(lengths, 64))
    assert token_packing.packed_globally(docs_of(spark, []), RANKS).count() == 0
