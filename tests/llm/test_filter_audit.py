"""The filter audit against a document by document simulation of every order."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from passaura.llm import filter_audit as audit

DOCS = "doc_id long, text string, lang string, part int, n long, MASK int"


def plainly(docs, labels):
    """(part, order, step) -> metrics, by walking each document through each order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((lang or "", {k for k, v in own.items() if v}, i in good, i in toxic))
    out, shapley = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {x[0] for x in fails}:
            left = [x for x in fails if x[0] == part]
            for k, letter in enumerate(order, 1):
                own = [x for x in fails if x[0] == part and letter in x[1]]
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                out[part, order, k] = [len(left), len(gone), len(own) - len(gone), sum(x[1] == {letter} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(df, marks, F.col("lang"), audit.text_filters(F.col("text")), repeats="E")
    rows = found.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows) and all(r.filter == r.filter_order[r.step - 1] for r in rows)
    return got


def test_against_walking_every_order(spark):
    """Copies over languages, a text that a third of all rows have, nulls, empty texts, repeated rows and labels, null ids."""
    r = random.Random(7)
    words = ["ab", "Ab", "ABC", "x#", "é", "|", "q\x0bq", "　", "w1", "w2"]
    texts = [" ".join(r.choice(words[: r.randint(1, 10)]) + str(r.randint(0, 300) if r.random() < 0.5 else "") for _ in range(r.choice([3, 150, 199, 200, 260]))) for _ in range(60)]
    docs = [(k, r.choice(texts), r.choice(["en", "de", None, ""])) for k in range(400)] + [(k, "same", "en") for k in range(400, 650)]
    docs += [(None, "same", "fr"), (None, None, "fr"), (3, None, "fr"), (700, "", "fr"), (700, "", "fr"), (700, "", "de"), (701, "\t\n", "fr")] + [(702, "same", "en")] * 40
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in range(0, 700, 3)] + [(3, 1, 1), (6, 0, 1), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, docs, labels) == plainly(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    docs = [(1, "a", "en")]
    assert audited(spark, docs, []) == plainly(docs, [])


def test_long_text(spark):
    docs = [(1, "word " * 1_000_000, "en"), (2, "X" * 3_000_000, "en"), (3, "\n" * 3_000_000, "en")]
    assert audited(spark, docs, []) == plainly(docs, [])


def test_filters_of_ones_own(spark):
    df = spark.createDataFrame([(1, "a", "x", 5, None, 0), (2, "b", "x", 50, 9, 0), (3, "c", "x", 50, 1, 0)], DOCS)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit(df, marks, F.col("lang"), {"s": F.col("part") > 10, "t": F.col("n") > 5})
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.collect()) == [("st", 1, 1, 2, 0, 1, 3), ("st", 2, 1, 0, 1, 0, 1), ("ts", 1, 2, 1, 0, 0, 1), ("ts", 2, 1, 1, 1, 1, 3)]
    with pytest.raises(ValueError):
        audit.interactions(df, "aab")
