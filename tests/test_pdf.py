"""Page ranges of PDF files over tasks, and tables on pages."""

import os
import random

import pytest
from pyspark.sql import functions as F

from passaura.operators import tables
from passaura.sources import opened, pdf


class Counting:
    """A backend whose files hold a number of pages; what is opened and read is noted in a folder, with the task's process."""

    def __init__(self, log):
        self.log = log

    def open(self, file):
        n = int(file.read().split()[0])
        own, log = type("Document", (), {})(), self.log

        def noted(what):
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(what + "\n")

        class Document:
            def __len__(self):
                noted(f"count {n}")
                return n

            def text(self, k):
                noted(f"text {n} {k}")
                return f"page {k + 1} of {n}"

            def images(self, k):
                noted(f"images {n} {k}")
                return [{"width": 100, "height": 50, "x0": 0.0, "y0": float(i), "x1": 30.0, "y1": 30.0, "content": b"%d-%d" % (k, i)} for i in range(k % 3)]

        del own
        return Document()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "log").mkdir()
    (tmp_path / "in" / "large.PDF").write_bytes(b"10000 " + b"x" * 5000)
    for k in range(5):
        (tmp_path / "in" / f"small{k}.pdf").write_bytes(b"%d " % (k * 2))
    (tmp_path / "in" / "other.txt").write_bytes(b"7")
    return tmp_path


def test_a_large_file_spreads_over_tasks(spark, folder):
    """10,000 pages are read in ranges, each page once, by tasks of their own; small files share one; pages keep their places."""
    files = pdf.Folder(spark, str(folder / "in"), (("pagesPerTask", 200), ("largeBytes", 1000)))
    found = pdf.pages(files, Counting(str(folder / "log"))).select("*", F.spark_partition_id().alias("task"))
    rows = found.collect()
    large = [r for r in rows if r.file.endswith("large.PDF")]
    assert [r.page for r in large] == list(range(1, 10001)) and all(r.text == f"page {r.page} of 10000" for r in large)
    by_task = {}
    for r in large:
        by_task.setdefault(r.task, []).append(r.page)
    assert len(by_task) == 50 and all(len(x) == 200 and x == list(range(x[0], x[0] + 200)) for x in by_task.values())
    small = [r for r in rows if not r.file.endswith("large.PDF")]
    assert len({r.task for r in small}) == 1 and sorted((os.path.basename(r.file), r.page) for r in small) == [(f"small{k}.pdf", p) for k in range(5) for p in range(1, 2 * k + 1)]
    noted = [x for name in os.listdir(folder / "log") for x in (folder / "log" / name).read_text().splitlines()]
    assert noted.count("count 10000") == 1 and len([x for x in noted if x.startswith("text 10000")]) == 10000 and not any(x.startswith("images") for x in noted)


def test_images_of_ranges(spark, folder):
    """Images are taken out only where they are asked for, and are those of a table of files."""
    backend = Counting(str(folder / "log"))
    files = pdf.Folder(spark, f"file://{folder}/in", (("pagesPerTask", 3000), ("largeBytes", 1000)))
    own = lambda df: sorted((os.path.basename(r.file), r.page, r.ord, bytes(r.content)) for r in df.where("file like '%small%'").collect())
    from passaura.sources.files import files as listed

    found = own(pdf.page_images(files, backend))
    assert found == own(pdf.page_images(listed(spark, str(folder / "in"), "pdf"), backend)) and len(found) == sum(p % 3 for k in range(5) for p in range(2 * k))
    assert pdf.page_images(files, backend).where("file like '%large%'").count() == sum(k % 3 for k in range(10000))
    assert not any(x.startswith("text") for name in os.listdir(folder / "log") for x in (folder / "log" / name).read_text().splitlines())


def test_one_file_no_file_and_empty_folders(spark, folder):
    backend = Counting(str(folder / "log"))
    one = pdf.pages(pdf.Folder(spark, str(folder / "in" / "small1.pdf")), backend).collect()
    assert [(r.page, r.text) for r in one] == [(1, "page 1 of 2"), (2, "page 2 of 2")]
    assert pdf.pages(pdf.Folder(spark, str(folder / "log")), backend).count() == 0
    with pytest.raises(Exception, match="nothing"):
        pdf.pages(pdf.Folder(spark, str(folder / "nothing")), backend).count()


def test_listed(folder):
    assert [(os.path.basename(p), n) for p, n in opened.listed(str(folder / "in"), "txt")] == [("other.txt", 1)]
    (path, _), = opened.listed(f"file:{folder}/in/other.txt", "txt")
    assert path == f"file:{folder}/in/other.txt" and opened.content(path) == b"7"


WORDS = "file string, page int, word string, x0 double, y0 double, x1 double, y1 double, line string"


def plainly(words, rules, gap):
    """Cells by comparing each word with those before."""
    out = {}
    for page in {w[:2] for w in words}:
        own = [w for w in words if w[:2] == page and None not in w[3:7] and w[2] and w[2].strip()]
        marks = sorted({y for f, p, y in rules if (f, p) == page})

        def bands(start, end, gap, own=own):
            number, reach, n = {}, None, -1
            for w in sorted(set(own), key=lambda w: (w[start], w[end])):
                if reach is None or w[start] > reach + gap:
                    n += 1
                reach = w[end] if reach is None else max(reach, w[end])
                number[w] = n
            return number

        line = bands(4, 6, 0.0) if not marks else {w: sum(y <= (w[4] + w[6]) / 2 for y in marks) for w in own}
        place = {x: k for k, x in enumerate(sorted(set(line.values())))}
        col = bands(3, 5, gap)
        for w in sorted(own, key=lambda w: (w[4], w[3], w[5], w[6], w[2])):
            cells = out.setdefault((*page, place[line[w]]), [""] * (max(col.values()) + 1))
            cells[col[w]] = (cells[col[w]] + " " + w[2]).strip()
    return out


def test_tables_against_plain_sweeps(spark):
    r = random.Random(4)
    words, rules = [], []
    for page in range(30):
        for _ in range(r.randint(1, 25)):
            x, y = 40 * r.randint(0, 4) + r.random() * 9, 15 * r.randint(0, 5) + r.random() * 4
            words.append(("a" if page % 2 else "b", page, r.choice(["w", "vv", "1234567890", " ", None, "é"]), x, y, x + r.randint(3, 26), y + r.randint(4, 9)))
        if page % 3 == 0:
            rules += [("a" if page % 2 else "b", page, 15.0 * k - 2 + r.random()) for k in range(r.randint(1, 6))]
    words += [words[0], words[0], ("a", 99, "x", None, 1.0, 2.0, 3.0), ("c", 1, "only", 1.0, 1.0, 2.0, 2.0)]
    df = spark.createDataFrame([(*w, "other") for w in words], WORDS)
    marks = spark.createDataFrame(rules, "file string, page int, y double")
    for own, given in ((rules, marks), ([], None)):
        got = {(x.file, x.page, x.line): x.cells for x in tables.rows(df.drop("line"), given).collect()}
        assert got == plainly(words, own, tables.GAP)
    assert tables.rows(df.drop("line").limit(0), marks.limit(0)).count() == 0


def test_passage_rows(spark):
    table = spark.createDataFrame([("a", 1, 0, ["ID", "x"]), ("a", 1, 2, [" 1234567890 ", "d2"]), ("a", 1, 1, ["1234567890123", "d1"]), ("a", 2, 0, ["123456789"]), ("b", 1, 0, [])], "file string, page int, line int, cells array<string>")
    (r,) = tables.passage_rows(table).collect()
    assert (r.file, r.page, r.id, r.date, r.responsible) == ("a", 1, "1234567890123", "d1", "")


def test_files_of_a_table_are_opened_once(spark, tmp_path):
    """Each was opened for texts, areas and bytes."""
    from passaura.plans import providers

    log = tmp_path / "opened"

    def backend(content):
        with open(log, "a") as f:
            f.write("x")
        return [(f"{content.decode()} 01/02/2024 10:11:12 330 KM 1+2 PRACA 2 SUL CIDADE 68 ABC1D23 MARCA 2 11,20 R$ NOME", [{"width": 400, "height": 300.0, "x0": 0, "y0": 0, "x1": 9, "y1": 9, "content": b"i"}])]

    files = spark.createDataFrame([(f"mem:/{k}.pdf", (f"{k:020d}").encode()) for k in range(50)], "file string, content binary").coalesce(1)
    passages, images = providers.read_intervias(spark, files, backend=backend)
    assert passages.count() == 50 and {bytes(r.content) for r in images.collect()} == {b"i"} and images.count() == 50
    assert len(log.read_text()) == 50


def test_batches_end_by_rows_and_bytes():
    from passaura.sources import chunks

    rows = [(str(k), k, None, b"y" * 10) for k in range(7)]
    own = list(chunks.batches(rows, "a string, b int, c double, d binary", most=3))
    assert [b.num_rows for b in own] == [3, 3, 1] and [tuple(r.values()) for b in own for r in b.to_pylist()] == rows
    assert [b.num_rows for b in chunks.batches(rows, "a string, b int, c double, d binary", size=22)] == [2, 2, 2, 1]
    assert list(chunks.batches([], "a string")) == []


def test_words_of_pages_are_dealt_out_once(spark):
    """Words were dealt out by page again where rules came in; repeated rules and rules of no height change nothing."""
    words = spark.createDataFrame([("a", 1, "x", 0.0, 0.0, 9.0, 5.0), ("a", 1, "y", 0.0, 6.0, 9.0, 9.0), ("b", 1, "z", 0.0, 0.0, 9.0, 5.0)], "file string, page int, word string, x0 double, y0 double, x1 double, y1 double")
    rules = spark.createDataFrame([("a", 1, -1.0), ("a", 1, -1.0), ("a", 1, 20.0), ("c", 1, None)], "file string, page int, y double")
    found = tables.rows(words, rules)
    assert sorted(map(tuple, found.collect())) == [("a", 1, 0, ["x y"]), ("b", 1, 0, ["z"])]
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


PAGES = {
    "autoban": "top\nData/Hora\n01/02/2024 10:00:00\n02\nABC1234\nData/Hora none\nData/Hora\n02/02/2024 10:00:00\n1\nXYZ9A87\n", "prototype": "top\nData/Hora\n01/02/2024 10:00:00\n02\nABC1234\nData/Hora none\nData/Hora\n02/02/2024 10:00:00\n1\nXYZ9A87\n",
    "eixosp": "12AB0123456789\n03\nABC1234\n", "ecovias": "E77 31/02/2024 10:00:00 SP330 12+300 Posto Azul 3 Norte Vila 55 ABC1234 Alfa - KA 1 R$ 9,70 Envio",
    "intervias": "AAAA0000000000000001 01/02/2024 10:00:00 330 KM 1+2 PRACA 2 SUL CIDADE 68 ABC1234 MARCA /MODELO X 2 11,20 R$ NOME",
}


@pytest.mark.parametrize("together", [1 << 20, 3])
@pytest.mark.parametrize(("name", "want"), [("autoban", "cdab"), ("prototype", "ab"), ("eixosp", "acd"), ("ecovias", "acd"), ("intervias", "acd")])
def test_what_a_page_tells_needs_no_exchange(spark, monkeypatch, name, want, together):
    """Passages and the places of images were dealt out by file or page and sorted there, the texts parsed for each use; the bytes of pages of over `together` come from rows of their own."""
    from passaura.plans import providers

    monkeypatch.setattr(pdf, "TOGETHER", together)

    def backend(content):
        sizes = {b"a": (400, 50, 0), b"b": (90, 60, 200), b"c": (400.0, 10, 0), b"d": (400, 10, 60)}
        yield PAGES[name], [{"width": w, "height": 300, "x0": x, "y0": y, "x1": x + 50, "y1": y + 50, "content": c} for c, (w, y, x) in sizes.items()]
        yield "none", [{"width": 20, "height": 30, "x0": 0, "y0": 0, "x1": 9, "y1": 9, "content": b"z"}]
        yield "no picture", []

    files = spark.createDataFrame([("mem:/a.pdf", b"x"), ("mem:/b.pdf", b"y")], "file string, content binary")
    passages, images = getattr(providers, f"read_{name}")(spark, files, backend=backend)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")
    assert exchanges(passages) == 0 and exchanges(images) <= (4 if name == "ecovias" else 2)
    keys = {r.passage_id: (r.file, r["k"] if "k" in passages.columns else 0) for r in passages.collect()}
    found = sorted((*keys[r.passage_id], r.image_ix, bytes(r.content).decode()) for r in images.collect())
    assert "".join(x for file, *_, x in found if file == "mem:/a.pdf") == want and len(found) == 2 * len(want) and len(keys) == 2 * (1 + ("k" in passages.columns))


def test_batches_of_nested_rows():
    from passaura.sources import chunks

    rows = [("a", [(1, 2.0), (2, None)]), ("b", []), ("c", [(3, 4.5)])]
    (own,) = chunks.batches(rows, "file string, images array<struct<ord:int,x0:double>>")
    assert [(r["file"], [tuple(x.values()) for x in r["images"]]) for r in own.to_pylist()] == rows
    (own,) = chunks.batches([("a", [])], "file string, images array<struct<ord:int,x0:double>>")
    assert own.to_pylist() == [{"file": "a", "images": []}]


def test_words_are_sorted_once(spark):
    """Words were sorted by page four times, gathered twice, and filtered where they come from. Pages longer than a batch, null pages, ties, and what is no word."""
    words = [("a", 1, f"w{k}", 40.0 * (k % 5), 10.0 * (k // 5), 40.0 * (k % 5) + 20, 10.0 * (k // 5) + 5) for k in range(50)]
    words += [(None, None, x, 0.0, 0.0, 9.0, 5.0) for x in ("b", "a", "b", " ", None)] + [("c", 7, "  ", 0.0, 0.0, 9.0, 5.0), ("c", 8, "x", float("nan"), 0.0, 9.0, 5.0), ("c", 8, "y", 0.0, 0.0, None, 5.0)]
    df = spark.createDataFrame(words, "file string, page int, word string, x0 double, y0 double, x1 double, y1 double")
    found = tables.rows(df)
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(r.file, r.page, r.line): r.cells for r in tables.rows(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert got == {("a", 1, k): [f"w{5 * k + c}" for c in range(5)] for k in range(10)} | {(None, None, 0): ["a b b"], ("c", 8, 0): ["x"]}
    assert dict(found.dtypes) == {"file": "string", "page": "int", "line": "bigint", "cells": "array<string>"}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Sort [") == 1 and "Window" not in plan and "Filter" not in plan


def test_pages_of_one_key():
    """Pages whose keys are equal by chance stay apart, however their words are mixed."""
    import pyarrow as pa

    rows = [("f", p, f"{p}{n}", 10.0 * n, 0.0, 10.0 * n + 5, 5.0) for n in range(3) for p in (2, 1)]
    made = lambda own: pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*own, strict=True)] + [pa.array([5] * len(own))], ["file", "page", "word", "x0", "y0", "x1", "y1", "key"])
    (pages,) = tables._whole([made(rows[:1]), made(rows[1:4]), made(rows[4:])])
    assert tables._cells(pages, 3.0, pa.int32()).to_pylist() == [{"file": "f", "page": p, "line": 0, "cells": [f"{p}{n}" for n in range(3)]} for p in (2, 1)]
