"""Workbooks as a data source of Spark: one pass, filters and columns taken by the source, memory by the row."""

import subprocess
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from passaura.sources import xlsx
from samples import books


@pytest.fixture
def folder(tmp_path):
    for name, k in (("a.xlsx", 0), ("b.XLSX", 100)):
        with open(tmp_path / name, "wb") as f:
            xlsx.workbook_bytes({"One": (["Placa", "Id", "placa", None, "Data.x"], [(f"P{k + r}", r, "other", "untitled", None if r % 2 else f"d{r}") for r in range(50)]), "Two": (["t"], [(r,) for r in range(5)])}, f)
    (tmp_path / "c.txt").write_bytes(b"no")
    return tmp_path


def test_cells(spark, folder):
    """The cells of a folder, as those of a table of its files."""
    from passaura.sources.files import files

    xlsx.source(spark)
    own = spark.read.format("xlsx").load(str(folder))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, xlsx.cells(files(spark, str(folder), "xlsx")).collect()))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, xlsx.cells(xlsx.scanned(spark, str(folder))).collect()))
    assert spark.read.format("xlsx").option("sheet", "Two").load(f"file://{folder}/a.xlsx").count() == 6


def test_filters_are_taken(spark, folder):
    """Filters on sheet and row reach the source; others stay with Spark. A sheet is left at the last row, and other sheets are not opened."""
    xlsx.source(spark)
    own = spark.read.format("xlsx").load(str(folder))
    few = own.where("sheet = 'One' and row > 3 and row <= 6 and col = 1 and raw <> 'P103'")
    assert sorted((r.row, r.raw) for r in few.collect()) == [(4, "P102"), (4, "P2"), (5, "P3"), (6, "P104"), (6, "P4")]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "row#" not in plan.split("Filter")[1].split("+-")[0] or "isnotnull" in plan
    with zipfile.ZipFile(folder / "a.xlsx") as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].split(b'<row r="9"')[0] + b"<broken"
    parts["xl/worksheets/sheet2.xml"] = b"<broken"
    (folder / "d").mkdir()
    with zipfile.ZipFile(folder / "d" / "d.xlsx", "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    broken = spark.read.format("xlsx").load(str(folder / "d"))
    assert broken.where("sheet = 'One' and row < 8 and col = 2").count() == 7
    with pytest.raises(Exception, match="ParseError"):
        broken.where("sheet = 'One'").count()
    with pytest.raises(Exception, match="ParseError"):
        broken.where("sheet = 'Two'").count()
    assert spark.read.format("xlsx").option("skip", "true").load(str(folder / "d")).count() == 0


def test_tables(spark, folder):
    """A table by its header row: titles are columns, the first of those alike counts, untitled cells do not; chosen columns alone are read."""
    xlsx.source(spark)
    own = spark.read.format("xlsx").option("headerRow", 1).option("sheet", "One").load(str(folder))
    assert own.columns == ["file", "row", "Placa", "Id", "Data.x"] and own.count() == 100
    r = own.where("row = 4 and file like '%a.xlsx'").first()
    assert (r["Placa"], r["Id"], r["Data.x"]) == ("P2", "2", "d2")
    some = spark.read.format("xlsx").options(headerRow=1, sheet="One", columns="Data.x").load(str(folder))
    assert some.columns == ["file", "row", "Data.x"] and some.count() == 50
    assert some.where((F.col("row") >= 10) & (F.col("row") < 14)).count() == 4
    with pytest.raises(Exception, match="no such columns in row 1: nothing"):
        spark.read.format("xlsx").options(headerRow=1, columns="nothing").load(str(folder))


def test_one_pass_for_cells_and_anchors(spark, tmp_path, monkeypatch):
    """Heights come from the pass over the cells; each sheet's part is opened once."""
    book = books.workbook({1: {1: "x"}, 4: {2: "y"}}, [(4, 190_600, books.TWO, "m.png", b"1"), (1, 5, books.ONE, "n.png", b"2")], heights={4: 30.0})
    opened, pulled = [], xlsx.Workbook.pulled
    monkeypatch.setattr(xlsx.Workbook, "pulled", lambda self, name, tag: (opened.append(name), pulled(self, name, tag))[1])
    rows = list(xlsx.Workbook(book).scan(True))
    assert opened.count("xl/worksheets/sheet1.xml") == 1
    assert [r for r in rows if r[0] == "anchor"] == [("anchor", "Plan1", 4, None, None, None, 190_600, 381_000, "xl/media/m.png", 1), ("anchor", "Plan1", 1, None, None, None, 5, None, "xl/media/n.png", 2)]
    assert [r[1:6] for r in rows if r[0] == "cell"] == [("Plan1", 1, 1, "x", "str"), ("Plan1", 4, 2, "y", "str")]
    (tmp_path / "a.xlsx").write_bytes(book)
    found = xlsx.scanned(spark, str(tmp_path), every=True)
    assert [(r.anchor_row, r.row_off, r.row_height, r.media) for r in xlsx.anchors(found).orderBy("ord").collect()] == [(4, 190_600, 381_000, "xl/media/m.png"), (1, 5, None, "xl/media/n.png")]


_READ = """
import re, sys
sys.path.insert(0, {root!r})
from passaura.sources import xlsx
most = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024  # of this program alone
before = most()
with open({path!r}, "rb") as f:
    n = sum(1 for _ in xlsx.Workbook(f).cells())
print(n, before, most())
"""


def test_a_sheet_of_200_mb(tmp_path):
    """A sheet of 200 MB is read in less than 500 MB of a process, libraries included, and little more than before."""
    import os

    path, text = str(tmp_path / "large.xlsx"), "abcdefghij" * 12
    with open(path, "wb") as f:
        xlsx.workbook_bytes({"S": (["a"] * 8, ((text,) * 8 for _ in range(140_000)))}, f)
    with zipfile.ZipFile(path) as z:
        assert z.getinfo("xl/worksheets/sheet1.xml").file_size > 200_000_000
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", _READ.format(root=root, path=path)], capture_output=True, text=True, timeout=600, check=True)
    cells, before, most = map(int, out.stdout.split())
    assert cells == 8 * 140_001 and most < 500 and most - before < 100


def test_pictures_of_tables_are_kept(spark, tmp_path):
    """workbooks of a table are opened once; small pictures go with their anchor, large and repeated ones in rows of their own. Either way the images are those of a folder."""
    from passaura.plans import providers

    large = bytes(range(256)) * (xlsx.SMALL // 256 + 1)
    rows = {3: {1: 1, 2: "A"}, 33: {1: 2, 2: "B"}}
    own = {"a.xlsx": [(4, 0, books.TWO, "m.png", b"one"), (34, 0, books.TWO, "n.png", b"")], "b.xlsx": [(4, 0, books.TWO, "m.png", b"one"), (35, 0, books.TWO, "m.png", b"one"), (36, 0, books.TWO, "large.png", large)]}
    made = {}
    for name, pictures in own.items():
        links = [p for n, p in enumerate(pictures) if p[3] not in [q[3] for q in pictures[:n]]]
        made[name] = books.workbook(rows, links)
        if len(links) < len(pictures):  # a second anchor of the first picture
            made[name] = _edited(made[name], "xl/drawings/drawing1.xml", lambda x: x.replace(b"</x:wsDr>", b'<x:twoCellAnchor><x:from><x:col>0</x:col><x:row>34</x:row><x:rowOff>0</x:rowOff></x:from><x:pic><x:blipFill><a:blip r:embed="r0"/></x:blipFill></x:pic></x:twoCellAnchor></x:wsDr>'))
        (tmp_path / name).write_bytes(made[name])
    scan = list(xlsx.Workbook(made["b.xlsx"]).scan(False, contents=True))
    assert [(r[8], r[10]) for r in scan if r[0] == "anchor"] == [("xl/media/m.png", None), ("xl/media/large.png", None), ("xl/media/m.png", None)]
    assert [(r[8], r[10]) for r in scan if r[0] == "media"] == [("xl/media/m.png", b"one"), ("xl/media/large.png", large)]
    assert [r[10] for r in xlsx.Workbook(made["a.xlsx"]).scan(False, contents=True) if r[0] == "anchor"] == [b"one", b""]
    plain = lambda images: sorted((r.image_ix, bytes(r.content)) for r in images.collect())
    for name in own:
        table = spark.createDataFrame([(f"file:{tmp_path}/{name}", made[name])], "file string, content binary")
        found = plain(providers.read_spvias(spark, table)[1])
        assert found == plain(providers.read_spvias(spark, f"{tmp_path}/{name}")[1]) and len(found) == len(own[name])


def _edited(book: bytes, part: str, change) -> bytes:
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as b:
        for n in a.namelist():
            b.writestr(n, change(a.read(n)) if n == part else a.read(n))
    return out.getvalue()


def test_stored_parts(tmp_path):
    """Stored parts are cut out of the zip; a changed byte is told as the zip's reader tells it. Pictures are written as the zip's writer writes them."""
    book = books.workbook({1: {1: "x"}}, [(1, 0, books.TWO, f"{n}.png", bytes([65 + n]) * 50) for n in range(3)])
    (tmp_path / "a.xlsx").write_bytes(book)
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert z.testzip() is None and [z.read(f"xl/media/{n}.png") for n in range(3)] == [xlsx.Workbook(book).read(f"xl/media/{n}.png") for n in range(3)]
    with pytest.raises(zipfile.BadZipFile):
        xlsx.Workbook(book.replace(b"B" * 50, b"B" * 49 + b"C")).read("xl/media/1.png")


def test_rows_from_events():
    """Cells as the elements say: rich inline texts, shared strings, empty values, missing references, character references, texts around other elements."""
    book = books.workbook({1: {1: "x"}})
    sheet = """<?xml version="1.0"?><w:worksheet xmlns:w="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><w:sheetData><w:row r="2" ht="30"><w:c r="B2" t="inlineStr"><w:is><w:r><w:t>a&amp;</w:t></w:r><w:r><w:t>b&#233;<![CDATA[<]]></w:t></w:r></w:is></w:c>
<w:c><w:f>1+1</w:f><w:v>2</w:v></w:c><w:c r="AA2" t="str"><w:v/></w:c><w:c r="AB2" t="b"><w:v>1</w:v></w:c><w:c r="AC2"/></w:row><w:row><w:c><w:v>1.5</w:v></w:c></w:row></w:sheetData></w:worksheet>"""
    rows = list(xlsx.Workbook(_edited(book, "xl/worksheets/sheet1.xml", lambda _: sheet.encode())).rows())
    assert rows == [("Plan1", 2, 381_000, [(2, "a&bé<", "str"), (3, "2", "int"), (27, "", "str"), (28, "1", "bool")]), ("Plan1", 3, None, [(1, "1.5", "float")])]


def test_rows_are_scanned_whole(spark, tmp_path, folder):
    """A row's cells were rows of their own, which an exchange and a sort put together again; now only rows of one number in several sheets are, and repeated ones."""
    from passaura.sources.files import files

    def grouped(cells):
        return sorted((r.file, r.row, tuple(sorted(map(tuple, r.c)))) for r in cells.groupBy("file", "row").agg(F.collect_list(F.struct("col", "raw", "type")).alias("c")).collect())

    shown = lambda df: sorted((r.file, r.row, tuple(sorted(map(tuple, r.cells)))) for r in df.collect())
    (tmp_path / "one").mkdir()
    with open(tmp_path / "one" / "a.xlsx", "wb") as f:
        f.write(books.workbook({1: {1: "x"}, 3: {1: "Placa", 4: 5}, 4: {2: "<&>\x01", 3: True}}, [(3, 0, "oneCellAnchor", "m.png", b"p")], heights={2: 30.0}))
    with zipfile.ZipFile(tmp_path / "one" / "a.xlsx") as z, zipfile.ZipFile(tmp_path / "repeated.xlsx", "w") as out:
        for name in z.namelist():
            own = z.read(name)
            out.writestr(name, own.replace(b'r="4"', b'r="3"') if name.endswith("sheet1.xml") else own)
    for path, alone in ((tmp_path / "one", True), (folder, False), (tmp_path / "repeated.xlsx", False)):
        for source in (str(path), files(spark, str(path), "xlsx")):
            plain, whole = xlsx.scanned(spark, source, True), xlsx.scanned(spark, source, True, whole=True)
            found = xlsx.rows(whole)
            assert shown(found) == grouped(xlsx.cells(plain)) == grouped(xlsx.cells(whole)) != []
            assert sorted(map(tuple, xlsx.anchors(plain).collect())) == sorted(map(tuple, xlsx.anchors(whole).collect()))
            assert ("Exchange" not in found._jdf.queryExecution().executedPlan().toString()) == alone
    merged = xlsx.rows(xlsx.scanned(spark, str(tmp_path / "repeated.xlsx"), whole=True)).where("row = 3").select(xlsx.value_at(F.lit(1)), xlsx.value_at(F.lit(2)), xlsx.value_at(F.lit(9))).first()
    assert tuple(merged) == ("Placa", "<&>", None)


HEAD, FOOT = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>', "</sheetData></worksheet>"
PLAIN = '<row r="2" ht="15.5" customHeight="1"><c r="A2" s="3" t="s"><v>5</v></c><c r="C2"/><c r="D2" t="inlineStr"><is><t>é x</t></is></c><c r="E2" t="inlineStr"><is><t xml:space="preserve"></t></is></c></row>'
OTHER = {
    "plain": PLAIN * 2000, "none": "", "escaped": PLAIN * 900 + '<row r="7"><c r="A7" t="inlineStr"><is><t>a&amp;b</t></is></c></row>' + PLAIN * 900, "unnumbered": PLAIN + "<row><c><v>1</v></c></row>" + PLAIN, "lines": PLAIN + "\n" + PLAIN,
    "commented": PLAIN + "<!-- " + PLAIN + " -->", "formula": PLAIN + '<row r="8"><c r="A8"><f>1+1</f><v>2</v></c></row>' + PLAIN, "cut": PLAIN * 3 + "<row r=", "stray": PLAIN + '<row r="9"><c r="A9"><v>1</v></c></row></x>',
    "long": PLAIN + '<row r="3"><c r="A3" t="inlineStr"><is><t>' + "z" * 700_000 + "</t></is></c></row>" + PLAIN, "empty": '<row r="1"></row>' + PLAIN + '<row r="5"/>', "ends": PLAIN + '<row r="3"><c r="B3" t="str"><v>q\r\nw</v></c></row>',
}


@pytest.mark.parametrize("name", OTHER)
def test_plain_rows_are_the_parsers(name):
    """A comment before the rows has the parser read all of them: both ways give the same rows, and the same error at the same place."""
    import io

    def found(head, foot=FOOT):
        out = []
        try:
            for row, height, cells in xlsx._rows_in(io.BytesIO((head + OTHER[name] + foot).encode())):
                out.append((row, height, [xlsx._value(*c, [str(k) for k in range(9)], set()) for _, *c in cells], [c[0] for c in cells]))
        except xlsx.ET.ParseError:
            out.append("error")
        return out

    slow = HEAD.replace("<sheetData>", "<!-- --><sheetData>")
    assert found(HEAD) == found(slow) and found(HEAD, "") == found(slow, "") and found(HEAD, "")[-1] == "error"
    assert found(slow.replace("UTF-8", "ISO-8859-1")) == found(HEAD.replace("UTF-8", "ISO-8859-1"))
    assert (found(HEAD)[-1:] == ["error"]) == (name in ("cut", "stray"))


def test_plain_rows_are_not_parsed(monkeypatch):
    """The parser called back for each of seven events of a cell, which was most of a scan."""
    import io

    shown, create = [], xlsx.expat.ParserCreate

    class Counted:
        def __init__(self, **options):
            self.__dict__["own"] = create(**options)

        def __setattr__(self, name, value):
            setattr(self.own, name, value)

        def Parse(self, data, last):
            shown.append(len(data))
            return self.own.Parse(data, last)

    monkeypatch.setattr(xlsx.expat, "ParserCreate", Counted)
    assert sum(1 for _ in xlsx._rows_in(io.BytesIO((HEAD + PLAIN * 5000 + FOOT).encode()))) == 5000 and sum(shown) == len(HEAD) + len(FOOT)


def test_records_of_a_batch():
    """The rows of each book of a batch as dictionaries, with lists and nulls, as Arrow gives them one by one."""
    import pyarrow as pa

    rows = [[{"k": k, "texts": [None if n % 3 else f"t{b}{n}" for n in range(k % 4)], "maybe": None if k % 2 else ["x"], "plate": None if k == 3 else f"p{k}"} for k in range(b)] for b in (5, 0, 9, 1)]
    column = pa.array(rows)
    for c in (column, column.slice(1, 3)):
        assert [books._records(x.values) for x in c] == c.to_pylist()


def test_tables_of_files_are_taken_by_bytes(spark):
    """A hundred files at least were one row group and one page, and sixteen files and more one batch: tasks held all of a partition's files several times."""
    import glob
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from passaura.sources import scratch

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    def made(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([str(k)]), pa.array([random.Random(k).randbytes(1 << 20)])], ["file", "content"])

    files = spark.range(0, 40, 1, 1).mapInArrow(made, "file string, content binary")
    before = [spark.conf.get(k) for k in (scratch._BATCH, scratch._UNPACKED)]
    held = scratch.written(files, "files")
    groups = [m.row_group(k).total_byte_size for f in glob.glob(held.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0] + "/*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(groups) >= 40 << 20 and max(groups) <= scratch.GROUP + (2 << 20)
    taken = [r.n for r in scratch.written(held.coalesce(1).mapInArrow(sizes, "n long"), "sizes", of_files=True).collect()]
    assert sum(taken) >= 40 << 20 and max(taken) <= scratch.PIECE + (2 << 20)
    assert held.count() == 40 and [spark.conf.get(k) for k in (scratch._BATCH, scratch._UNPACKED)] == before


def test_books_are_made_row_by_row(spark):
    """A book's rows are in order of k whatever batches they come in, and are not gathered into one row before."""
    import json

    rows = spark.createDataFrame([(b, k, 100 + k, "ABC1D23", [f"t{k}", None][: k % 3]) for k in range(8) for b in (2, None, 0, 1)], "book long, k int, passage_id long, expected_plate string, texts array<string>")
    build = lambda own: json.dumps([(r["k"], r["passage_id"], r["texts"]) for r in own]).encode()
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = books.made(rows.repartition(3), "x{}", build)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert {r.name: json.loads(bytes(r.content)) for r in found.collect()} == {f"x{b}": [[k, 100 + k, [f"t{k}", None][: k % 3]] for k in range(8)] for b in (2, None, 0, 1)}
