"""Workbooks (XLSX) read and written with the standard library's zip and XML readers.

Sheets are pulled through the XML reader row by row from the zip's stream, so a task holds a row, the shared strings and
the heights of rows, not a document. One pass gives cells and drawing anchors. Workbooks of a folder are read by a data source of Spark, which opens
them where a task runs; those of a table (file, content) a workbook at a time.

A file that is no sound workbook stops the job with its error, unless `skip` is given: then it gives no rows, and `unreadable` lists such files with
what is wrong. `largest` bounds the bytes of a part once unpacked.
"""

from __future__ import annotations

import functools
import io
import itertools
import posixpath
import struct
import re
import zipfile
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from . import chunks, opened

#: Bytes of an unpacked part; rows handed on at once; bytes of files that share a task.
LARGEST, CHUNK, TOGETHER = 1 << 30, 10_000, 8 << 20
#: Bytes of a picture that goes with its anchor; bytes of XML that are parsed at once.
SMALL, PIECE = 16 << 10, 64 << 10
EMU = 12700
#: Names of XML spaces, and built-in number formats that are dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
ART = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
ROWS = f"{MAIN}sheetData"
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


class TooLarge(ValueError):
    """A zip entry over the limit."""


#: What reading a file that is no sound workbook can raise.
UNREADABLE = (zipfile.BadZipFile, ET.ParseError, TooLarge, KeyError, IndexError, ValueError, NotImplementedError, EOFError, zlib.error)


class Workbook:
    """A workbook's parts by name."""

    def __init__(self, content, largest: int = LARGEST):
        """content: bytes, or a file that can be read from any place."""
        self.content = content if isinstance(content, bytes) else None
        self.zip = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
        self.names = set(self.zip.namelist())
        self.largest = largest

    def _sized(self, name: str) -> str:
        if self.zip.getinfo(name).file_size > self.largest:
            raise TooLarge(f"{name} is larger than {self.largest} bytes")
        return name

    def read(self, name: str) -> bytes | None:
        if name not in self.names:
            return None
        found = self._stored(name)
        return self.zip.read(self._sized(name)) if found is None else found

    def _stored(self, name: str) -> bytes | None:
        """A part that lies in the zip as it is, cut out of it if all is as it should be: opening an entry costs ten times as much, and there are many pictures."""
        entry = self.zip.getinfo(name)
        if self.content is None or entry.compress_type != zipfile.ZIP_STORED or entry.flag_bits & 0x61 or entry.file_size > self.largest or len(self.content) < entry.header_offset + 30:
            return None
        mark, n, more = struct.unpack_from("<4s22xHH", self.content, entry.header_offset)
        at = entry.header_offset + 30
        found = self.content[at + n + more : at + n + more + entry.file_size]
        sound = mark == b"PK\3\4" and self.content[at : at + n] == entry.orig_filename.encode("utf-8" if entry.flag_bits & 0x800 else "cp437", "replace")
        return found if sound and len(found) == entry.file_size and zlib.crc32(found) == entry.CRC else None

    def pulled(self, name: str, tag: str) -> Iterator:
        """The elements of a tag, each gone before the next is read; rows as `_rows_in` gives them."""
        with self.zip.open(self._sized(name)) as stream:
            yield from _rows_in(stream) if tag == f"{MAIN}row" else _elements(stream, tag)

    def tree(self, name: str) -> ET.Element | None:
        data = self.read(name)
        return None if data is None else ET.fromstring(data)

    def links(self, name: str) -> dict[str, str]:
        """The parts that a part's relationships name, by id; a target that begins with a slash is absolute."""
        folder, base = posixpath.split(name)
        tree = self.tree(f"{folder}/_rels/{base}.rels")
        out = {}
        for r in tree.iter(f"{PACKAGE}Relationship") if tree is not None else ():
            target = r.get("Target", "")
            out[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        return out

    def sheets(self) -> list[tuple[str, str]]:
        """(title, part) of the sheets in order."""
        links, tree = self.links("xl/workbook.xml"), self.tree("xl/workbook.xml")
        return [(s.get("name"), links[s.get(f"{REL}id")]) for s in tree.iter(f"{MAIN}sheet") if s.get(f"{REL}id") in links] if tree is not None else []

    def strings(self) -> list[str]:
        part = "xl/sharedStrings.xml"
        return ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in self.pulled(part, f"{MAIN}si")] if part in self.names else []

    def date_styles(self) -> set[int]:
        """The numbers of the cell styles that show dates or times."""
        tree = self.tree("xl/styles.xml")
        if tree is None:
            return set()
        own = {int(f.get("numFmtId")) for f in tree.iter(f"{MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))}
        styles = tree.find(f"{MAIN}cellXfs")
        return {k for k, x in enumerate(styles if styles is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def rows(self, sheet: str | None = None, last: int | None = None) -> Iterator[tuple[str, int, int | None, list[tuple[int, str, str]]]]:
        """(sheet, row, height in EMU, cells (col, raw, type) that have a value) of the rows of all sheets or one, up to a last row; types: int, float, bool, str, date, time."""
        strings, dates = self.strings(), self.date_styles()
        for title, part in self.sheets():
            if part not in self.names or sheet is not None and title != sheet:
                continue
            for row, height, cells in self.pulled(part, f"{MAIN}row"):
                if last is not None and row > last:
                    break
                found = [(col, *value) for col, *c in cells if (value := _value(*c, strings, dates))]
                yield title, row, height, found

    def cells(self) -> Iterable[tuple[str, int, int, str, str]]:
        """(sheet, row, col, raw, type) of the cells that have a value."""
        return ((title, row, *cell) for title, row, _, found in self.rows() for cell in found)

    def scan(self, every: bool, contents: bool = False, whole: bool = False) -> Iterator[tuple]:
        """SCAN without the file: the cells, then the anchors with the heights that the rows before have told; with contents the bytes of pictures, in
        the row of their anchor if they are small and it is the only one, else once in a row of their own. With whole a row of the sheet is one row with its
        cells, and one of kind mixed says that rows of several sheets, or repeated ones, have the same number."""
        heights, first, more, last, mixed = {}, next(iter(self.sheets()), (None,))[0], (None,) * contents + ([],) * whole, (None, 0), False
        for title, row, height, found in self.rows():
            if height is not None and title == first:
                heights[row] = height
            if not whole:
                for cell in found:
                    yield "cell", title, row, *cell, None, None, None, None, *more
            elif found:
                mixed, last = mixed or last[0] not in (None, title) or row <= last[1], (title, row)
                yield "row", title, row, None, None, None, None, None, None, None, *more[:-1], found
        if mixed:
            yield "mixed", None, None, None, None, None, None, None, None, None, *more
        anchors = list(self.anchors(every, heights))
        times = Counter(x[3] for x in anchors if x[3].startswith(PICTURES)) if contents else {}
        for row, off, height, media, n in anchors:
            alone = times.get(media) == 1 and self.zip.getinfo(media).file_size <= SMALL
            yield "anchor", first, row, None, None, None, off, height, media, n, *((self.read(media), *more[1:]) if alone else more)
        for media, n in times.items():
            if n > 1 or self.zip.getinfo(media).file_size > SMALL:
                yield "media", None, None, None, None, None, None, None, media, None, self.read(media), *more[1:]

    def heights(self) -> dict[int, int]:
        """The heights in EMU of the rows of the first sheet that have one."""
        first = next(iter(self.sheets()), (None,))[0]
        return {row: height for _, row, height, _ in self.rows(first) if height is not None}

    def anchors(self, every: bool, heights: dict[int, int] | None = None) -> Iterable[tuple[int, int, int | None, str, int]]:
        """(anchor_row from 1, row_off, row_height, media part, ord) of the pictures of the first sheet.

        Of its first drawing, two-cell anchors only; with `every` those of all drawings, two-cell anchors of a
        drawing before its one-cell ones.
        """
        sheets = self.sheets()
        if not sheets:
            return
        part, n = sheets[0][1], 0
        heights = (self.heights() if heights is None else heights) if every else {}
        drawings = [x for x in self.links(part).values() if "/drawings/" in x and x.endswith(".xml")]
        for drawing in drawings if every else drawings[:1]:
            tree, links = self.tree(drawing), self.links(drawing)
            if tree is None:
                continue
            for kind in ("twoCellAnchor", "oneCellAnchor") if every else ("twoCellAnchor",):
                for a in tree.iter(f"{DRAW}{kind}"):
                    start, picture = a.find(f"{DRAW}from"), next(a.iter(f"{ART}blip"), None)
                    media = links.get(picture.get(f"{REL}embed")) if picture is not None else None
                    if start is None or media not in self.names:
                        continue
                    row = int(start.findtext(f"{DRAW}row", "0")) + 1
                    n += 1
                    yield row, int(start.findtext(f"{DRAW}rowOff", "0")), heights.get(row), media, n


def _elements(stream, tag: str) -> Iterator[ET.Element]:
    above: list[ET.Element] = []
    for event, element in ET.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(element)
            continue
        above.pop()
        if element.tag == tag:
            yield element
            if above:
                above[-1].clear()


def _rows_in(stream) -> Iterator[tuple[int, int | None, list[tuple]]]:
    """(row, height in EMU, cells (col, kind, style, text of v, texts of t)) of a sheet, from the parser's events: no elements are built.

    Rows that are nothing but cells of one unescaped text each are told by a pattern, with which the parser's calls for each element are spared, and the
    parser is not shown them. From the first row that is anything else on the parser gets all.
    """
    done, tags, text, own = deque(), {f"{MAIN}{x}"[1:]: x for x in ("row", "c", "v", "t")}, [], None
    row = col = depth = 0
    height, cells = None, []

    def start(tag: str, attributes: dict) -> None:
        nonlocal row, col, height, cells, own, depth
        at, inside = tags.get(tag), text and text[-1] is not None
        if inside:
            text.append(None)  # only what comes before an element counts as its text
        depth += 1
        if at == "c" and cells is not None:
            reference = attributes.get("r")
            col = _column(reference) if reference else col + 1
            own = [col, attributes.get("t", "n"), attributes.get("s", -1), None, [], depth]
        elif at == "row":
            row, col, cells = int(attributes.get("r", row + 1)), 0, []
            height = round(float(attributes["ht"]) * EMU) if attributes.get("ht") and attributes.get("r") else None
        elif own is not None and (at == "t" or at == "v" and own[3] is None and depth == own[5] + 1):
            text.clear()
            text.append("")

    def said(data: str) -> None:
        if text and text[-1] is not None:
            text.append(data)

    def end(tag: str) -> None:
        nonlocal own, cells, depth
        depth -= 1
        at = tags.get(tag)
        if at == "v" and own is not None and text and depth == own[5]:
            own[3] = "".join(x for x in text if x)
            text.clear()
        elif at == "t" and own is not None and text:
            own[4].append("".join(x for x in text if x))
            text.clear()
        elif at == "c" and own is not None:
            cells.append(tuple(own[:5]))
            own = None
        elif at == "row":
            done.append((row, height, cells))

    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text, parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = True, start, end, said
    try:
        held = stream.read(PIECE)
        at = held.find(_BEGIN) + len(_BEGIN)
        if at >= len(_BEGIN) and _plain_head(held[:at], parser):
            held = held[at:]
            while held or (held := stream.read(PIECE)):
                cut = held.rfind(_END) + len(_END)
                if cut < len(_END):
                    if len(held) > 4 * PIECE or not (piece := stream.read(PIECE)):
                        break
                    held += piece
                    continue
                lines, at = held[:cut].decode(), 0
                while found := _PLAIN_ROW.match(lines, at):
                    row, at = int(found[1]), found.end()
                    tall = _TALL.search(found[2])
                    yield row, round(float(tall[1]) * EMU) if tall else None, [(_column_of(ref), kind or "n", style or -1, value or None, [inline]) for ref, style, kind, value, inline in _PLAIN_CELL.findall(found[3])]
                held = lines[at:].encode() + held[cut:]
                if at < len(lines):
                    break
                if len(held) < PIECE:
                    held += stream.read(PIECE)
        elif at >= len(_BEGIN):
            held = held[at:]
        parser.StartElementHandler = start
        while held or (held := stream.read(PIECE)):
            parser.Parse(held, False)
            held = b""
            while done:
                yield done.popleft()
        parser.Parse(b"", True)
    except expat.ExpatError as e:
        yield from done  # the rows before what is broken
        raise ET.ParseError(str(e)) from e


_BEGIN, _END = b"<sheetData>", b"</row>"
#: Text without marks, and what XML cannot hold or reads as something else.
_CHARS = r"[^<&\r\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"
_FORM = r'<c r="{0}[A-Z]{{1,3}}{1}[0-9]+"(?: s="{0}[0-9]+{1}")?(?: t="{0}[A-Za-z]+{1}")?(?:/>|>(?:<v>{0}' + _CHARS + r'++{1}</v>|<is><t(?: xml:space="preserve")?>{0}' + _CHARS + "*+{1}</t></is>)</c>)"
_PLAIN_CELL = re.compile(_FORM.format("(", ")"))
_PLAIN_ROW = re.compile(r'<row r="([0-9]+)"((?: [A-Za-z]+="[^"<&\x00-\x1f]*+")*+)>((?:' + _FORM.format("(?:", ")") + ")*+)</row>")
_TALL = re.compile(' ht="([^"]+)"')


def _plain_head(head: bytes, parser) -> bool:
    """Shows the parser what comes before the rows; whether it is UTF-8 and opens their element under its own name."""
    opened = []
    parser.StartElementHandler = lambda tag, _: opened.append(tag)
    parser.Parse(head, False)
    return opened[-1:] == [ROWS[1:]] and b"<!" not in head and not re.search(rb"""encoding=["'](?!utf-8)""", head, re.IGNORECASE)


def _column(reference: str) -> int:
    return _column_of(reference.rstrip("0123456789"))


@functools.lru_cache(20_000)
def _column_of(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _value(kind: str, style: str | int, text: str | None, texts: list[str], strings: list[str], dates: set[int]) -> tuple[str, str] | None:
    if kind == "inlineStr":
        return "".join(texts), "str"
    if text is None:
        return None
    if kind == "s":
        return strings[int(text)], "str"
    if kind == "b":
        return text, "bool"
    if kind != "n":
        return text, "str"
    number = float(text)
    if int(style) in dates:
        when = datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400))
        return (when.strftime("%H:%M:%S"), "time") if number < 1 else (when.isoformat(" "), "date")
    return (str(int(number)), "int") if re.fullmatch(r"-?\d+", text) else (text, "float")


SCAN = "file string, kind string, sheet string, row long, col int, raw string, type string, row_off long, row_height long, media string, ord int"
#: What a scan of whole rows has besides.
WHOLE = ", cells array<struct<col:int,raw:string,type:string>>"
#: Where pictures are in a workbook.
PICTURES = "xl/media/"
Each = Callable[[Workbook], Iterable[tuple]]


def _rows_of(file: str, content, each: Each, skip: bool, largest: int) -> Iterator[list[tuple]]:
    """The rows that each(workbook) gives, with the file, by chunks; of an unreadable one an error or, with skip, none."""
    try:
        held = ((file, *x) for x in each(Workbook(content, largest)))
        if skip:  # nothing of a file whose end is broken
            whole = list(held)
            yield from (whole[k : k + CHUNK] for k in range(0, len(whole), CHUNK))
            return
        while chunk := list(itertools.islice(held, CHUNK)):
            yield chunk
    except UNREADABLE as e:
        if not skip:
            raise ValueError(f"no sound xlsx: {file}: {type(e).__name__}: {e}") from e


def _over(files: DataFrame, each: Each, full: str, skip: bool, largest: int) -> DataFrame:
    def over(batches):
        return chunks.batches((row for batch in batches for x in chunks.files(batch) for rows in _rows_of(*x, each, skip, largest) for row in rows), full)

    return files.select("file", "content").mapInArrow(over, full)


@dataclass
class Books(InputPartition):
    files: tuple[str, ...]


class _Reader(DataSourceReader):
    """Workbooks of a path; those up to TOGETHER bytes share a task."""

    def __init__(self, options, each: Each):
        self.path, self.each, self.skip, self.largest = options["path"], each, str(options.get("skip", "false")).lower() == "true", int(options.get("largest", LARGEST))

    def partitions(self) -> list[Books]:
        out, held, size = [], [], 0
        for file, n in opened.listed(self.path, "xlsx"):
            if held and size + n > TOGETHER:
                out, held, size = [*out, Books(tuple(held))], [], 0
            held.append(file)
            size += n
        return [*out, Books(tuple(held))] if held else out

    def read(self, partition: Books | None) -> Iterator[tuple]:
        for file in partition.files if partition else ():
            with opened.opened(file) as f:
                for rows in _rows_of(file, f, self.each, self.skip, self.largest):
                    yield from rows


class _CellReader(_Reader):
    """Takes filters on sheet and row: other sheets are not opened, and a sheet is left at the last row that is asked for."""

    def __init__(self, options, each):
        super().__init__(options, self.limited)
        self.sheet, self.first, self.last, self.shape = options.get("sheet"), 1, None, each

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(("sheet",), str(title)) if self.sheet in (None, title):
                    self.sheet = title
                case EqualTo(("row",), int(n)):
                    self.first, self.last = max(self.first, n), n if self.last is None else min(self.last, n)
                case GreaterThan(("row",), int(n)):
                    self.first = max(self.first, n + 1)
                case GreaterThanOrEqual(("row",), int(n)):
                    self.first = max(self.first, n)
                case LessThan(("row",), int(n)):
                    self.last = n - 1 if self.last is None else min(self.last, n - 1)
                case LessThanOrEqual(("row",), int(n)):
                    self.last = n if self.last is None else min(self.last, n)
                case _:
                    yield f

    def limited(self, book: Workbook) -> Iterator[tuple]:
        return self.shape(book, self.sheet, self.first, self.last)


def _cell_rows(book: Workbook, sheet: str | None, first: int, last: int | None) -> Iterator[tuple]:
    return ((title, row, *cell) for title, row, _, found in book.rows(sheet, last) if row >= first for cell in found)


_CELLS = "file string, sheet string, row long, col int, raw string, type string"


class Cells(DataSource):
    """spark.read.format("xlsx"): the cells of workbooks (file, sheet, row, col, raw, type), or with headerRow a table.

    Options: sheet; skip; largest; headerRow, the row of the titles (those of the first file): then columns are file, row and one of text for each title, or for those of
    `columns` (with commas between) alone; of titles alike the first counts. Filters on sheet and row are taken by the source.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _titles(self) -> dict[str, int]:
        """The columns of a table and where they are."""
        header, out = int(self.options["headerRow"]), {}
        wanted = [x.strip() for x in self.options["columns"].split(",")] if "columns" in self.options else None
        for file, _ in opened.listed(self.options["path"], "xlsx")[:1]:
            with opened.opened(file) as f:
                for _, row, _, found in Workbook(f).rows(self.options.get("sheet"), header):
                    if row == header and not out:
                        for col, raw, _ in found:
                            if raw.strip() and raw.strip().lower() not in {x.lower() for x in (*out, "file", "row")}:
                                out[raw.strip()] = col
        if wanted is not None:
            missing = [x for x in wanted if x not in out]
            if missing:
                raise ValueError(f"no such columns in row {header}: {', '.join(missing)}")
            out = {x: out[x] for x in wanted}
        return out

    def schema(self):
        if "headerRow" not in self.options:
            return _CELLS
        from pyspark.sql.types import LongType, StringType, StructType

        out = StructType().add("file", StringType()).add("row", LongType())
        for x in self._titles():
            out = out.add(x, StringType())
        return out

    def reader(self, schema) -> DataSourceReader:
        if "headerRow" not in self.options:
            return _CellReader(self.options, _cell_rows)
        header, places = int(self.options["headerRow"]), list(self._titles().values())

        def table(book: Workbook, sheet: str | None, first: int, last: int | None) -> Iterator[tuple]:
            for _, row, _, found in book.rows(sheet, last):
                own = {col: raw for col, raw, _ in found}
                if row > header and row >= first and any(p in own for p in places):
                    yield row, *(own.get(p) for p in places)

        return _CellReader(self.options, table)


def source(spark: SparkSession) -> None:
    """Make spark.read.format("xlsx") known, and let Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Cells)


def _scan_source(every: bool, whole: bool) -> type[DataSource]:
    class Scan(DataSource):
        @classmethod
        def name(cls) -> str:
            return "xlsx_scan"

        def schema(self) -> str:
            return SCAN + WHOLE * whole

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options, lambda book: book.scan(every, whole=whole))

    return Scan


def scanned(spark: SparkSession, path: str | DataFrame, every: bool = False, skip: bool = False, largest: int = LARGEST, contents: bool = False, whole: bool = False) -> DataFrame:
    """SCAN of the workbooks of a path or of a table (file, content), from one pass over each, written to the scratch folder: cells and anchors are read from there.

    With contents the pictures of a table's workbooks are kept too, so that these are opened once: small ones that are anchored once with their anchor, others in rows of kind media.
    With whole a row of a sheet is one row with its cells (WHOLE), for `rows`.
    """
    from .scratch import written

    if isinstance(path, DataFrame):
        found = _over(path.where(F.lower("file").endswith(".xlsx")), lambda book: book.scan(every, contents, whole), SCAN + ", content binary" * contents + WHOLE * whole, skip, largest)
    else:
        spark.dataSource.register(_scan_source(every, whole))
        found = spark.read.format("xlsx_scan").options(skip=skip, largest=largest).load(path)
    return written(found, "workbooks", of_files=isinstance(path, DataFrame))


def unreadable(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(file, error) of the files that are no workbook, or one with a part that is broken, missing or over `largest` bytes."""

    def error(content: bytes) -> str | None:
        try:
            book = Workbook(content, largest)
            for _ in book.scan(True):
                pass
            for name in book.names:
                if name.startswith(PICTURES):
                    book.read(name)
        except UNREADABLE as e:
            return f"{type(e).__name__}: {e}"
        return None if book.sheets() else "no sheets"

    def over(frames):
        for frame in frames:
            found = frame.assign(error=[error(bytes(x)) for x in frame["content"]])
            yield found[found["error"].notna()][["file", "error"]]

    return files.select("file", "content").mapInPandas(over, "file string, error string")


def cells(files: DataFrame, skip: bool = False, largest: int = LARGEST) -> DataFrame:
    """(file, sheet, row, col, raw, type) of workbooks: a table (file, content), or what `scanned` gives."""
    if "cells" in files.columns:
        return files.where("kind = 'row'").select("file", "sheet", "row", F.inline("cells"))
    if "kind" in files.columns:
        return files.where("kind = 'cell'").select("file", "sheet", "row", "col", "raw", "type")
    return _over(files, Workbook.cells, _CELLS, skip, largest)


def rows(scan: DataFrame) -> DataFrame:
    """(file, row, cells) of a scan of whole rows: a row's cells lie together as they were scanned. Where a workbook has rows of one number in several sheets, or twice, they are put together."""
    if scan.where("kind = 'mixed'").isEmpty():
        return scan.where("kind = 'row'").select("file", "row", "cells")
    return cells(scan).groupBy("file", "row").agg(F.collect_list(F.struct("col", "raw", "type")).alias("cells"))


def value_at(col) -> Column:
    """The raw value of `cells` in a column (by number); of several the greatest, null if there is none."""
    return F.array_max(F.transform(F.filter("cells", lambda c: c["col"] == col), lambda c: c["raw"]))


def anchors(files: DataFrame, every: bool = False, without: tuple[str, ...] = (), without_types: tuple[str, ...] = (), skip: bool = False, largest: int = LARGEST, contents: bool = False) -> DataFrame:
    """(file, anchor_row, row_off, row_height, media, ord), with contents of what `scanned` gives also content, null if it is in a row of its own; media by base name in `without`, or with an extension of without_types, are left out.

    files is as for `cells`; what `scanned` gives has the anchors of its own `every`.
    """
    if "kind" in files.columns:
        found = files.where("kind = 'anchor'").select("file", F.col("row").alias("anchor_row"), "row_off", "row_height", "media", "ord", *(["content"] if contents else []))
    else:
        found = _over(files, lambda w: w.anchors(every), "file string, anchor_row long, row_off long, row_height long, media string, ord int", skip, largest)
    base = F.lower(F.regexp_extract("media", r"([^/]*)\z", 1))
    return found.where(~base.isin(*[x.lower() for x in without], "") & ~F.regexp_extract(base, r"(\.[^.]*)\z", 1).isin(*without_types, "-"))


def media(files: DataFrame, skip: bool = False, largest: int = LARGEST) -> DataFrame:
    """(file, media, content) of the pictures in workbooks (file, content), apart from the anchors so that only names are joined and sorted."""
    return _over(files, lambda w: ((n, w.read(n)) for n in sorted(w.names) if n.startswith(PICTURES)), "file string, media string, content binary", skip, largest)


@functools.lru_cache(20_000)
def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheet(header: list[str], rows: Iterable[tuple], heights: dict[int, float]) -> Iterable[str]:
    yield '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
    yield _row(1, tuple(header), heights.get(1))
    for n, row in enumerate(rows, 2):
        if n > 1_048_576:
            raise ValueError("a sheet holds 1048576 rows at most")
        if row or n in heights:
            yield _row(n, row, heights.get(n))
    yield "</sheetData></worksheet>"


#: What XML cannot hold.
_UNFIT = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
#: What is written otherwise than it is.
_MARKED = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f&<>]")


def _row(n: int, values: tuple, height: float | None = None) -> str:
    out = []
    for k, v in enumerate(values, 1):
        if v is None or v == "":
            continue
        at = f"{_letters(k)}{n}"
        if isinstance(v, bool):
            out.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
        elif isinstance(v, int | float):
            out.append(f'<c r="{at}"><v>{v}</v></c>')
        else:
            text = str(v)
            if _MARKED.search(text):
                text = escape(_UNFIT.sub("", text))
            out.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
    tall = "" if height is None else f' ht="{height}" customHeight="1"'
    return f'<row r="{n}"{tall}>{"".join(out)}</row>'


def _pictures(z: zipfile.ZipFile, pictures: list[tuple[int, int, str, str, bytes]]) -> None:
    anchors = "".join(f'<x:{kind}><x:from><x:col>0</x:col><x:row>{row - 1}</x:row><x:rowOff>{off}</x:rowOff></x:from><x:pic><x:blipFill><a:blip r:embed="r{n}"/></x:blipFill></x:pic></x:{kind}>' for n, (row, off, kind, _, _) in enumerate(pictures))
    links = "".join(f'<Relationship Id="r{n}" Type="{REL[1:-1]}/image" Target="/xl/media/{name}"/>' for n, (_, _, _, name, _) in enumerate(pictures))
    z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="d" Type="{REL[1:-1]}/drawing" Target="../drawings/drawing1.xml"/></Relationships>')
    z.writestr("xl/drawings/drawing1.xml", f'<x:wsDr xmlns:x="{DRAW[1:-1]}" xmlns:a="{ART[1:-1]}" xmlns:r="{REL[1:-1]}">{anchors}</x:wsDr>')
    z.writestr("xl/drawings/_rels/drawing1.xml.rels", f'<Relationships xmlns="{PACKAGE[1:-1]}">{links}</Relationships>')
    for _, _, _, name, content in pictures:
        _store(z, PICTURES + name, content)


def _store(z: zipfile.ZipFile, name: str, content: bytes) -> None:
    """An entry as it is; as z.writestr(name, content, ZIP_STORED), which costs several times as much for each of many small pictures."""
    if len(content) > zipfile.ZIP64_LIMIT or name in z.NameToInfo:
        z.writestr(name, content, zipfile.ZIP_STORED)
        return
    entry = zipfile.ZipInfo(name)
    entry.CRC, entry.compress_size, entry.file_size, entry.header_offset, entry.external_attr = zlib.crc32(content), len(content), len(content), z.start_dir, 0o600 << 16
    z.fp.seek(z.start_dir)
    z.fp.write(entry.FileHeader(False))
    z.fp.write(content)
    z.filelist.append(entry)
    z.NameToInfo[name], z.start_dir = entry, z.fp.tell()


def workbook_bytes(sheets: dict[str, tuple[list[str], Iterable[tuple]]], file, pictures: list[tuple[int, int, str, str, bytes]] | None = None, heights: dict[int, float] | None = None) -> None:
    """Write a workbook of sheets (title: header, rows) to a binary file, row by row.

    The first sheet can have pictures (row from 1, offset in EMU, kind of anchor, name, bytes) and row heights in points.
    """
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Type="{REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(t[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, t in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{MAIN[1:-1]}" xmlns:r="{REL[1:-1]}"><sheets>{listed}</sheets></workbook>')
        linked = "".join(f'<Relationship Id="rId{k}" Type="{REL[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{PACKAGE[1:-1]}">{linked}</Relationships>')
        for k, (header, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                with io.BufferedWriter(f, PIECE) as out:
                    for part in _sheet(header, rows, heights or {} if k == 1 else {}):
                        out.write(part.encode())
        if pictures:
            _pictures(z, pictures)


def write(sheets: dict[str, DataFrame], path: str) -> bool:
    """Write DataFrames as the sheets of one workbook, over what is there; nothing if the first has no rows.

    A workbook is one file, so its rows pass through the driver one partition at a time, in their order; a sheet
    holds 1048576. path may be of any file system that Spark knows. Returns whether it wrote.
    """
    import tempfile

    first = next(iter(sheets.values()))
    if first.isEmpty():
        return False
    plain = lambda df: (tuple(str(v) if not isinstance(v, bool | int | float | type(None)) else v for v in r) for r in df.toLocalIterator())
    with tempfile.NamedTemporaryFile(suffix=".xlsx") as f:
        workbook_bytes({t: (df.columns, plain(df)) for t, df in sheets.items()}, f)
        f.flush()
        jvm, conf = first.sparkSession.sparkContext._jvm, first.sparkSession.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{f.name}"), target)
    return True
