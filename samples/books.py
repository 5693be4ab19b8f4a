"""Documents made from tables, in the layouts of the providers: what the layout queries read.

Each is a table of files (file, name, length, content), built on the executors, one file of a group of rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passaura.sources import chunks, xlsx
from passaura.sources.scratch import written

FILES = "file string, name string, length long, content binary"
TWO, ONE = "twoCellAnchor", "oneCellAnchor"
_FIELDS = itemgetter("k", "passage_id", "expected_plate", "texts")


def made(rows: DataFrame, name: str, build: Callable[[list[dict]], bytes], by: str = "book") -> DataFrame:
    """A file for each value of `by`: its name has {} in the value's place, its bytes are build(rows in order of k)."""

    def one(value, own: list[dict]) -> tuple:
        content, base = build(own), name.format(value)
        return f"mem:/{base}", base, len(content), content

    def over(batches):
        rows = (r for batch in batches for r in _records(batch.to_struct_array()))
        return chunks.batches((one(value, list(own)) for value, own in groupby(rows, itemgetter(by))), FILES)

    # in order, not gathered: a task holds the rows of one file and not those of all its files
    return kept(rows.repartition(by).sortWithinPartitions(by, "k", *(c for c in rows.columns if c not in ("k", by))).mapInArrow(over, FILES))


def _records(own) -> list[dict]:
    """Structs of Arrow as dictionaries, a column at a time: one by one they cost as much as the file that is made of them."""
    fields = dict(zip((f.name for f in own.type), own.flatten(), strict=True))
    return [dict(zip(fields, x, strict=True)) for x in zip(*map(_values, fields.values()), strict=True)]


def _values(column) -> list:
    if not pa.types.is_list(column.type) or column.null_count:
        return column.to_pylist()
    flat, ends = column.flatten().to_pylist(), column.offsets.to_pylist()  # places in the whole column, of which this may be a part
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]


def kept(files: DataFrame) -> DataFrame:
    """A table of files, written to the scratch folder and read from there: a layout looks at its files several times, and they are made once."""
    return written(files, "files", "zstd")


def workbook(rows: dict[int, dict[int, object]], pictures: list[tuple[int, int, str, str, bytes]] = (), title: str = "Plan1", heights: dict[int, float] | None = None) -> bytes:
    """A workbook of one sheet from its cells by row and column."""
    width = max(c for r in rows.values() for c in r)
    line = lambda r: tuple(rows[r].get(c) for c in range(1, width + 1)) if r in rows else ()
    out = io.BytesIO()
    xlsx.workbook_bytes({title: (list(line(1)), map(line, range(2, max(rows) + 1)))}, out, list(pictures), heights)
    return out.getvalue()


def blocks(own: list[dict]) -> bytes:
    """Passages in blocks of thirty rows, their pictures in the rows of the block, a logo before."""
    rows, pictures = {1: {1: "title"}}, [(2, 0, TWO, "image1.png", b"ABC1234")]
    for k, i, plate, texts in map(_FIELDS, own):
        first = 3 + 30 * int(k)
        rows[first] = {1: int(k) + 1, 2: f"ID{i}", 3: "01/02/2024", 12: plate, 14: f"c{int(k) % 3}", 15: "2"}
        pictures += [(first + n, 0, TWO, f"m{i}-{n}.png", (t or "").encode()) for n, t in enumerate(texts, 1)]
        pictures.append((first + 1, 0, ONE, f"x{i}.png", b"not read"))
    return workbook(rows, pictures)


def single(own: list[dict]) -> bytes:
    """One passage in row 6 of the sheet of photographs, pictures from row 5 on, a drawing among them."""
    r = own[0]
    pictures = [(5, 0, TWO, "early.png", b"ABC1234"), (6, 0, TWO, "logo.EMF", b"ABC1234")]
    pictures += [(6 + n, 0, TWO, f"m{n}.png", (t or "").encode()) for n, t in enumerate(r["texts"], 1)]
    return workbook({1: {1: "t"}, 6: {2: f"ID{r['passage_id']}", 3: "01/02/2024", 12: r["expected_plate"], 14: "2"}}, pictures, title="Fotos")


def table(header: int, titles: list[str]) -> Callable[[list[dict]], bytes]:
    """A table below a header row: plate, id and date by their titles, the last column names a picture beside the workbook.

    Of every three rows one names a picture that is there, one a picture that is not there, one nothing; even rows have
    two pictures in the sheet, the first of every other one anchored at the foot of the row before.
    """

    def build(own: list[dict]) -> bytes:
        rows, pictures, heights = {1: {1: "x"}, header: dict(enumerate(titles, 1))}, [], {}
        for k, i, plate, texts in map(_FIELDS, own):
            row, k = header + 1 + int(k), int(k)
            values = {"Placa": plate, "ID_PASSAGEM": f"ID{i}", "ID Transacao": f"ID{i}", "DATA HORA": "d", "Data Passagem": "d", "Hora Passagem": "h", "Categoria": str(k % 5)}
            rows[row] = {c: values[t] for c, t in enumerate(titles, 1) if t in values}
            rows[row][len(titles)] = (f'"p{i}.png"' if k % 2 else f"p{i}.png", " none.png", "nan")[k % 3]
            content = (texts[0] if len(texts) and texts[0] else "").encode()
            if k % 2 == 0:
                heights[row - 1] = 30.0 if k % 8 == 0 else 15.0
                # half of 30 points is 190,500 EMU: the first stays in its row there, the second goes to the next
                pictures.append((row - 1, 190_000, ONE, f"m{i}.png", content) if k % 4 == 0 else (row, 0, TWO, f"m{i}.png", content))
                pictures.append((row, 10, ONE, f"z{i}.png", b"ABC1234"))
        return workbook(rows, pictures, heights=heights)

    return build


def reference(own: list[dict]) -> bytes:
    """A reference sheet whose titles are synonyms with accents, in row 5; ids in any case, some twice."""
    rows = {1: {1: "x"}, 5: {1: " Id Passagem", 2: "PLACA  Veículo", 3: "Data", 5: "Classe Veiculo"}}
    for k, (i, plate) in enumerate((r["passage_id"], r["expected_plate"]) for r in own):
        rows[6 + k] = {1: f" id{i // 2 * 2} ", 2: plate, 3: f"d{i}", 5: f"c{k % 3}"}
    return workbook(rows)


def pages_of(content: bytes) -> Iterator[tuple[str, list[dict]]]:
    """A backend for files that are JSON of pages (page, texts): pictures one below the other, wide but for the empty ones."""
    for page in json.loads(content):
        text, pictures = page["page"], page["texts"]
        yield text, [{"width": 400 if t else 60, "height": 300, "x0": 0.0, "y0": float(60 * n), "x1": 100.0, "y1": float(60 * n + 50), "content": t.encode()} for n, t in enumerate(pictures)]


def as_text(images: DataFrame) -> DataFrame:
    """A stand-in for reading images: their bytes are the text; none if they are empty."""
    return images.select("passage_id", "image_ix", F.nullif(F.decode("content", "UTF-8"), F.lit("")).alias("ocr_text"))


class ByteDetector:
    """A stand-in detector: one usable box in images of seven bytes and more, boxes of low confidence in the others."""

    def detect(self, contents: list[bytes]) -> list[list[tuple[float, float, float, float, float]]]:
        return [[(0.0, 0.0, 90.0, 30.0, 0.9 if len(x) >= 7 else 0.2), (0.0, 0.0, 30.0, 30.0, 0.3)] for x in contents]


class ByteReader:
    """A stand-in reader: the bytes in two parts, then as a whole with more confidence."""

    def read(self, content: bytes, box: tuple[int, int, int, int]) -> list[list[tuple[str, float]]]:
        text = content.decode()
        return [[(text[:3], 0.5), (text[3:], 0.5)], [(text, 0.99)]]
