"""Pages of PDF files through a backend, a range of pages a task.

A backend opens a file and gives a document: how many pages it has, a page's text, a page's images (dicts with width,
height, x0, y0, x1, y1 and content). Only what is asked for is taken out of a page. PyMuPdf needs a PDF library, which is
imported on use. A function of a file's bytes that gives all pages, (text, images) each, is a backend too, but has no ranges.

Files are read from a folder by a data source of Spark, whose partitions are ranges of pages: a large file is opened once to
count its pages and then by each task that reads some of them; small files share a task. A table of files (file, content) is read a
file at a time; `scanned` opens each of its files once, for texts and images. A row of a page has the places of its images, so what is chosen among
them, or told by the page's text, needs no exchange.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import BinaryIO, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import chunks, opened

_PAGES = "file string, page int, text string"
_IMAGES = "file string, page int, ord int, width int, height int, x0 double, y0 double, x1 double, y1 double, content binary"
_FIELDS = [x.split()[0] for x in _IMAGES.split(", ")][3:]
_PLACES = _IMAGES.removesuffix(", content binary")
_NESTED = "array<struct<ord:int,width:int,height:int,x0:double,y0:double,x1:double,y1:double,content:binary>>"
_WITH_PLACES = f"{_PAGES}, images {_NESTED}"
_SCAN = f"{_WITH_PLACES}, apart boolean, ord int, content binary"
#: Pages of a task, and bytes from which on a file's pages are dealt out.
RANGE, LARGE = 200, 8 << 20
#: Bytes of a page's images up to which they stay in the page's row.
TOGETHER = 16 << 20


class Document(Protocol):
    def __len__(self) -> int: ...
    def text(self, page: int) -> str: ...
    def images(self, page: int) -> list[dict]: ...


class Backend(Protocol):
    def open(self, file: BinaryIO) -> Document: ...


class _MuPdfDocument:
    def __init__(self, document):
        self.document = document

    def __len__(self) -> int:
        return len(self.document)

    def text(self, page: int) -> str:
        return self.document[page].get_text("text")

    def images(self, page: int) -> list[dict]:
        own, out = self.document[page], []
        for info in own.get_images(full=True):
            found = self.document.extract_image(info[0])
            for rect in own.get_image_rects(info[0]):
                out.append({"width": found["width"], "height": found["height"], "x0": rect.x0, "y0": rect.y0, "x1": rect.x1, "y1": rect.y1, "content": found["image"]})
        return out


class PyMuPdf:
    """Documents by PyMuPDF; a clear error where it is not installed."""

    def open(self, file: BinaryIO) -> Document:
        try:
            import fitz
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pymupdf, or a backend of your own") from e
        return _MuPdfDocument(fitz.open(stream=file.read(), filetype="pdf"))


default_backend = PyMuPdf()


class _Whole:
    """The pages that a function has given, as a document."""

    def __init__(self, pages: list[tuple[str, list[dict]]]):
        self.pages = pages

    def __len__(self) -> int:
        return len(self.pages)

    def text(self, page: int) -> str:
        return self.pages[page][0]

    def images(self, page: int) -> list[dict]:
        return self.pages[page][1]


def document(backend, file: BinaryIO) -> Document:
    """A file's document by a backend of either kind."""
    return backend.open(file) if hasattr(backend, "open") else _Whole(list(backend(file.read())))


def _texts(file: str, document: Document, pages: range) -> Iterator[tuple]:
    return ((file, k + 1, document.text(k)) for k in pages)


def _pictures(file: str, document: Document, pages: range) -> Iterator[tuple]:
    return ((file, k + 1, n, *(i[x] for x in _FIELDS)) for k in pages for n, i in enumerate(document.images(k), 1))


def _places(file: str, document: Document, pages: range) -> Iterator[tuple]:
    return (x[:-1] for x in _pictures(file, document, pages))


def _listed(images: list[dict], content: bool = False) -> list[tuple]:
    return [(n, *(i[x] for x in _FIELDS[:-1]), i["content"] if content else None) for n, i in enumerate(images, 1)]


def _with_places(file: str, document: Document, pages: range) -> Iterator[tuple]:
    return ((file, k + 1, document.text(k), _listed(document.images(k))) for k in pages)


@dataclass
class PageRange(InputPartition):
    """Files with their first page and the page after the last; None: all pages."""

    files: tuple[tuple[str, int, int | None], ...]


class _Reader(DataSourceReader):
    def __init__(self, backend, options: Mapping[str, str], rows: Callable):
        self.backend, self.rows, self.path = backend, rows, options["path"]
        self.pages, self.large = int(options.get("pagesPerTask", RANGE)), int(options.get("largeBytes", LARGE))

    def partitions(self) -> list[PageRange]:
        out, small, size = [], [], 0
        for file, n in opened.listed(self.path, "pdf"):
            if n >= self.large:
                with opened.opened(file) as f:
                    count = len(document(self.backend, f))
                out += [PageRange(((file, k, min(k + self.pages, count)),)) for k in range(0, count, self.pages)]
                continue
            if small and size + n > self.large:
                out, small, size = [*out, PageRange(tuple(small))], [], 0
            small.append((file, 0, None))
            size += n
        return [*out, PageRange(tuple(small))] if small else out

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for file, first, stop in partition.files if partition else ():  # none: no file
            with opened.opened(file) as f:
                own = document(self.backend, f)
                yield from self.rows(file, own, range(first, len(own) if stop is None else stop))


def _source(title: str, columns: str, rows: Callable, backend) -> type[DataSource]:
    class PdfSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return _Reader(backend, self.options, rows)

    return PdfSource


@dataclass(frozen=True)
class Folder:
    """PDF files of a path; options: pagesPerTask, and largeBytes, from which on a file is dealt out."""

    spark: SparkSession
    path: str
    options: tuple[tuple[str, object], ...] = ()


def _read(files: DataFrame | Folder, backend, title: str, columns: str, rows: Callable) -> DataFrame:
    if isinstance(files, Folder):
        files.spark.dataSource.register(_source(title, columns, rows, backend))
        return files.spark.read.format(title).options(**dict(files.options)).load(files.path)

    def each(file: str, content: bytes) -> Iterator[tuple]:
        own = document(backend, io.BytesIO(content))
        return rows(file, own, range(len(own)))

    def over(batches):
        return chunks.batches((row for batch in batches for x in chunks.files(batch) for row in each(*x)), columns)

    return files.select("file", "content").mapInArrow(over, columns)


def _all(content: bool) -> Callable:
    """What `scanned` keeps of each page: its text and images; those of a page of over TOGETHER bytes have rows of their own for their bytes."""
    most = TOGETHER

    def rows(file: str, document: Document, pages: range) -> Iterator[tuple]:
        for k in pages:
            images = document.images(k)
            apart = content and sum(len(i["content"] or b"") for i in images) > most
            yield file, k + 1, document.text(k), _listed(images, content and not apart), apart, None, None
            if apart:
                yield from ((file, k + 1, None, [], None, n, i["content"]) for n, i in enumerate(images, 1))

    return rows


def scanned(files: DataFrame, backend=default_backend, content: bool = True, made: Callable[[DataFrame], DataFrame] = lambda pages: pages) -> tuple[DataFrame, DataFrame]:
    """made(pages) of a table of files (file, content), from one look at each file, and the bytes (file, page, ord, content) of images that are apart; written to the scratch folder.

    pages are (file, page, text, images, apart), images being an array of ord, width, height, corners and content, null if apart; made adds columns or drops text.
    """
    from .scratch import written

    found = written(made(_read(files, backend, "pdf_scan", _SCAN, _all(content))), "pages", of_files=True)
    return found.where("ord is null").drop("ord", "content"), found.where("ord is not null").select("file", "page", "ord", "content")


def with_places(files: Folder, backend=default_backend) -> DataFrame:
    """(file, page, text, images) of PDF files, as of `scanned`, without content."""
    return _read(files, backend, "pdf_with_places", _WITH_PLACES, _with_places)


def pages(files: DataFrame | Folder, backend=default_backend) -> DataFrame:
    """(file, page from 1, text) of PDF files; a file that cannot be read stops the job with its error."""
    return _read(files, backend, "pdf_pages", _PAGES, _texts)


def page_images(files: DataFrame | Folder, backend=default_backend, content: bool = True) -> DataFrame:
    """The images of the pages of PDF files, ord from 1 in the backend's order, with their bytes or (content=False) without."""
    return _read(files, backend, "pdf_images", _IMAGES, _pictures) if content else _read(files, backend, "pdf_places", _PLACES, _places)


def whole_text(found: DataFrame) -> DataFrame:
    """(file, text): the texts of a file's pages that have any, in order, a line break between."""
    own = found.where("text <> ''").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return own.select("file", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def placed(images: Column, native: tuple[int, int] = (80, 40), shown: float = 20) -> Column:
    """Of a page's images those of at least the native size in pixels, shown at least so many points wide and high."""
    return F.filter(images, lambda i: (i["width"] >= native[0]) & (i["height"] >= native[1]) & (i["x1"] - i["x0"] >= shown) & (i["y1"] - i["y0"] >= shown))


def wide(images: Column, width: int = 100) -> Column:
    """Of a page's images those wider than so many pixels."""
    return F.filter(images, lambda i: i["width"] > width)
