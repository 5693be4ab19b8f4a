"""The nine providers' layouts: where their passages and images are, how a passage is judged, what is reported.

pipeline(name) takes a path to a file or folder, or a table of files (file, content), and how images are read, and
gives the report as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plate as P
from ..functions import text as T
from ..functions import values as V
from ..operators import associate, elect, report, sheets
from ..sources import files as S
from ..sources import pdf, xlsx
from ..sources.scratch import written

#: The logo in the block workbooks, and picture types that are no photographs.
LOGO, DRAWN = ("image1.png",), (".emf", ".wmf")
#: The last row that can be a header.
HEADS = 40
_ROAD = ("sp", "km", "plaza", "lane", "direction", "city", "code")
_OCR = {"plate_result": "Placa OCR", "ocr_raw": "OCR Bruto", "status": "Status OCR", "difference": "Diferença OCR", "image_used": "Imagem Usada", "total_images": "Total Imagens", "images_with_ocr": "Imagens c/ OCR"}
_MATCHED = {"plate_result": "Placa OCR", "ocr_raw": "OCR Bruto", "status": "Status OCR", "matches": "Caracteres coincidentes", "difference": "Diferenca OCR", "image_used": "Imagem Usada", "total_images": "Total Imagens", "images_with_ocr": "Imagens c/ OCR"}


def _key(*columns: str):
    return F.xxhash64(*columns).alias("passage_id")


def _opened(spark: SparkSession, path: str | DataFrame, late: bool = False, skip: bool = False, every: bool = False, whole: bool = False) -> tuple[DataFrame, bool, DataFrame]:
    """What `xlsx.scanned` gives; whether its anchors have their pictures with them; the pictures' bytes by file and name. Workbooks of a table are opened once, and what is in them is kept."""
    kept = isinstance(path, DataFrame) and not late
    scan = xlsx.scanned(spark, path, every, skip, contents=kept, whole=whole)
    if not kept:
        return scan, False, xlsx.media(S.files(spark, path, "xlsx"), skip)
    return scan, scan.where("kind = 'media'").isEmpty(), scan.where("content is not null").select("file", "media", "content")


def _with_content(placed: DataFrame, contents: DataFrame, late: bool) -> DataFrame:
    """(passage_id, image_ix, content): pictures that are not with their anchors come last, so that only names are sorted and counted; late: file and part (see `sources.late`)."""
    if late:
        return placed.select("passage_id", "image_ix", "file", F.col("media").alias("part"))
    if "content" in placed.columns:
        return placed.where("content is not null").select("passage_id", "image_ix", "content")
    return placed.join(contents, ["file", "media"]).select("passage_id", "image_ix", "content")


def _pages(spark: SparkSession, path: str | DataFrame, backend, late: bool, made: Callable[[DataFrame], DataFrame] = lambda pages: pages) -> tuple[DataFrame, DataFrame, DataFrame]:
    """made(pages) for their texts, made(pages) for their images, and bytes of images that are not with these; the files of a table are opened once, and what is in them is kept."""
    if isinstance(path, DataFrame):
        own, contents = pdf.scanned(S.files(spark, path, "pdf"), backend, not late, made)
        return own, own, contents
    folder = pdf.Folder(spark, path)
    return made(pdf.pages(folder, backend)), made(pdf.with_places(folder, backend)), pdf.page_images(folder, backend).select("file", "page", "ord", "content")


def _image(places: DataFrame) -> list[str]:
    """The columns of an image i of a page that `_pictured` takes."""
    return ["file", "page", "i.ord", *(("i.content", "apart") if "apart" in places.columns else ())]


def _pictured(picked: DataFrame, contents: DataFrame, late: bool) -> DataFrame:
    """(passage_id, image_ix, content) of what was picked (passage_id, image_ix, file, page, ord), its bytes with it unless they are apart; late: file and part."""
    if late:
        return picked.select("passage_id", "image_ix", "file", F.concat_ws("/", "page", "ord").alias("part"))
    named = lambda x: x.select("passage_id", "image_ix", "content")
    if "apart" not in picked.columns:
        return named(picked.join(contents, ["file", "page", "ord"]))
    return named(picked.where("not apart")).unionByName(named(picked.where("apart").drop("content").join(contents, ["file", "page", "ord"])))


def _first_sheet(cells: DataFrame, preferred: str) -> DataFrame:
    """The cells of each file's preferred sheet, if it has it, else all."""
    has = cells.groupBy("file").agg(F.max(F.col("sheet") == preferred).alias("has"))
    return cells.join(has, "file").where(~F.col("has") | (F.col("sheet") == preferred)).drop("has")


def read_spvias(spark: SparkSession, path: str, late: bool = False, skip: bool = False, **_):
    """Blocks that begin where column A counts; images anchored in a block's rows, without the logo."""
    scan, together, contents = _opened(spark, path, late, skip)
    cells = xlsx.cells(scan)
    blocks = associate.blocks(cells)
    names = ("seq", "external_id", "date", "time", *_ROAD, "expected_plate", "model", "category", "axles", "fare", "responsible")
    rows = sheets.record_rows(cells, {n: k for k, n in enumerate(names, 1)}, blocks.select("file", F.col("first_row").alias("row")))
    passages = rows.select(_key("file", "row"), "*")
    placed = associate.images_in_blocks(blocks.select("file", "first_row"), xlsx.anchors(scan, without=LOGO, contents=together))
    return passages, _with_content(placed.withColumn("passage_id", F.xxhash64("file", "first_row")), contents, late)


def read_colinas(spark: SparkSession, path: str, late: bool = False, skip: bool = False, **_):
    """One passage in row 6 of the sheet of photographs; all images from that row on."""
    scan, together, contents = _opened(spark, path, late, skip)
    cells = _first_sheet(xlsx.cells(scan), "Fotos").where("row = 6")
    names = ("external_id", "date", "time", *_ROAD, "expected_plate", "model", "axles", "fare", "responsible")
    passages = sheets.record_rows(cells, {n: k for k, n in enumerate(names, 2)}).select(_key("file", "row"), "*")
    placed = associate.images_from_row(passages.select("file", "passage_id"), xlsx.anchors(scan, without_types=DRAWN, contents=together))
    return passages, _with_content(placed, contents, late)


def _named_rows(cells: DataFrame, rows: DataFrame, heads: DataFrame, fields: dict[str, tuple[str, ...]], is_image) -> DataFrame:
    """(file, row, *fields, images) of rows (file, row, cells) below the header row of each file; fields by the strict names of their column, images in column order.

    Files whose header lacks a field are left out, and rows without a cell below a title; of columns alike the last counts.
    """
    # the few cells of headers give a row for each file, which meets the rows by file alone
    titles = cells.where(F.col("row") <= HEADS).join(heads.select("file", F.col("header_row").alias("row")), ["file", "row"]).select("file", "row", "col", V.strict_name(F.col("raw")).alias("name"), F.col("raw").alias("title"))
    ranked = [F.when(F.col("name").isin(*map(V.strict_key, names)), F.col("col")) for names in fields.values()]
    shown = F.when(is_image(F.col("name"), F.col("title")), F.struct("col", "title"))
    have = titles.groupBy("file").agg(*(F.max(c).alias(n) for n, c in zip(fields, ranked, strict=True)), F.max("row").alias("header_row"), F.collect_set("col").alias("cols"), F.collect_list(shown).alias("shown")).na.drop()
    body = rows.join(have, "file").where((F.col("row") > F.col("header_row")) & F.arrays_overlap("cells.col", "cols"))
    named = F.filter("cells", lambda c: F.array_contains("shown.col", c["col"]) & V.has_value(c["raw"]))
    value = lambda c: F.trim(F.translate(c["raw"], '"', ""))
    images = F.transform(named, lambda c: F.transform(F.filter("shown", lambda t: t["col"] == c["col"]), lambda t: F.struct(t["col"].alias("col"), value(c).alias("value"), t["title"].alias("title"))))
    return body.select("file", "row", *(xlsx.value_at(F.col(n)).alias(n) for n in fields), F.array_sort(F.flatten(images)).alias("images"))


def _tables(spark: SparkSession, path: str | DataFrame, heads, fields, is_image, sound=S.is_picture, fetch: Callable[[DataFrame], DataFrame] | None = None, skip: bool = False):
    """Tables with at most one image a row: the first named file beside the workbook that is a picture, else the first such picture on the row.

    sound says of a column of bytes whether they are a picture; what is none is passed over. fetch takes addresses
    (path) and gives (path, content), such as `files.fetched` for trusted hosts; without it cells with addresses name nothing.
    """
    scan, together, contents = _opened(spark, path, skip=skip, every=True, whole=True)
    cells = xlsx.cells(scan)
    rows = written(_named_rows(cells, xlsx.rows(scan), heads(cells), fields, is_image), "rows")
    passages = rows.select(_key("file", "row"), "*")
    folder = F.regexp_replace("file", r"[^/]*\z", "")
    named = passages.select("passage_id", folder.alias("folder"), F.posexplode("images").alias("n", "i"))
    named = named.select("passage_id", "n", F.when(F.col("i.value").rlike("^(/|[a-z]+:)"), F.col("i.value")).otherwise(F.concat("folder", "i.value")).alias("path"), F.col("i.title").alias("origin"))
    parent = path if isinstance(path, DataFrame) or not path.lower().endswith(".xlsx") else path.rsplit("/", 1)[0]
    beside = S.files(spark, parent, *S.IMAGE_TYPES).select(F.col("file").alias("path"), "content")
    if fetch:
        beside = beside.unionByName(fetch(named.where(F.col("path").rlike("^https?://")).select("path")))
    from_files = named.join(beside.where(sound(F.col("content"))), "path").groupBy("passage_id").agg(F.min_by(F.struct("origin", "content"), "n").alias("a"))
    anchored = xlsx.anchors(scan, contents=together)
    anchored = anchored.withColumn("row", associate.shifted_row(F.col("anchor_row"), F.col("row_off"), F.col("row_height")))
    pictures = anchored if together else anchored.join(contents, ["file", "media"])
    pictures = pictures.where(F.col("content").isNotNull() & sound(F.col("content"))).select("file", "row", "media", "ord", "content")
    first = pictures.groupBy("file", "row").agg(F.min_by(F.struct(F.col("media").alias("origin"), "content"), "ord").alias("b"))
    embedded = passages.select("passage_id", "file", "row").join(first, ["file", "row"]).select("passage_id", "b")
    chosen = passages.select("passage_id").join(from_files, "passage_id", "left").join(embedded, "passage_id", "left").select("passage_id", F.coalesce("a", "b").alias("c")).where("c is not null")
    passages = passages.join(chosen.select("passage_id", F.col("c.origin").alias("origin")), "passage_id", "left").drop("images")
    return passages, chosen.select("passage_id", F.lit(1).alias("image_ix"), "c.content")


def read_eixovp(spark: SparkSession, path: str, sound=S.is_picture, fetch=None, skip: bool = False, **_):
    """A table whose header is found by its names in the first 40 rows."""
    fields = {"expected_plate": ("PLACA",), "external_id": ("ID_PASSAGEM",), "date_time": ("DATA_HORA",)}
    heads = lambda cells: sheets.header_rows(cells, ("placa", "idpassagem", "datahora"), HEADS)
    return _tables(spark, path, heads, fields, lambda name, title: name.contains("imagem") | name.contains("foto"), sound, fetch, skip)


def read_bandeiras(spark: SparkSession, path: str, sound=S.is_picture, fetch=None, skip: bool = False, **_):
    """A table whose header is row 8."""
    fields = {"external_id": ("ID Transacao", "ID Transação", "ID"), "date": ("Data Passagem",), "time": ("Hora Passagem",), "category": ("Categoria",), "expected_plate": ("Placa",)}
    heads = lambda cells: cells.select("file").distinct().withColumn("header_row", F.lit(8).cast("long"))
    return _tables(spark, path, heads, fields, lambda name, title: F.lower(F.trim(title)).startswith("imagem da passagem"), sound, fetch, skip)


#: What the columns of a reference sheet may be called.
SYNONYMS = {
    "id": ("id", "passagem", "numero", "numeroid", "idpassagem", "idsistema", "id sistema", "id passagem", "id transacao"), "plate": ("placa", "placaveiculo", "placa veiculo"),
    "date": ("data", "data passagem", "datapassagem"), "time": ("hora", "hora passagem", "horapassagem"), "category": ("categoria", "cat", "classeveiculo", "classe veiculo", "tipoveiculo"),
}


def reference_sheet(spark: SparkSession, path: str, header: int = 5) -> DataFrame:
    """(id, plate, date, time, category, sheet_row) of a sheet with a header row; columns that are missing are empty, ids upper case."""
    scan = xlsx.scanned(spark, path, whole=True)
    loose = F.regexp_replace(F.lower(F.trim(T.without_accents(F.col("raw")))), r"\s+", " ")
    titles = xlsx.cells(scan).where(F.col("row") == header).select("file", "col", loose.alias("name"))
    place = lambda names: F.min(F.when(F.col("name").isin(*names), F.struct(F.array_position(F.array(*map(F.lit, names)), F.col("name")).alias("p"), "col")))["col"]
    have = titles.groupBy("file").agg(*(place(list(names)).alias(f"c_{n}") for n, names in SYNONYMS.items()))
    body = xlsx.rows(scan).where(F.col("row") > header).join(have, "file").select("file", "row", *(xlsx.value_at(F.col(f"c_{n}")).alias(n) for n in SYNONYMS))
    return body.select(F.upper(F.trim(F.coalesce("id", F.lit("")))).alias("id"), *(F.coalesce(n, F.lit("")).alias(n) for n in ("plate", "date", "time", "category")), F.col("row").alias("sheet_row"))


def read_tamoios(spark: SparkSession, path: str, sheet: str = "", late: bool = False, **_):
    """A folder of images, one passage each, whose names begin with the id of a row of the reference sheet."""
    images = S.files(spark, path, *S.IMAGE_TYPES)
    ident = T.file_id(F.col("name"))
    named = images.select("file", "name", ident["id"].alias("id"), ident["ok"].alias("id_ok"))
    joined = associate.with_reference(named, reference_sheet(spark, sheet))
    passages = joined.select(_key("file"), "*", F.when(F.trim(F.upper("plate")) != "", F.trim(F.upper("plate"))).alias("expected_plate"))
    ok = passages.where("id_status = 'ID - OK'").select("passage_id", "file")
    if late:
        return passages, ok.select("passage_id", F.lit(1).alias("image_ix"), "file", F.lit(None).cast("string").alias("part"))
    return passages, ok.join(images.select("file", "content"), "file").select("passage_id", F.lit(1).alias("image_ix"), "content")


def _marked(pages: DataFrame) -> DataFrame:
    """The passages of pages that have several, after a marker, as an array in the text's place."""
    fields = lambda b: {"date_time": T.date_time(b), "category": T.category(b), "expected_plate": T.first_plate(b)}
    parts = F.transform(T.blocks_after(F.col("text"), "Data/Hora"), lambda b, n: F.struct(n.alias("n"), *(c.alias(x) for x, c in fields(b).items())))
    return pages.withColumn("marks", F.filter(parts, lambda x: x["date_time"].isNotNull() & x["category"].isNotNull() & x["expected_plate"].isNotNull())).drop("text")


def _of_marks(pages: DataFrame) -> DataFrame:
    return pages.select("file", "page", F.posexplode("marks").alias("k", "m")).select(_key("file", "page", "k"), "file", "page", "m.*", "k")


def read_autoban(spark: SparkSession, path: str, backend=pdf.default_backend, late: bool = False, **_):
    """Several passages on a page, after a marker; each takes the next three images of the page, from its top."""
    texts, places, contents = _pages(spark, path, backend, late, _marked)
    ordered = F.array_sort(F.transform(pdf.placed(F.col("images")), lambda i: F.struct(*(i[x].alias(x) for x in ("y0", "x0", "ord", "content")))))
    placed = places.select("*", F.posexplode(F.slice(ordered, F.lit(1), 3 * F.size("marks"))).alias("n", "i")).withColumn("k", F.floor(F.col("n") / 3).cast("int"))
    placed = placed.select(_key("file", "page", "k"), (F.col("n") % 3 + 1).alias("image_ix"), *_image(places))
    return _of_marks(texts), _pictured(placed, contents, late)


def read_prototype(spark: SparkSession, path: str, backend=pdf.default_backend, **_):
    """As read_autoban, but the k-th passage of a page takes its k-th image as the page lists them, of any size and place; none if there are fewer."""
    texts, places, contents = _pages(spark, path, backend, False, _marked)
    placed = places.select("*", F.posexplode(F.slice("images", F.lit(1), F.size("marks"))).alias("k", "i"))
    return _of_marks(texts), _pictured(placed.select(_key("file", "page", "k"), F.lit(1).alias("image_ix"), *_image(places)), contents, False)


def _with_ids(pages: DataFrame) -> DataFrame:
    """Pages with what their text says of a passage, in its place."""
    own = pages.withColumn("text", F.replace("text", F.lit('"'), F.lit(""))).withColumn("external_id", T.transaction_id(F.col("text")))
    lines = F.filter(F.transform(F.split("text", "\n"), T.trimmed), lambda x: x != "")
    own = own.withColumn("lines", lines).withColumn("at", F.array_position("lines", F.col("external_id")).cast("int"))
    listed = (F.col("at") > 0) & (F.size("lines") >= F.col("at") + 2)
    second = F.get("lines", F.col("at") + 1)
    plate = F.coalesce(F.when(listed & P.is_valid(second), second), T.bounded_plate(F.col("text")), F.lit("N/A"))
    category = F.when(listed, F.get("lines", F.col("at"))).otherwise("01")
    return own.withColumns({"date_time": T.labelled_date(F.col("text")), "category": category, "expected_plate": plate}).drop("text", "lines", "at")


def read_eixosp(spark: SparkSession, path: str, backend=pdf.default_backend, late: bool = False, **_):
    """One passage on a page that has a transaction id; category and plate on the lines after it."""
    texts, places, contents = (x.where("external_id is not null") if "external_id" in x.columns else x for x in _pages(spark, path, backend, late, _with_ids))
    passages = texts.select(_key("file", "page"), "file", "page", "external_id", "date_time", "category", "expected_plate")
    placed = places.select("*", F.posexplode(pdf.wide(F.col("images"))).alias("n", "i"))
    return passages, _pictured(placed.select(_key("file", "page"), (F.col("n") + 1).alias("image_ix"), *_image(places)), contents, late)


def _areas(pages: DataFrame) -> DataFrame:
    """Pages with areas: struct(page, ord, area) of their images that have an area."""
    area = lambda i: i["width"].cast("long") * i["height"]
    each = F.transform(F.filter("images", lambda i: area(i) > 0), lambda i: F.struct(F.col("page").alias("page"), i["ord"].alias("ord"), area(i).alias("area")))
    return pages.withColumn("areas", each)


def _photos(files: DataFrame, fair: int) -> DataFrame:
    """files (areas, ...) of one passage each, a row for each of its photographs: its place n and page and ord in i."""
    return files.select(*(c for c in files.columns if c != "page"), F.posexplode(associate.large_of(F.col("areas"), fair=fair)).alias("n", "i")).withColumn("page", F.col("i.page"))


def read_ecovias(spark: SparkSession, path: str, backend=pdf.default_backend, late: bool = False, **_):
    """One passage in a file, on one line of its text; its photographs by area."""
    texts, places, contents = _pages(spark, path, backend, late)
    own = pdf.whole_text(texts).select("file", T.line_parts(T.passage_line(T.normalize_text(F.col("text")))).alias("l"))
    own = (written(own, "lines") if isinstance(path, DataFrame) else own).where("l is not null")
    areas = _areas(places).select("file", "areas").where(F.size("areas") > 0).groupBy("file").agg(F.array_sort(F.flatten(F.collect_list("areas"))).alias("areas"))
    photos = _photos(areas.join(own.select("file"), "file"), fair=10_000).select(_key("file"), (F.col("n") + 1).alias("image_ix"), "file", "page", "i.ord")
    if "apart" in places.columns:  # a file's photographs are of several pages
        contents = places.where("not apart").select("file", "page", F.inline("images")).select(contents.columns).unionByName(contents)
    own = own.withColumn("r", T.road_and_km(F.col("l.prefix")))
    rest = F.when(F.col("r.rest") != "", F.col("r.rest")).otherwise(F.col("l.prefix"))
    own = own.withColumns({"w": T.place_parts(rest), "v": T.vehicle_parts(F.col("l.suffix")), "a": T.alerts(F.col("l.id"), F.col("l.date"), F.col("l.time"), F.col("l.plate"))})
    passages = own.select(_key("file"), "file", F.col("l.id").alias("external_id"), "l.date", "l.time", F.col("l.plate").alias("expected_plate"), "r.sp", "r.km", "w.*", "v.*", T.passage_status(F.col("a")).alias("parse_status"), F.array_join("a", "; ").alias("alerts"))
    return passages, _pictured(photos, contents, late)


def read_intervias(spark: SparkSession, path: str, backend=pdf.default_backend, late: bool = False, **_):
    """One passage in a file, its fields by place on the first line that begins with a long id, on the first page."""
    first = lambda pages: pages.withColumn("t", F.when(F.col("page") == 1, T.token_fields(T.token_line(F.col("text"))))).drop("text")
    texts, places, contents = _pages(spark, path, backend, late, first)
    passages = texts.where("t is not null").select(_key("file"), "file", "t.*").withColumnsRenamed({"id": "external_id", "plate": "expected_plate"})
    photos = _photos(_areas(places.where("t is not null")), fair=1 << 62).withColumn("i", F.get("images", F.col("i.ord") - 1))
    return passages, _pictured(photos.select(_key("file"), (F.col("n") + 1).alias("image_ix"), *_image(places)), contents, late)


@dataclass(frozen=True)
class Provider:
    """How a provider's documents are read, judged and reported."""

    name: str
    read: Callable
    labels: dict[str, str]
    by_matches: bool = False
    options: dict = field(default_factory=dict)

    def evaluate(self, passages: DataFrame, reads: DataFrame) -> DataFrame:
        own = passages.select("passage_id", "expected_plate")
        return elect.evaluate_by_matches(own, reads) if self.by_matches else elect.evaluate_by_distance(own, reads, **self.options)


_FILE = {"file": "Arquivo"}
PROVIDERS = {p.name: p for p in (
    Provider("ecovias", read_ecovias, _FILE | {"external_id": "ID", "date": "Data", "time": "Hora", "expected_plate": "Placa Esperada", "axles": "Eixos", "parse_status": "Status Passagem", "alerts": "Alertas Passagem"} | _OCR),
    Provider("eixovp", read_eixovp, _FILE | {"row": "Linha Excel", "external_id": "ID_PASSAGEM", "date_time": "DATA_HORA", "expected_plate": "Placa Esperada", "origin": "Origem Imagem"} | _MATCHED, by_matches=True),
    Provider("bandeiras", read_bandeiras, _FILE | {"row": "Linha Excel", "external_id": "ID", "date": "Data passagem", "time": "Hora passagem", "category": "Categoria", "expected_plate": "Placa Esperada", "origin": "Coluna Imagem Usada"} | _MATCHED, by_matches=True),
    Provider("autoban", read_autoban, {"page": "Pagina", "date_time": "Data/Hora", "category": "Categoria", "expected_plate": "Placa (Texto)", "plate_result": "Placa (Imagem/OCR)", "ocr_raw": "OCR Bruto", "status": "Status OCR", "difference": "Diferenca OCR", "image_used": "Imagem Usada", "total_images": "Qtd Imagens Candidatas"}, options={"raw": "normalized"}),
    Provider("intervias", read_intervias, _FILE | {"external_id": "ID", "date": "Data", "time": "Hora", "sp": "SP", "km": "KM", "plaza": "Praça", "lane": "Pista", "direction": "Sentido", "city": "Município", "code": "Código", "expected_plate": "Placa Esperada", "model": "Modelo", "axles": "Eixos", "fare": "Tarifa", "responsible": "Responsável"} | _OCR),
    Provider("colinas", read_colinas, _FILE | {"external_id": "ID", "date": "Data", "time": "Hora", "plaza": "Praça", "direction": "Sentido", "city": "Município", "code": "Código", "expected_plate": "Placa Esperada", "axles": "Eixos"} | _OCR),
    Provider("spvias", read_spvias, _FILE | {"seq": "Seq", "external_id": "ID Sistema", "date": "Data", "expected_plate": "Placa Esperada", "category": "Categoria", "axles": "Eixos"} | _OCR | {"row": "Linha Excel"}),
    Provider("tamoios", read_tamoios, {"name": "Arquivo", "id": "ID Extraído", "id_status": "Status ID", "plate": "Placa Planilha", "date": "Data", "time": "Hora", "category": "Categoria"} | _OCR),
    Provider("eixosp", read_eixosp, {"external_id": "ID Extraído", "page": "Pagina PDF", "date_time": "Data/Hora", "category": "Categoria", "expected_plate": "Placa Planilha", "plate_result": "Placa OCR", "ocr_raw": "OCR Bruto", "status": "Status OCR", "difference": "Diferença OCR", "image_used": "Imagem Usada", "total_images": "Total Imagens", "difference_number": "Diferença Numérica", "priority": "Prioridade"}, options={"show": "read", "raw": "normalized"}),
)}


def evaluated(provider: Provider, passages: DataFrame, images: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """passages with their evaluation. read takes images (passage_id, image_ix, mask, expected_plate, and content or, of a late reading, file and part) and
    gives (passage_id, image_ix, ocr_text).

    Images without a reading count as unread. In the folder layout rows without a sheet row keep empty results.
    """
    masks = passages.select("passage_id", P.mask_of(F.col("expected_plate")).alias("mask"), "expected_plate")
    held = [c for c in ("content", "file", "part") if c in images.columns]
    reads = read(images.join(masks, "passage_id").select("passage_id", "image_ix", "mask", "expected_plate", *held))
    out = passages.join(provider.evaluate(passages, reads), "passage_id")
    if "id_status" in passages.columns:
        found = F.col("id_status") == "ID - OK"
        kept = {c: F.when(found, F.col(c)) for c in ("plate_result", "ocr_raw", "status", "difference", "image_used", "images_with_ocr")}
        out = out.withColumns(kept | {"total_images": F.when(found, F.col("total_images")).otherwise(1)})
    if "priority" in provider.labels:
        out = out.withColumns({"difference_number": F.col("difference"), "priority": V.priority(F.col("status"))})
    return out


def pipeline(spark: SparkSession, name: str, path: str, read: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """The report of a provider's documents at path, under its labels. options go to its reader (sheet=, backend=, late=, skip= for workbooks that cannot be read)."""
    provider = PROVIDERS[name]
    passages, images = provider.read(spark, path, **options)
    return report.labelled(evaluated(provider, passages, images, read), provider.labels)


def best_of_folder(rows: DataFrame) -> DataFrame:
    """The second sheet of the folder layout: the best evaluated row of each id."""
    return report.best_per_id(rows.select("id", "id_status", "status", "difference", F.col("name").alias("file")))
