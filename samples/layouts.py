"""The layout, report and boundary queries: documents made from the tables (books.py), read as a provider's, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from passaura.functions import plate as P
from passaura.functions import sql
from passaura.functions import text as T
from passaura.functions import values as V
from passaura.operators import elect, html_report, tables, vision
from passaura.sources import files as S
from passaura.sources import xlsx
from passaura.sources.scratch import scratch_path
from passaura.plans import fixtures as X
from passaura.plans import oracle as O
from passaura.plans import output, providers
from passaura.plans.catalog import _BLOCKS as BLOCKS_SQL
from passaura.plans.catalog import query

from . import books


def _with_texts(spark, sf_dir, rows: str):
    """A fixture's rows with the readings of each passage in order."""
    reads = X.on_spark(spark, sf_dir, X.READS).groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("image_ix", "ocr_text"))).alias("r"))
    texts = F.coalesce(F.transform("r", lambda x: x["ocr_text"]), F.array().cast("array<string>"))
    return X.on_spark(spark, sf_dir, rows).join(reads, "passage_id", "left").withColumn("texts", texts).drop("r")


def _shown(passages, images, *columns):
    """The passages' columns with each image's place and text, a row without image for passages that have none."""
    own = images.select("passage_id", F.col("image_ix").cast("long").alias("image_ix"), F.decode("content", "UTF-8").alias("image"))
    return passages.join(own, "passage_id", "left").select(*columns, "image_ix", "image")


@query("""select concat('mem:/b', cast(book as varchar), '.xlsx') as file, cast(3 + 30 * k as bigint) as row, concat('ID', cast(b.passage_id as varchar)) as external_id, b.expected_plate, concat('c', cast(k % 3 as varchar)) as category,
cast(r.image_ix as bigint) as image_ix, coalesce(r.ocr_text, case when r.image_ix is not null then '' end) as image from {BOOK_ROWS} b left join {READS} r on r.passage_id = b.passage_id""")
def layout_spvias(spark, sf_dir):
    found = books.made(_with_texts(spark, sf_dir, X.BOOK_ROWS), "b{}.xlsx", books.blocks)
    return _shown(*providers.read_spvias(spark, found), "file", "row", "external_id", "expected_plate", "category")


@query("""select concat('mem:/c', cast(book as varchar), '.xlsx') as file, concat('ID', cast(b.passage_id as varchar)) as external_id, b.expected_plate, cast(r.image_ix as bigint) as image_ix,
coalesce(r.ocr_text, case when r.image_ix is not null then '' end) as image from {FIRST_ROWS} b left join {READS} r on r.passage_id = b.passage_id""")
def layout_colinas(spark, sf_dir):
    found = books.made(_with_texts(spark, sf_dir, X.FIRST_ROWS), "c{}.xlsx", books.single)
    return _shown(*providers.read_colinas(spark, found), "file", "external_id", "expected_plate")


def _table_sql(name: str, header: int, column: str) -> str:
    """Of the pictures in the sheet a row takes the first: its own, the second if its own stays in the row before, or that of the next row."""
    media = lambda c, i: f"concat('xl/media/{c}', cast({i} as varchar), '.png')"
    after = "k % 8 = 7 and next_id is not null"
    return f"""with r as (select passage_id, ocr_text from {{READS}} where image_ix = 1),
o as (select b.*, coalesce(ocr_text, '') as text, lead(b.passage_id) over (partition by book order by k) as next_id, lead(coalesce(ocr_text, '')) over (partition by book order by k) as next_text
from {{BOOK_ROWS}} b left join r on r.passage_id = b.passage_id)
select concat('mem:/{name}', cast(book as varchar), '.xlsx') as file, cast({header} + 1 + k as bigint) as row, concat('ID', cast(passage_id as varchar)) as external_id, expected_plate,
case when k % 3 = 0 then '{column}' when k % 8 = 0 then {media("z", "passage_id")} when k % 2 = 0 then {media("m", "passage_id")} when {after} then {media("m", "next_id")} end as origin,
case when k % 3 = 0 or k % 2 = 0 or ({after}) then cast(1 as bigint) end as image_ix,
case when k % 3 = 0 then 'beside' when k % 8 = 0 then 'ABC1234' when k % 2 = 0 then text when {after} then next_text end as image from o"""


def _table(spark, sf_dir, name: str, header: int, titles: list[str], read):
    rows = _with_texts(spark, sf_dir, X.BOOK_ROWS)
    beside = X.on_spark(spark, sf_dir, X.BOOK_ROWS).where("k % 3 = 0").select(F.concat(F.lit("mem:/p"), F.col("passage_id").cast("string"), F.lit(".png")).alias("file"), F.lit("beside").cast("binary").alias("content"))
    made = books.made(rows, name + "{}.xlsx", books.table(header, titles)).select("file", "content")
    return _shown(*read(spark, made.unionByName(books.kept(beside)), sound=F.isnotnull), "file", "row", "external_id", "expected_plate", "origin")


@query(_table_sql("v", 3, "Foto 1"))
def layout_eixovp(spark, sf_dir):
    return _table(spark, sf_dir, "v", 3, ["Placa", "ID_PASSAGEM", "DATA HORA", "Foto 1"], providers.read_eixovp)


@query(_table_sql("r", 8, "Imagem da Passagem 1"))
def layout_bandeiras(spark, sf_dir):
    return _table(spark, sf_dir, "r", 8, ["ID Transacao", "Data Passagem", "Hora Passagem", "Categoria", "Placa", "Imagem da Passagem 1"], providers.read_bandeiras)


_FOLDER = """with n as (select name, passage_id, upper(split_part(name, case when name like '%-%' then '-' else '.' end, 1)) as id, name like '%-%' as ok from {IMAGE_NAMES}),
s as (select concat('ID', cast(passage_id // 2 * 2 as varchar)) as id, expected_plate as plate, concat('d', cast(passage_id as varchar)) as date from {BOOK_ROWS}
qualify row_number() over (partition by passage_id // 2 order by passage_id desc) = 1)"""


@query(_FOLDER + """ select name, n.id, case when not ok then 'ID fora do padrão' when s.id is null then 'ID não encontrado na planilha' else 'ID - OK' end as id_status, case when ok then plate end as plate, case when ok then date end as date,
case when ok and s.id is not null then cast(1 as bigint) end as image_ix, case when ok and s.id is not null then name end as image from n left join s on n.id = s.id""")
def layout_tamoios(spark, sf_dir):
    named = X.on_spark(spark, sf_dir, X.IMAGE_NAMES)
    images = named.select(F.concat(F.lit("mem:/"), "name").alias("file"), F.col("name").cast("binary").alias("content"))
    other = named.limit(1).select(F.lit("mem:/notes.txt").alias("file"), F.lit("x").cast("binary").alias("content"))
    sheet = books.made(X.on_spark(spark, sf_dir, X.BOOK_ROWS), "ref{}.xlsx", books.reference)
    return _shown(*providers.read_tamoios(spark, images.unionByName(other), sheet=sheet), "name", "id", "id_status", "plate", "date")


_PICTURES = """w as (select passage_id, ocr_text as image, row_number() over (partition by passage_id order by image_ix) - 1 as n from {READS} where ocr_text is not null),
u as (select passage_id, cast('' as varchar) as image, row_number() over (partition by passage_id order by image_ix) - 1 as n from {READS} where ocr_text is null)"""


def _documents(spark, sf_dir, pages: str, read, *columns):
    """A provider's reading of files of one page each, from a fixture (passage_id, page) and the readings as pictures."""
    texts = _with_texts(spark, sf_dir, pages)
    content = F.to_json(F.array(F.struct("page", F.transform("texts", lambda t: F.coalesce(t, F.lit(""))).alias("texts"))))
    found = texts.select(F.concat(F.lit("mem:/d"), F.col("passage_id").cast("string"), F.lit(".pdf")).alias("file"), content.cast("binary").alias("content"))
    shown = _shown(*read(spark, found, backend=books.pages_of), "file", *columns)
    return shown.withColumn("file", F.regexp_extract("file", "([0-9]+)", 1).cast("long")).withColumnRenamed("file", "document")


@query(f"""with {_PICTURES} select b.passage_id as document, cast(k as bigint) as n, date_time, category, plate as expected_plate, cast(w.n % 3 + 1 as bigint) as image_ix, w.image
from (select *, row_number() over (partition by passage_id order by k) - 1 as place from ({BLOCKS_SQL}) q where date_time <> '' and category is not null and plate <> '') b
left join w on w.passage_id = b.passage_id and floor(w.n / 3) = b.place""")
def layout_autoban(spark, sf_dir):
    found = _documents(spark, sf_dir, X.BLOCK_PAGES, providers.read_autoban, "n", "date_time", "category", "expected_plate")
    return found.withColumn("n", F.col("n").cast("long"))


@query(f"""with p as (select passage_id, ocr_text as image, row_number() over (partition by passage_id order by image_ix) - 1 as n from {{READS}}) select b.passage_id as document, cast(k as bigint) as n, date_time, category, plate as expected_plate,
case when p.n is not null then cast(1 as bigint) end as image_ix, case when p.n is not null then coalesce(p.image, '') end as image
from (select *, row_number() over (partition by passage_id order by k) - 1 as place from ({BLOCKS_SQL}) q where date_time <> '' and category is not null and plate <> '') b left join p on p.passage_id = b.passage_id and p.n = b.place""")
def layout_prototype(spark, sf_dir):
    found = _documents(spark, sf_dir, X.BLOCK_PAGES, providers.read_prototype, "n", "date_time", "category", "expected_plate")
    return found.withColumn("n", F.col("n").cast("long"))


_CELL = "concat('c{0}l', m)"


@query(f"""select cast(customer as varchar) as file, passage_id as page, concat('10000', lpad(cast(passage_id as varchar), 8, '0')) as id, {", ".join(f"{_CELL.format(k)} as {n}" for k, n in enumerate(tables.FIELDS) if k in (1, 2, 3, 4, 6, 7, 9))},
case when passage_id % 4 = 1 then '' else {_CELL.format(5)} end as plaza, concat({_CELL.format(8)}, ' NOVA', cast(passage_id % 10 as varchar)) as city, expected_plate as plate, '' as model, '' as axles, '' as fare, '' as responsible
from (select *, case when passage_id % 3 = 0 then '2' else '1' end as m from {{PASSAGES}}) p where passage_id % 11 <> 0""")
def pdf_table_rows(spark, sf_dir):
    """The passage in a page's table, from boxes of words and, on half of the pages, ruling lines around cells of two lines."""
    table = tables.rows(X.on_spark(spark, sf_dir, X.TABLE_WORDS), X.on_spark(spark, sf_dir, X.TABLE_RULES))
    return tables.passage_rows(table)


@query(f"""with {_PICTURES} select b.passage_id as document, regexp_extract(page, '([0-9]+[A-Z]{{2,3}}[0-9]{{10,}})', 1) as external_id, '02' as category, substr(page, -7) as expected_plate,
nullif(regexp_extract(page, '(?s)Data do transito.*?([0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', 1), '') as date_time, cast(w.n + 1 as bigint) as image_ix, w.image
from {{ID_PAGES}} b left join w on w.passage_id = b.passage_id where regexp_matches(page, '[0-9]+[A-Z]{{2,3}}[0-9]{{10,}}')""")
def layout_eixosp(spark, sf_dir):
    return _documents(spark, sf_dir, X.ID_PAGES, providers.read_eixosp, "external_id", "category", "expected_plate", "date_time")


@query(f"""with {_PICTURES}, p as (select * from w union all select * from u where n < 6 and passage_id not in (select passage_id from w))
select b.passage_id as document, case when b.passage_id % 6 = 0 then '' else concat('ID', cast(b.passage_id as varchar)) end as external_id, date, time, expected_plate, cast(p.n + 1 as bigint) as image_ix, p.image
from {{LINES}} b left join p on p.passage_id = b.passage_id""")
def layout_ecovias(spark, sf_dir):
    return _documents(spark, sf_dir, X.LINES, providers.read_ecovias, "external_id", "date", "time", "expected_plate")


@query(f"""with {_PICTURES} select b.passage_id as document, lpad(cast(b.passage_id as varchar), 20, 'A') as external_id, substr(expected_plate, 1, 7) as expected_plate, '2' as axles, '11,20' as fare, cast(w.n + 1 as bigint) as image_ix, w.image
from (select t.passage_id, expected_plate from {{TOKEN_LINES}} t join {{PASSAGES}} q on q.passage_id = t.passage_id where t.passage_id % 5 <> 0 and t.passage_id % 7 <> 0) b left join w on w.passage_id = b.passage_id""")
def layout_intervias(spark, sf_dir):
    return _documents(spark, sf_dir, X.TOKEN_LINES, providers.read_intervias, "external_id", "expected_plate", "axles", "fare")


@query(f"""select concat('mem:/b', cast(book as varchar), '.xlsx') as "Arquivo", cast(k + 1 as varchar) as "Seq", concat('ID', cast(b.passage_id as varchar)) as "ID Sistema", b.expected_plate as "Placa Esperada", plate_result as "Placa OCR", ocr_raw as "OCR Bruto",
status as "Status OCR", cast(difference as varchar) as "Diferença OCR", coalesce(cast(image_used as varchar), '') as "Imagem Usada", cast(total_images as varchar) as "Total Imagens", cast(images_with_ocr as varchar) as "Imagens c/ OCR"
from {{BOOK_ROWS}} b join ({O.by_distance("expected", "raw")}) e on e.passage_id = b.passage_id""")
def report_spvias(spark, sf_dir):
    """The whole way from workbooks to a report under its labels; blank pictures stay unread."""
    found = books.made(_with_texts(spark, sf_dir, X.BOOK_ROWS), "b{}.xlsx", books.blocks)
    out = providers.pipeline(spark, "spvias", found, books.as_text)
    return out.select("Arquivo", "Seq", "ID Sistema", "Placa Esperada", "Placa OCR", "OCR Bruto", "Status OCR", "Diferença OCR", "Imagem Usada", "Total Imagens", "Imagens c/ OCR")


def _written_and_read(spark, provider: str, frames: list):
    path = scratch_path(spark, "report.xlsx")
    output.write_report(provider, frames, path)
    return xlsx.cells(S.files(spark, path, "xlsx")).select("sheet", "row", F.col("col").cast("long").alias("col"), "raw")


_NATIONS = "select row_number() over (order by n_nationkey) + 1 as row, * from nation"
_NATION_CELLS = "select '{0}' as sheet, cast(1 as bigint) as row, cast(1 as bigint) as col, 'n_nationkey' as raw union all select '{0}', 1, 2, 'n_name' union all select '{0}', row, 1, cast(n_nationkey as varchar) from n union all select '{0}', row, 2, n_name from n"


@query(f"with n as ({_NATIONS}), r as (select row_number() over (order by r_name) + 1 as row, * from region) " + _NATION_CELLS.format("Resultado Completo") + """
union all select 'Melhor Resultado ID', 1, 1, 'r_name' union all select 'Melhor Resultado ID', row, 1, r_name from r""")
def two_sheet_report(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey")
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_name").orderBy("r_name")
    return _written_and_read(spark, "tamoios", [nations, regions])


@query(f"with n as ({_NATIONS}) " + _NATION_CELLS.format("Processamento Completo"))
def named_sheet_report(spark, sf_dir):
    return _written_and_read(spark, "eixosp", [spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey")])


@query(""" select provider, concat('saida/', category, '/resultado_', provider, '.xlsx') as path from (values ('ecovias', 'evasao'), ('intervias', 'evasao'), ('eixosp', 'evasao'), ('autoban', 'isencao'),
('tamoios', 'isencao'), ('colinas', 'eixo'), ('spvias', 'eixo'), ('eixovp', 'eixo'), ('bandeiras', 'eixo')) v(provider, category)""")
def report_paths(spark, sf_dir):
    return spark.createDataFrame([(p, output.report_path("saida/", p)) for p in providers.PROVIDERS], "provider string, path string")


@query("select doc_id, strip_accents(text) as bare from documents")
def bare_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.without_accents(F.col("text")).alias("bare"))


@query("select c_custkey as id, c_name as name, '' as missing, c_custkey as resolved from customer")
def named_columns(spark, sf_dir):
    """Columns by the strict name of a candidate, and by synonyms."""
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias(" Código  CLIENTE"), F.col("c_name").alias("Nome"))
    strict = V.resolve(own.columns, ["id", "CDIGO-cliente"])
    out = V.with_synonyms(own, {"id": ["numero", "codigo cliente"], "name": ["NOME"], "missing": ["placa"]})
    return out.select("id", "name", "missing", F.col(f"`{strict}`").alias("resolved"))


@query("select p_partkey, title, value from (select p_partkey, unnest([{'title': 'Foto 1', 'value': p_name}, {'title': 'IMAGEM-2', 'value': p_brand}], recursive := true) from part)")
def picture_columns(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("Foto 1"), F.col("p_brand").alias("IMAGEM-2"), F.col("p_type").alias("Placa"))
    named = V.image_columns(own.columns)
    return own.unpivot("p_partkey", named, "title", "value")


@query("select sheet_row, coalesce(plate, '') as plate, coalesce(cast(cast(floor(fare) as bigint) as varchar), '') as fare from {LOADED}")
def shown_values(spark, sf_dir):
    return X.on_spark(spark, sf_dir, X.LOADED).select("sheet_row", V.shown(F.col("plate")).alias("plate"), V.shown(F.floor("fare")).alias("fare"))


@query("select passage_id, image_ix, case when ocr_text is null or trim(ocr_text) = '' then 'fail' when ocr_text = expected_plate then 'ok' else 'partial' end as match from {READS}")
def match_classes(spark, sf_dir):
    return X.on_spark(spark, sf_dir, X.READS).select("passage_id", "image_ix", html_report.match_class(F.col("expected_plate"), F.col("ocr_text")).alias("match"))


@query("select concat('n', cast(n_nationkey as varchar), case when n_nationkey % 2 = 0 then '.TXT' else '.txt' end) as name, cast(length(n_name) as bigint) as length, n_name as text from nation where n_nationkey % 3 <> 0")
def raw_files(spark, sf_dir):
    """Files by extension in any case and their bytes; others of the folder are not opened."""
    path = scratch_path(spark, "raw")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():  # 25 rows, whatever the scale
        kind = ".dat" if r[0] % 3 == 0 else ".TXT" if r[0] % 2 == 0 else ".txt"
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/n{r[0]}{kind}")
        out = target.getFileSystem(conf).create(target)
        out.write(bytearray(r[1].encode()))
        out.close()
    return S.files(spark, path, "txt").select("name", "length", F.decode("content", "UTF-8").alias("text"))


@query("select name, row_number() over (order by name) as ix from {IMAGE_NAMES}")
def image_listing(spark, sf_dir):
    named = X.on_spark(spark, sf_dir, X.IMAGE_NAMES)
    other = named.where("passage_id % 50 = 0").select(F.concat(F.lit("mem:/"), "name", F.lit(".txt")).alias("file"), F.lit("x").cast("binary").alias("content"))
    found = S.image_files(spark, named.select(F.concat(F.lit("mem:/"), "name").alias("file"), F.lit("x").cast("binary").alias("content")).unionByName(other))
    return found.select("name", F.col("ix").cast("long").alias("ix"))


_BOXES_SQL = "select passage_id, box_ix, conf, cast(trunc(x2) - trunc(x1) as int) as w, cast(trunc(y2) - trunc(y1) as int) as h from {BOXES}"


@query(f"""select passage_id, box_ix, w as width, h as height, w / greatest(h, 1) as ratio, reason, reason is null as accepted from (select *, case when conf < 0.35 then 'confidence' when w / greatest(h, 1) < 0.8 then 'too square' when w / greatest(h, 1) > 6.0 then 'too wide' end as reason from ({_BOXES_SQL}) b) c""")
def box_diagnostics(spark, sf_dir):
    return vision.diagnostics(X.on_spark(spark, sf_dir, X.BOXES)).select("passage_id", "box_ix", "width", "height", "ratio", "reason", "accepted")


_READ = f"""with m as (select passage_id, image_ix, ocr_text as x, {O.mask("expected_plate")} as mask from {{READS}}),
c as (select passage_id, image_ix, mask, unnest([{{'v': 1, 'c': 1, 'x': substr(x, 1, 3), 'p': 0.5}}, {{'v': 1, 'c': 2, 'x': substr(x, 4), 'p': 0.5}}, {{'v': 1, 'c': 3, 'x': x, 'p': 0.5}}, {{'v': 2, 'c': 1, 'x': x, 'p': 0.99}}], recursive := true) from m where length(x) >= 7),
t as (select passage_id, image_ix, v, c, cast(p as double) as p, {O.normalize("x", "mask")} as t from c),
s as (select *, p + case when {O.valid("t")} then 5.0 else 0.0 end - 2.0 * abs(length(t) - 7) as score, {O.valid("t")} as good from t where t <> ''),
w as (select passage_id, image_ix, coalesce((list(t order by v, c) filter (where good))[1], (list(t order by score desc, v, c) filter (where score > -1))[1]) as ocr_text from s group by passage_id, image_ix)
select m.passage_id, m.image_ix, w.ocr_text from m left join w on w.passage_id = m.passage_id and w.image_ix = m.image_ix"""


@query(_READ)
def vision_readings(spark, sf_dir):
    """Detection, reading and election through the stand-ins, each distinct image once."""
    images = X.on_spark(spark, sf_dir, X.READS).select("passage_id", "image_ix", P.mask_of(F.col("expected_plate")).alias("mask"), F.col("ocr_text").cast("binary").alias("content"))
    return vision.readings(images, books.ByteDetector, books.ByteReader)


_SEEN = f"""with b as (select passage_id, image_ix, 1 as box_ix, case when image_ix % 4 = 0 then 0.2 else 0.9 end as conf, 3.0 as ratio from {{READS}} union all select passage_id, image_ix, 2, 0.5, case when image_ix % 5 = 0 then 0.5 else 2.0 end from {{READS}}),
c as (select passage_id, image_ix, ocr_text as x, {O.mask("expected_plate")} as mask, unnest([{{'box_ix': 1, 'v': 1, 'c': 1, 'p': 0.5, 'f': 1, 'n': 3}}, {{'box_ix': 1, 'v': 1, 'c': 2, 'p': 0.7, 'f': 4, 'n': 99}}, {{'box_ix': 1, 'v': 2, 'c': 1, 'p': 0.25, 'f': 1, 'n': 99}}, {{'box_ix': 2, 'v': 1, 'c': 1, 'p': 0.25, 'f': 2, 'n': 99}}], recursive := true) from {{READS}}),
t as (select passage_id, image_ix, box_ix, v, c, cast(p as double) as p, {O.normalize("x", "mask")} as t from (select passage_id, image_ix, box_ix, v, c, p, mask, substr(coalesce(x, ''), f, n) as x from c) q),
s as (select *, p + case when {O.valid("t")} then 5.0 else 0.0 end - 2.0 * abs(length(t) - 7) as score from t),
w as (select passage_id, image_ix, box_ix, v, count(*) as n, coalesce((list(t order by score desc, c) filter (where score > -1))[1], '') as t, coalesce(max(score) filter (where score > -1), -1.0) as score from s group by all),
a as (select *, case when conf < 0.35 then 'confidence' when ratio < 0.8 then 'too square' end as reason from b),
h as (select a.passage_id, a.image_ix, a.box_ix, reason, v, n, t, score from a left join w on w.passage_id = a.passage_id and w.image_ix = a.image_ix and w.box_ix = a.box_ix and reason is null),
g as (select passage_id, image_ix, count(distinct box_ix) as n_boxes, count(distinct box_ix) filter (where reason is null) as n_accepted, (list(box_ix order by score desc, box_ix, v) filter (where score > -1))[1] as best_box,
(list(v order by score desc, box_ix, v) filter (where score > -1))[1] as best_variant, coalesce((list(t order by score desc, box_ix, v) filter (where score > -1))[1], '') as best_text, coalesce(max(score), -1.0) as best_score from h group by all)
select h.passage_id, h.image_ix, n_boxes, n_accepted, g.best_text, g.best_score, cast(best_box as integer) as best_box, cast(best_variant as integer) as best_variant, cast(h.box_ix as integer) as box_ix, reason, cast(v as integer) as variant_ix, n as n_candidates, t as variant_text, score as variant_score
from h join g on g.passage_id = h.passage_id and g.image_ix = h.image_ix"""


@query(f"""select r.passage_id, image_ix, {O.clean("ocr_text")} as cleaned, {O.mask("expected_plate")} as mask, {O.normalize("ocr_text", O.mask("expected_plate"))} as normal, {O.normalize("ocr_text")} as free,
{O.distance("expected_plate", "ocr_text")} as distance, {O.matches("expected_plate", "ocr_text")} as matches from {{READS}} r""")
def sql_plates(spark, sf_dir):
    """Plates by functions of Spark SQL, in a query that is text."""
    sql.register(spark)
    reads = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", X.READS)
    return spark.sql(f"""SELECT passage_id, image_ix, plate_clean(ocr_text) AS cleaned, plate_mask(expected_plate) AS mask, plate_normalize(ocr_text, plate_mask(expected_plate)) AS normal, plate_normalize(ocr_text, NULL) AS free,
        plate_distance(expected_plate, ocr_text) AS distance, plate_matches(expected_plate, ocr_text) AS matches FROM ({reads})""")


@query("""select passage_id, cast(unnest(range(0, len(s) - 1)) as int) as k, unnest(s[2:]) as block from (select passage_id, string_split(page, 'Data/Hora') as s from {BLOCK_PAGES}) p""")
def sql_blocks(spark, sf_dir):
    """A page's parts by a table function of Spark SQL, joined laterally."""
    sql.register(spark)
    pages = re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", X.BLOCK_PAGES)
    return spark.sql(f"SELECT passage_id, k, block FROM ({pages}), LATERAL blocks_after(page, 'Data/Hora')")


@query(_SEEN)
def instrumented_reading(spark, sf_dir):
    """Every box, variant and candidate of each image with scores, unnested to a row of each box and variant."""
    reads = X.on_spark(spark, sf_dir, X.READS).withColumn("mask", P.mask_of(F.col("expected_plate")))
    box = lambda k, conf, x2, y2: F.struct(F.lit(k).alias("box_ix"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), x2.alias("x2"), y2.alias("y2"), conf.alias("conf"))
    other = F.when(F.col("image_ix") % 5 == 0, 20.0).otherwise(80.0)
    seen = reads.select("passage_id", "image_ix", F.inline(F.array(box(1, F.when(F.col("image_ix") % 4 == 0, 0.2).otherwise(0.9), F.lit(90.0), F.lit(30.0)), box(2, F.lit(0.5), other, F.lit(40.0)))))
    one = lambda b, v, c, p, f, n: F.struct(F.lit(b).alias("box_ix"), F.lit(v).alias("variant_ix"), F.lit(c).alias("cand_ix"), F.substring(F.coalesce("ocr_text", F.lit("")), f, n).alias("text"), F.lit(p).alias("confidence"))
    read = reads.select("passage_id", "image_ix", "mask", F.inline(F.array(one(1, 1, 1, 0.5, 1, 3), one(1, 1, 2, 0.7, 4, 99), one(1, 2, 1, 0.25, 1, 99), one(2, 1, 1, 0.25, 2, 99))))
    own = elect.instrumented(seen, read).select("*", F.explode("boxes").alias("b")).select("*", F.explode_outer("b.variants").alias("v"))
    return own.select(
        "passage_id", "image_ix", "n_boxes", "n_accepted", "best_text", "best_score", "best_box", "best_variant", "b.box_ix", "b.reason", "v.variant_ix", F.when(F.col("v").isNotNull(), F.size("v.candidates").cast("long")).alias("n_candidates"), F.col("v.best_text").alias("variant_text"), F.col("v.best_score").alias("variant_score")
    )


@query("select least(500, count(*)) as pictured from {READS}")
def diagnostic_page(spark, sf_dir):
    """How many rows a page for inspection shows."""
    rows = X.on_spark(spark, sf_dir, X.READS).select("passage_id", html_report.match_class(F.col("expected_plate"), F.col("ocr_text")).alias("match"))
    shown = sum(part.startswith("<tr class=") for part in html_report.page(rows, "readings"))
    return spark.createDataFrame([(shown,)], "pictured long")
