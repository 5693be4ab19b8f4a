"""Record tables derived from the star schema by SQL that Spark and DuckDB both run, with made-up plates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letter(of: str, n: int, div: str) -> str:
    return f"substr('{_ABC[:n]}', cast(cast(floor({of} / {div}) as bigint) % {n} as int) + 1, 1)"


def _digit(of: str, div: str) -> str:
    return f"cast(cast(floor({of} / {div}) as bigint) % 10 as string)"


_K = "o_orderkey"
PASSAGES = f"""select {_K} as passage_id, cast(o_custkey as bigint) as customer, o_totalprice as fare,
concat({_letter(_K, 26, "1.0")}, {_letter(_K, 26, "26.0")}, {_letter(_K, 26, "676.0")}, {_digit(_K, "1.0")},
case when {_K} % 2 = 0 then {_letter(_K, 10, "10.0")} else {_digit(_K, "10.0")} end, {_digit(_K, "100.0")}, {_digit(_K, "1000.0")}) as expected_plate from {{orders}}"""
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
READS = f"""select i.passage_id, i.image_ix, case noise when 2 then translate(expected_plate, '01258', 'OIZSB') when 3 then substr(expected_plate, 1, 6)
when 4 then concat(substr(expected_plate, 4, 4), substr(expected_plate, 1, 3)) when 5 then concat('X', expected_plate) when 6 then null when 7 then reverse(expected_plate)
else expected_plate end as ocr_text, 1.0 - disc as confidence, noise, expected_plate
from (select l_orderkey as passage_id, cast(row_number() over (partition by l_orderkey order by {_ORDER}) as int) as image_ix, cast((l_partkey + l_linenumber) % 8 as int) as noise, l_discount as disc from {{lineitem}}) i
join ({PASSAGES}) p on i.passage_id = p.passage_id"""
DIRTY = f"select passage_id, image_ix, case when ocr_text is not null then concat(lower(ocr_text), case when noise = 3 then ' .' else '-' end) end as raw, expected_plate, noise from ({READS}) r"
BOXES = f"""select l_orderkey as passage_id, cast(1 as int) as image_ix, cast(row_number() over (partition by l_orderkey order by {_ORDER}) as int) as box_ix, l_discount * 10 as conf,
cast(10 as double) as x1, cast(20 as double) as y1, 30.5 + l_partkey % 200 as x2, 30.5 + l_suppkey % 60 as y2 from {{lineitem}}"""
CANDIDATES = f"""select passage_id, image_ix, cast(noise % 3 as int) as box_ix, cast(noise % 2 as int) as variant_ix, cast(image_ix as int) as cand_ix,
case when noise = 1 then substr(ocr_text, 3, 4) else ocr_text end as text, cast(confidence as double) as confidence, case passage_id % 3 when 0 then 'LLLDDDD' when 1 then 'LLLDLDD' end as mask from ({READS}) r where ocr_text is not null"""
STARTS = "select cast(o_custkey % 20 as string) as file, cast(row_number() over (partition by o_custkey % 20 order by o_orderkey) * 7 as bigint) as first_row from {orders}"
ANCHORS = f"""select cast(l_partkey % 20 as string) as file, cast(l_orderkey % 5300 as bigint) as anchor_row, concat('m', cast(ord as string)) as media, ord, cast(l_suppkey * 3000 % 190500 as bigint) as row_off,
case when l_linenumber % 3 = 0 then cast(l_suppkey * 2500 as bigint) end as row_height from
(select *, cast(row_number() over (partition by l_partkey % 20 order by l_orderkey, {_ORDER}) as int) as ord from {{lineitem}}) x"""
ROWS = f"""select cast(customer % 20 as string) as file, passage_id % 5300 as sheet_row, passage_id, case when passage_id % 3 = 0 then concat('a', cast(passage_id as string)) when passage_id % 3 = 1 then ' ' end as image_a,
case when passage_id % 5 = 0 then concat('b', cast(passage_id as string)) end as image_b from ({PASSAGES}) p"""
PAGE_PASSAGES = "select p_size as page, cast(row_number() over (partition by p_size order by p_partkey) - 1 as int) as k, p_partkey from {part}"
PAGE_IMAGES = f"select cast(l_quantity as int) as page, concat('m', cast(l_orderkey as string), '-', cast(ord as string)) as media, cast(l_suppkey as double) as x0, cast(l_partkey % 700 as double) as y0 from (select *, row_number() over (partition by l_orderkey order by {_ORDER}) as ord from {{lineitem}}) x"
PHOTOS = f"select cast(l_orderkey % 3000 as string) as file, cast(floor((100 + l_partkey % 1200) * (80 + l_suppkey % 700) / case when l_orderkey % 2 = 0 then 1.0 else 9.0 end) as bigint) as area, cast(row_number() over (partition by l_orderkey % 3000 order by l_orderkey, {_ORDER}) as int) as ord from {{lineitem}}"
SHEET = f"select case when customer % 7 = 0 then '' else concat('ID', cast(customer as string)) end as id, passage_id as sheet_row, expected_plate as plate, cast(passage_id % 28 as string) as date, cast(passage_id % 24 as string) as time, cast(passage_id % 5 as string) as category from ({PASSAGES}) p"
FILES = "select event_id, case when event_id % 5 = 0 then concat('dir/noid', cast(event_id as string), '.png') when event_id % 5 = 1 then concat('id', cast(event_id % 1500 as string), '-a.b.jpg') else concat('x/id', cast(user_id as string), '-F01.jpg') end as name from {events}"
REPORT = f"""select concat('ID', cast(customer as string)) as id, case when customer % 3 = 0 then 'ID fora do padrão' else 'ID - OK' end as id_status,
case passage_id % 4 when 0 then 'Aprovado - busca nas imagens' when 1 then 'Revisar' when 2 then 'Revisar - sem imagem' else '' end as status,
case when passage_id % 4 = 3 then null else cast(passage_id % 40 as double) / 10 end as difference, concat('f', cast(passage_id as string)) as file from ({PASSAGES}) p"""
CELLS = "select cast(p_partkey % 50 as string) as file, cast(floor(p_partkey / 50.0) as bigint) as row, col, case when p_size % 4 = 0 and col = 1 then ' Placa ' when p_size % 4 = 0 and col = 2 then 'ID_PASSAGEM' when p_size % 8 = 0 and col = 3 then 'Data / Hora' when p_size % 3 = 0 then 'nan' else p_brand end as raw from {part}, (select 1 as col union all select 2 as col union all select 3 as col) c"
_TWO = lambda x: f"lpad(cast({x} as string), 2, '0')"
_DATE = f"concat({_TWO('passage_id % 33')}, '/', {_TWO('passage_id % 14')}, '/2024')"
_TIME = f"concat({_TWO('passage_id % 25')}, ':', {_TWO('passage_id % 60')}, ':', {_TWO('passage_id % 59')})"
PREFIX = "case passage_id % 3 when 0 then concat('Posto Azul ', cast(passage_id % 4 as string), ' Norte Vila Nova ', cast(passage_id as string)) when 1 then concat('Posto Sem Rumo ', cast(passage_id as string)) else 'Posto' end"
ROAD = "case passage_id % 5 when 0 then 'SP330 12+300 ' when 1 then '330 KM 12+300 ' when 2 then '330 12+300 ' when 3 then 'sp99 ' else '' end"
SUFFIX = "case passage_id % 4 when 0 then 'Alfa - KA 1 R$ 9,70 Envio  Sim' when 1 then 'Beta Uno 2 11.20 R$ Fulano de Tal' when 2 then 'Gama 2 11,20 R$' else 'Moto sem dados' end"
LINES = f"""select passage_id, expected_plate, {_DATE} as date, {_TIME} as time, {PREFIX} as prefix, {SUFFIX} as suffix, {ROAD} as road,
concat('Relatorio', chr(10), case when passage_id % 6 = 0 then '' else concat('id', cast(passage_id as string), ' ') end, {_DATE}, '  ', {_TIME}, ' ', {ROAD}, {PREFIX}, ' ', expected_plate, ' ', {SUFFIX}, chr(10), 'Fim') as page from ({PASSAGES}) p"""
BLOCK_PAGES = f"""select passage_id, concat('Cabecalho 77', chr(10), 'Data/Hora', chr(10), {_DATE}, ' ', {_TIME}, chr(10), ' ', cast(passage_id % 120 as string), ' ', chr(10), expected_plate, chr(10),
'Data/Hora sem nada', chr(10), 'Data/Hora', chr(10), {_DATE}, ' ', {_TIME}, ' x', chr(10), '07', chr(10), 'placa ', expected_plate) as page from ({PASSAGES}) p"""
ID_PAGES = f"""select passage_id, concat('Data do transito', chr(10), case when passage_id % 4 = 0 then 'sem' else concat({_DATE}, ' ', {_TIME}) end, chr(10), case when passage_id % 3 = 0 then 'X' else '' end, expected_plate, chr(10),
cast(passage_id as string), 'AB', lpad(cast(passage_id as string), case when passage_id % 2 = 0 then 10 else 9 end, '0'), chr(10), '02', chr(10), expected_plate) as page from ({PASSAGES}) p"""
TOKEN_LINES = f"""select passage_id, concat('Titulo', chr(10), case when passage_id % 5 = 0 then 'curto' else '' end, lpad(cast(passage_id as string), 20, 'A'), ' ', {_DATE}, ' ', {_TIME}, ' 330 KM 1+', cast(passage_id % 1000 as string), ' PRACA 2 SUL CIDADE 68 ',
case when passage_id % 7 = 0 then '' else concat(expected_plate, ' MARCA ', case when passage_id % 2 = 0 then '/MODELO X ' else '' end, '2 11,20 R$ NOME') end) as page from ({PASSAGES}) p"""
_COLS = "(select 0 as col union all select 1 as col union all select 2 as col union all select 3 as col union all select 4 as col union all select 5 as col union all select 6 as col union all select 7 as col union all select 8 as col union all select 9 as col union all select 10 as col)"
TABLE_WORDS = f"""select cast(customer as string) as file, passage_id as page, case when part = 1 then concat('NOVA', cast(passage_id % 10 as string)) when line = 0 then concat('H', cast(col as string))
when col = 0 then case when passage_id % 11 = 0 or (passage_id % 3 = 0 and line = 1) then 'X12' else concat('10000', lpad(cast(passage_id as string), 8, '0')) end when col = 10 then expected_plate else concat('c', cast(col as string), 'l', cast(line as string)) end as word,
cast(10 + 60 * col + passage_id % 7 + case when part = 1 and passage_id % 2 = 1 then 20 else 0 end as double) as x0, cast(28 + 60 * col + passage_id % 7 + case when part = 1 and passage_id % 2 = 1 then 25 else 0 end as double) as x1,
cast(100 + 20 * line + col % 3 + case when part = 1 and passage_id % 2 = 0 then 9 else 0 end as double) as y0, cast(107 + 20 * line + col % 3 + case when part = 1 and passage_id % 2 = 0 then 9 else 0 end as double) as y1
from ({PASSAGES}) p, (select 0 as line union all select 1 as line union all select 2 as line) l, {_COLS} c, (select 0 as part union all select 1 as part) w
where (part = 0 or (col = 8 and line > 0)) and not (col = 5 and line > 0 and passage_id % 4 = 1)"""
TABLE_RULES = f"select cast(customer as string) as file, passage_id as page, cast(98 + 20 * line as double) as y from ({PASSAGES}) p, (select 0 as line union all select 1 as line union all select 2 as line) l where passage_id % 2 = 0"
LOADED = f"select passage_id as sheet_row, case when passage_id % 3 = 0 then expected_plate end as plate, case when passage_id % 4 = 0 then fare end as fare from ({PASSAGES}) p"
DIGESTS = f"select passage_id, image_ix, cast(noise as string) as content_sha, case when image_ix % 3 = 0 then null when image_ix % 3 = 1 then 'LLLDDDD' else 'LLLDLDD' end as mask from ({READS}) r"


def on_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture, its tables read from the Parquet files of sf_dir."""
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def on_duckdb(sql: str) -> str:
    """A fixture over views named as the tables."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
BOOK_ROWS = f"""select passage_id, customer, expected_plate, cast(floor(passage_id / 2000.0) as bigint) as book,
cast(row_number() over (partition by floor(passage_id / 2000.0) order by passage_id) - 1 as int) as k from ({PASSAGES}) p"""
FIRST_ROWS = f"select passage_id, expected_plate, passage_id as book, cast(0 as int) as k from ({PASSAGES}) p where passage_id in (select min(passage_id) from ({PASSAGES}) q group by customer)"
IMAGE_NAMES = f"""select case when passage_id % 5 = 4 then concat('none', cast(passage_id as string), '.png') when passage_id % 5 = 3 then concat('ZZ', cast(passage_id as string), '-a.JPG')
else concat('id', cast(passage_id as string), '-F01.jpeg') end as name, passage_id, expected_plate from ({PASSAGES}) p"""
