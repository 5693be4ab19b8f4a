"""The record queries by name, and the same results as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plate as P
from ..functions import text as T
from ..functions import values as V
from ..operators import associate, elect, report
from . import fixtures as X
from . import oracle as O

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query of (spark, sf_dir) and its SQL, in which {NAME} is a fixture."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = O.filled(sql)
        return f

    return add


def _of(fixture: str):
    return lambda spark, sf_dir: X.on_spark(spark, sf_dir, fixture)


_dirty, _reads, _passages = _of(X.DIRTY), _of(X.READS), _of(X.PASSAGES)


@query(f"select passage_id, image_ix, {O.clean('raw')} as plate from {{DIRTY}}")
def plate_clean(spark, sf_dir):
    return _dirty(spark, sf_dir).select("passage_id", "image_ix", P.clean(F.col("raw")).alias("plate"))


@query(f"select passage_id, image_ix, {O.reorder('ocr_text')} as plate from {{READS}}")
def plate_reorder(spark, sf_dir):
    return _reads(spark, sf_dir).select("passage_id", "image_ix", P.reorder(F.col("ocr_text")).alias("plate"))


@query(f"select passage_id, image_ix, {O.mask('raw')} as mask from {{DIRTY}}")
def plate_mask(spark, sf_dir):
    return _dirty(spark, sf_dir).select("passage_id", "image_ix", P.mask_of(F.col("raw")).alias("mask"))


@query(f"select passage_id, image_ix, {O.fit('ocr_text', O.mask('expected_plate'))} as plate from {{READS}}")
def plate_mask_fix(spark, sf_dir):
    return _reads(spark, sf_dir).select("passage_id", "image_ix", P.fit_mask(F.col("ocr_text"), P.mask_of(F.col("expected_plate"))).alias("plate"))


@query(f"select passage_id, image_ix, {O.normalize('raw')} as any_mask, {O.normalize('raw', O.mask('expected_plate'))} as own_mask from {{DIRTY}}")
def plate_normalize(spark, sf_dir):
    raw = F.col("raw")
    return _dirty(spark, sf_dir).select("passage_id", "image_ix", P.normalize(raw).alias("any_mask"), P.normalize(raw, P.mask_of(F.col("expected_plate"))).alias("own_mask"))


@query(f"select passage_id, image_ix, {O.distance('expected_plate', 'ocr_text')} as difference from {{READS}}")
def plate_distance(spark, sf_dir):
    return _reads(spark, sf_dir).select("passage_id", "image_ix", P.distance(F.col("expected_plate"), F.col("ocr_text")).alias("difference"))


@query(f"select passage_id, image_ix, {O.subsequence('expected_plate', 'ocr_text')} as n from {{READS}}")
def plate_lcs(spark, sf_dir):
    return _reads(spark, sf_dir).select("passage_id", "image_ix", P.common_subsequence(F.col("expected_plate"), F.col("ocr_text")).alias("n"))


@query(f"select passage_id, image_ix, {O.matches('expected_plate', 'ocr_text')} as matches, {O.same_places('expected_plate', 'ocr_text')} as same_places from {{READS}}")
def plate_matches(spark, sf_dir):
    a, b = F.col("expected_plate"), F.col("ocr_text")
    return _reads(spark, sf_dir).select("passage_id", "image_ix", P.matches(a, b).alias("matches"), P.same_places(a, F.coalesce(b, F.lit(""))).alias("same_places"))


def _evaluation(name: str, sql: str, how):
    def run(spark, sf_dir):
        return how(_passages(spark, sf_dir), _reads(spark, sf_dir).select("passage_id", "image_ix", "ocr_text"))

    run.__name__ = name
    query(sql)(run)


_evaluation("evaluate_by_distance", O.by_distance("expected", "raw"), elect.evaluate_by_distance)
_evaluation("evaluate_by_distance_normalized", O.by_distance("expected", "read"), lambda p, r: elect.evaluate_by_distance(p, r, raw="normalized"))
_evaluation("evaluate_by_distance_as_read", O.by_distance("read", "read"), lambda p, r: elect.evaluate_by_distance(p, r, show="read", raw="normalized"))
_evaluation("evaluate_by_matches", O.by_matches(), elect.evaluate_by_matches)


@query(O.election())
def candidate_election(spark, sf_dir):
    return elect.elected_text(X.on_spark(spark, sf_dir, X.CANDIDATES), by=("passage_id",), enough=0.97)


@query("select passage_id, count(*) as n, string_agg(ocr_text, '' order by image_ix) as text, cast(sum(confidence) / count(*) as double) as confidence from {READS} where ocr_text is not null group by passage_id having count(*) > 1")
def joined_text(spark, sf_dir):
    reads = F.array_sort(F.collect_list(F.struct("image_ix", F.col("ocr_text").alias("text"), F.col("confidence").cast("double").alias("confidence"))))
    own = _reads(spark, sf_dir).where("ocr_text is not null").groupBy("passage_id").agg(F.count("*").alias("n"), reads.alias("r")).where("n > 1")
    own = own.withColumn("r", elect.with_joined(F.transform("r", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence")))))
    last = F.element_at("r", -1)
    return own.select("passage_id", "n", last["text"].alias("text"), last["confidence"].alias("confidence"))


_BOX = "select passage_id, box_ix, conf, cast(trunc(x2) - trunc(x1) as int) as w, cast(trunc(y2) - trunc(y1) as int) as h from {BOXES}"
_REASON = "case when conf < 0.35 then 'confidence' when w / greatest(h, 1) < 0.8 then 'too square' when w / greatest(h, 1) > 6.0 then 'too wide' end"


@query(f"select passage_id, box_ix, {_REASON} as reason from ({_BOX}) b")
def box_reasons(spark, sf_dir):
    b = X.on_spark(spark, sf_dir, X.BOXES)
    w, h = F.col("x2").cast("int") - F.col("x1").cast("int"), F.col("y2").cast("int") - F.col("y1").cast("int")
    return b.select("passage_id", "box_ix", elect.box_reason(F.col("conf"), w, h).alias("reason"))


@query(f"select passage_id, box_ix, w, h from ({_BOX}) b where {_REASON} is null")
def box_filter(spark, sf_dir):
    found = elect.usable_boxes(X.on_spark(spark, sf_dir, X.BOXES))
    return found.select("passage_id", "box_ix", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


@query(f"select passage_id, box_ix, w, h from (select *, row_number() over (partition by passage_id order by conf desc, box_ix) as n from ({_BOX}) b) c where n = 1 and {_REASON} is null")
def top_box(spark, sf_dir):
    found = elect.top_boxes(X.on_spark(spark, sf_dir, X.BOXES))
    return found.select("passage_id", "box_ix", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))


@query(f"select passage_id, count(*) as boxes, count(*) filter (where {_REASON} is null) as accepted from ({_BOX}) b group by passage_id")
def accepted_boxes(spark, sf_dir):
    b = X.on_spark(spark, sf_dir, X.BOXES)
    w, h = F.col("x2").cast("int") - F.col("x1").cast("int"), F.col("y2").cast("int") - F.col("y1").cast("int")
    return b.groupBy("passage_id").agg(F.count("*").alias("boxes"), F.count_if(elect.box_reason(F.col("conf"), w, h).isNull()).alias("accepted"))


@query("select file, first_row, lead(first_row, 1, 99999) over (partition by file order by first_row) as end_row from {STARTS}")
def block_bounds(spark, sf_dir):
    return associate.with_ends(X.on_spark(spark, sf_dir, X.STARTS))


@query("""select file, first_row, row_number() over (partition by file, first_row order by seen, ord, media) as image_ix, anchor_row, media from
(select s.file, first_row, anchor_row, ord, media, min(ord) over (partition by s.file, first_row, anchor_row) as seen from
(select file, first_row, lead(first_row, 1, 99999) over (partition by file order by first_row) as end_row from {STARTS}) s
join {ANCHORS} a on a.file = s.file and a.anchor_row >= s.first_row and a.anchor_row < s.end_row) x""")
def image_block_join(spark, sf_dir):
    found = associate.images_in_blocks(X.on_spark(spark, sf_dir, X.STARTS), X.on_spark(spark, sf_dir, X.ANCHORS))
    return found.withColumn("image_ix", F.col("image_ix").cast("long"))


@query("select file, media, case when row_off > 0.5 * coalesce(row_height, 190500) then anchor_row + 1 else anchor_row end as sheet_row from {ANCHORS}")
def anchor_row_shift(spark, sf_dir):
    a = X.on_spark(spark, sf_dir, X.ANCHORS)
    return a.select("file", "media", associate.shifted_row(F.col("anchor_row"), F.col("row_off"), F.col("row_height")).alias("sheet_row"))


@query("select file, media, row_number() over (partition by file order by anchor_row, ord, media) as image_ix from {ANCHORS} where anchor_row >= 6 and file in (select distinct file from {STARTS})")
def single_block_images(spark, sf_dir):
    records = X.on_spark(spark, sf_dir, X.STARTS).select("file").distinct()
    found = associate.images_from_row(records, X.on_spark(spark, sf_dir, X.ANCHORS))
    return found.select("file", "media", F.col("image_ix").cast("long").alias("image_ix"))


@query("""select passage_id, coalesce(nullif(case when trim(image_a) <> '' then image_a end, ''), case when trim(image_b) <> '' then image_b end, media) as image,
case when trim(image_a) <> '' then 'image_a' when trim(image_b) <> '' then 'image_b' when media is not null then 'embedded' end as origin
from {ROWS} r left join (select file, anchor_row, media from {ANCHORS} qualify row_number() over (partition by file, anchor_row order by ord, media) = 1) a on r.file = a.file and r.sheet_row = a.anchor_row""")
def first_image_per_row(spark, sf_dir):
    found = associate.first_images(X.on_spark(spark, sf_dir, X.ROWS), ["image_a", "image_b"], X.on_spark(spark, sf_dir, X.ANCHORS))
    return found.select("passage_id", "image", "origin")


@query("""select p.page, p.k, cast(n % 3 + 1 as int) as image_ix, media from {PAGE_PASSAGES} p join
(select page, media, row_number() over (partition by page order by y0, x0, media) - 1 as n from {PAGE_IMAGES}) i on p.page = i.page and p.k = cast(floor(n / 3) as int)""")
def image_slice_by_ordinal(spark, sf_dir):
    return associate.by_ordinal(X.on_spark(spark, sf_dir, X.PAGE_PASSAGES), X.on_spark(spark, sf_dir, X.PAGE_IMAGES))


@query("""select file, area, ord, image_ix from (select *, row_number() over (partition by file order by area desc, ord) as image_ix, max(area) over (partition by file) as top from {PHOTOS}) x
where (top >= 100000 and area >= 100000) or (top < 100000 and area >= 10000 and image_ix <= 6)""")
def photo_area_pick(spark, sf_dir):
    return associate.large_photos(X.on_spark(spark, sf_dir, X.PHOTOS)).withColumn("image_ix", F.col("image_ix").cast("long"))


_FILE = "select event_id, upper(case when stem similar to '[A-Za-z0-9]+-.*' then regexp_extract(stem, '^([A-Za-z0-9]+)-', 1) else stem end) as id, stem similar to '[A-Za-z0-9]+-.*' as id_ok from (select event_id, regexp_replace(regexp_extract(name, '([^/]*)$', 1), '[.][^.]+$', '') as stem from {FILES}) f"


@query(_FILE)
def file_ids(spark, sf_dir):
    found = T.file_id(F.col("name"))
    return X.on_spark(spark, sf_dir, X.FILES).select("event_id", found["id"].alias("id"), found["ok"].alias("id_ok"))


@query(f"""select event_id, f.id, case when not id_ok then 'ID fora do padrão' when r.id is null then 'ID não encontrado na planilha' else 'ID - OK' end as id_status,
case when id_ok then plate end as plate, case when id_ok then date end as date, case when id_ok then time end as time, case when id_ok then category end as category
from ({_FILE}) f left join (select * from {{SHEET}} where id <> '' qualify row_number() over (partition by id order by sheet_row desc) = 1) r on f.id = r.id""")
def reference_join(spark, sf_dir):
    found = associate.with_reference(file_ids(spark, sf_dir), X.on_spark(spark, sf_dir, X.SHEET))
    return found.drop("id_ok")


_SCORE = """(case status when 'Aprovado - busca nas imagens' then 0 when 'Revisar' then 100 when 'Revisar - sem imagem' then 200 else 300 end
+ case when id_status = 'ID - OK' then 0 else 1000 end + coalesce(cast(trunc(difference) as int), 999))"""


@query(f"select * from (select *, {_SCORE} as score from {{REPORT}}) x qualify row_number() over (partition by id order by score, difference nulls last, file) = 1")
def best_per_id(spark, sf_dir):
    return report.best_per_id(X.on_spark(spark, sf_dir, X.REPORT))


@query("""select *, 100.0 * approved / total as approved_pct, 100.0 * review / total as review_pct, 100.0 * no_image / total as no_image_pct from (select id_status, count(*) as total,
count(*) filter (where status = 'Aprovado - busca nas imagens') as approved, count(*) filter (where status = 'Revisar') as review, count(*) filter (where status = 'Revisar - sem imagem') as no_image from {REPORT} group by id_status) x""")
def status_summary(spark, sf_dir):
    return report.status_summary(X.on_spark(spark, sf_dir, X.REPORT), ("id_status",))


@query("""select file, case status when 'Aprovado - busca nas imagens' then 0 when 'Revisar' then 1 when 'Revisar - sem imagem' then 2 when 'ID não encontrado na planilha' then 3 when 'ID fora do padrão' then 4 else 5 end as priority,
try_cast(case when file like '%7' then 'x' else cast(difference as varchar) end as double) as difference from {REPORT}""")
def priority_map(spark, sf_dir):
    text = F.when(F.col("file").endswith("7"), F.lit("x")).otherwise(F.col("difference").cast("string"))
    return X.on_spark(spark, sf_dir, X.REPORT).select("file", V.priority(F.col("status")).alias("priority"), V.number(text).alias("difference"))


@query("""select file, min(row) as header_row from (select file, row, list(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '', 'g')) as names from {CELLS}
where row <= 40 and raw is not null and trim(raw) <> '' and lower(trim(raw)) not in ('nan', 'none', 'null') group by file, row) x where list_has_all(names, ['placa', 'idpassagem', 'datahora']) group by file""")
def header_detect(spark, sf_dir):
    from ..operators.sheets import header_rows

    return header_rows(X.on_spark(spark, sf_dir, X.CELLS), ("placa", "idpassagem", "datahora"))


@query("select * from {LOADED} where plate is not null or fare is not null")
def drop_empty_rows(spark, sf_dir):
    return V.drop_empty_rows(X.on_spark(spark, sf_dir, X.LOADED))


_BLOCKS = """select passage_id, k, regexp_extract(b, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}\\s+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') as date_time,
list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]{{1,2}}'))[1] as category, regexp_extract(b, '[A-Z]{{3}}[0-9][A-Z0-9][0-9]{{2}}') as plate
from (select passage_id, unnest(range(0, len(bs))) as k, unnest(bs) as b from (select passage_id, string_split(page, 'Data/Hora')[2:] as bs from {BLOCK_PAGES}) y) z""".replace("{{", "{").replace("}}", "}")


@query(f"select passage_id, cast(k as int) as k, date_time, category, plate from ({_BLOCKS}) x where date_time <> '' and category is not null and plate <> ''")
def split_page_blocks(spark, sf_dir):
    own = X.on_spark(spark, sf_dir, X.BLOCK_PAGES).select("passage_id", F.posexplode(T.blocks_after(F.col("page"), "Data/Hora")).alias("k", "b"))
    b = F.col("b")
    return own.select("passage_id", "k", T.date_time(b).alias("date_time"), T.category(b).alias("category"), T.first_plate(b).alias("plate")).na.drop()


_PARTS = r"""select passage_id, upper(trim(regexp_extract(line, p, 1))) as id, regexp_extract(line, p, 2) as date, regexp_extract(line, p, 3) as time,
regexp_extract(regexp_extract(line, p, 4), '[A-Z]{3}[0-9][A-Z0-9][0-9]{2}') as plate, regexp_extract(line, p, 4) as rest from
(select passage_id, list_filter(list_transform(string_split(page, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: regexp_matches(x, '[0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}') and regexp_matches(upper(x), '[A-Z]{3}[0-9][A-Z0-9][0-9]{2}'))[1] as line,
'^(.*?)\s*([0-9]{2}/[0-9]{2}/[0-9]{4})\s+([0-9]{2}:[0-9]{2}:[0-9]{2})\s+(.+)$' as p from {LINES}) x"""


@query(f"select passage_id, id, date, time, plate, trim(substr(rest, 1, strpos(rest, plate) - 1)) as prefix, trim(regexp_replace(substr(rest, strpos(rest, plate) + 7), ' +', ' ', 'g')) as suffix from ({_PARTS}) y")
def parse_passage_line(spark, sf_dir):
    own = X.on_spark(spark, sf_dir, X.LINES).select("passage_id", T.line_parts(T.passage_line(F.col("page"))).alias("parsed"))
    return own.select("passage_id", "parsed.*")


@query(r"""select passage_id, case when w then regexp_extract(s, p1, 1) when v then regexp_extract(s, p2, 1) when u then regexp_extract(s, p3, 1) else s end as model,
case when w then regexp_extract(s, p1, 2) when v then regexp_extract(s, p2, 2) when u then regexp_extract(s, p3, 2) else '' end as axles,
replace(case when w then regexp_extract(s, p1, 3) when v then regexp_extract(s, p2, 3) when u then regexp_extract(s, p3, 3) else '' end, '.', ',') as fare,
regexp_replace(case when w then regexp_extract(s, p1, 4) when v then regexp_extract(s, p2, 4) else '' end, ' +', ' ', 'g') as responsible
from (select *, regexp_matches(s, p1) as w, regexp_matches(s, p2) as v, regexp_matches(s, p3) as u from (select passage_id, suffix as s, '^(.+?)\s+([0-9]+)\s+R\$\s*([0-9]+(?:[.,][0-9]{2})?)\s*(.*)$' as p1,
'^(.+?)\s+([0-9]+)\s+([0-9]+(?:[.,][0-9]{2})?)\s+R\$\s*(.+)$' as p2, '^(.+?)\s+([0-9]+)\s+([0-9]+(?:[.,][0-9]{2})?)\s+R\$?$' as p3 from {LINES}) a) b""")
def parse_suffix(spark, sf_dir):
    return X.on_spark(spark, sf_dir, X.LINES).select("passage_id", T.vehicle_parts(F.col("suffix")).alias("parsed")).select("passage_id", "parsed.*")


@query("""select passage_id, case passage_id % 5 when 0 then 'SP330' when 1 then '330' when 2 then '330' when 3 then 'sp99' else '' end as sp,
case passage_id % 5 when 0 then '12+300' when 1 then 'KM 12+300' when 2 then '12+300' else '' end as km, prefix as rest from {LINES}""")
def parse_sp_km(spark, sf_dir):
    own = X.on_spark(spark, sf_dir, X.LINES)
    return own.select("passage_id", T.road_and_km(F.concat("road", "prefix")).alias("parsed")).select("passage_id", "parsed.*")


@query("""select passage_id, case when passage_id % 3 = 0 then 'POSTO AZUL' else prefix end as plaza, case when passage_id % 3 = 0 then cast(passage_id % 4 as varchar) else '' end as lane, case when passage_id % 3 = 0 then 'NORTE' else '' end as direction,
case when passage_id % 3 = 0 then 'VILA NOVA' else '' end as city, case when passage_id % 3 < 2 then cast(passage_id as varchar) else '' end as code from {LINES}""")
def parse_place(spark, sf_dir):
    return X.on_spark(spark, sf_dir, X.LINES).select("passage_id", T.place_parts(F.col("prefix")).alias("parsed")).select("passage_id", "parsed.*")


@query("""select passage_id, t[1] as id, t[2] as date, t[3] as time, t[4] as sp, t[5] || ' ' || t[6] as km, t[7] as plaza, t[8] as lane, t[9] as direction, t[10] as city, t[11] as code, t[12] as plate,
array_to_string(t[13:len(t) - 4], ' ') as model, t[len(t) - 3] as axles, t[len(t) - 2] as fare, t[len(t)] as responsible
from (select passage_id, string_split(trim(list_filter(string_split(page, chr(10)), lambda x: regexp_matches(x, '^[A-Z0-9]{20,}'))[1]), ' ') as t from {TOKEN_LINES}) x where len(t) >= 12""")
def parse_tokens(spark, sf_dir):
    own = X.on_spark(spark, sf_dir, X.TOKEN_LINES).select("passage_id", T.token_fields(T.token_line(F.col("page"))).alias("parsed"))
    return own.where("parsed is not null").select("passage_id", "parsed.*")


_ID_PAGES = _of(X.ID_PAGES)


@query(r"select passage_id, nullif(regexp_extract(page, '(?s)Data do transito.*?([0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2})', 1), '') as date_time from {ID_PAGES}")
def labelled_date(spark, sf_dir):
    return _ID_PAGES(spark, sf_dir).select("passage_id", T.labelled_date(F.col("page")).alias("date_time"))


@query("select passage_id, regexp_extract(page, '([0-9]+[A-Z]{2,3}[0-9]{10,})', 1) as id from {ID_PAGES} where regexp_matches(page, '[0-9]+[A-Z]{2,3}[0-9]{10,}')")
def transaction_id(spark, sf_dir):
    return _ID_PAGES(spark, sf_dir).select("passage_id", T.transaction_id(F.col("page")).alias("id")).where("id is not null")


@query("select passage_id, nullif(regexp_extract(page, '(^|[^A-Z0-9])([A-Z]{3}[0-9][A-Z0-9][0-9]{2})([^A-Z0-9]|$)', 2), '') as plate from {ID_PAGES}")
def bounded_plate(spark, sf_dir):
    return _ID_PAGES(spark, sf_dir).select("passage_id", T.bounded_plate(F.col("page")).alias("plate"))


@query(r"""select passage_id, case when len(a) = 0 then 'OK' else 'Revisar - dados da passagem' end as status, array_to_string(a, '; ') as alerts from (select passage_id, list_filter([case when passage_id % 6 = 0 then 'id vazio' end,
case when passage_id % 11 = 0 then 'placa vazio' end, case when passage_id % 11 = 0 then 'placa fora do padrao' end, case when try_strptime(date, '%d/%m/%Y') is null then 'data invalida' end,
case when passage_id % 25 > 23 then 'hora invalida' end], lambda x: x is not null) as a from {LINES}) y""")
def validate_passage(spark, sf_dir):
    own = X.on_spark(spark, sf_dir, X.LINES)
    plate = F.when(F.col("passage_id") % 11 == 0, F.lit(" ")).otherwise(F.col("expected_plate"))
    ident = F.when(F.col("passage_id") % 6 == 0, F.lit("")).otherwise(F.lit("x"))
    own = own.select("passage_id", T.alerts(ident, F.col("date"), F.col("time"), plate).alias("a"))
    return own.select("passage_id", T.passage_status(F.col("a")).alias("status"), F.array_join("a", "; ").alias("alerts"))


@query("select passage_id, customer, cast(floor((row_number() over (partition by customer % 20 order by passage_id) - 1) / 64) as int) as batch from {PASSAGES}")
def batch_assign(spark, sf_dir):
    own = _passages(spark, sf_dir).withColumn("file", F.col("customer") % 20)
    return report.batches(own, "file", "passage_id").select("passage_id", "customer", "batch")


@query("select passage_id, image_ix, concat(content_sha, '/', coalesce(mask, '-')) as ocr_text from {DIGESTS}")
def ocr_dedup_cache(spark, sf_dir):
    read = lambda d: d.withColumn("ocr_text", F.concat("content_sha", F.lit("/"), F.coalesce("mask", F.lit("-"))))
    return elect.read_once(X.on_spark(spark, sf_dir, X.DIGESTS), read).select("passage_id", "image_ix", "ocr_text")


@query("select passage_id, expected_plate as plate, cast(null as varchar) as file from {PASSAGES} union all select sheet_row, plate, 'b' from {LOADED}")
def union_files(spark, sf_dir):
    a = _passages(spark, sf_dir).select("passage_id", F.col("expected_plate").alias("plate"))
    b = X.on_spark(spark, sf_dir, X.LOADED).select(F.col("sheet_row").alias("passage_id"), "plate", F.lit("b").alias("file"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""with c as (select row_number() over (order by c_custkey) + 1 as row, * from customer)
select 'customers' as sheet, cast(1 as bigint) as row, cast(col as bigint) as col, raw, 'str' as type from (select 1 as col, 'c_custkey' as raw union all select 2, 'c_name' union all select 3, 'c_acctbal') h
union all select 'customers', row, 1, cast(c_custkey as varchar), 'int' from c union all select 'customers', row, 2, c_name, 'str' from c union all select 'customers', row, 3, cast(c_acctbal as varchar), 'float' from c""")
def workbook_round_trip(spark, sf_dir):
    """The customers written as a workbook and read again as cells."""
    from ..sources import files, xlsx
    from ..sources.scratch import scratch_path

    path = scratch_path(spark, "customers.xlsx")
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal").orderBy("c_custkey")
    xlsx.write({"customers": own}, path)
    return xlsx.cells(files.files(spark, path, "xlsx")).select("sheet", "row", F.col("col").cast("long").alias("col"), "raw", "type")

