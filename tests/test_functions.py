"""Plate and text functions: worked cases, and against plain Python on random plates."""

import random
from collections import Counter

from pyspark.sql import functions as F

from passaura.functions import plain
from passaura.functions import plate as P
from passaura.functions import text as T
from passaura.functions import values as V
from passaura.operators import elect, html_report, report, vision


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_plate_cases(spark):
    c = F.col("a")
    for a, want in (("ab-c 1234", "ABC1234"), ("1234ABC", "ABC1234"), ("1D23ABC", "ABC1D23"), ("ABC1234\n", "ABC1234"), (None, None)):
        assert one(spark, P.clean(c), a=a) == want
    for a, want in (("ABC1234", "LLLDDDD"), ("ABC1D23", "LLLDLDD"), ("AB12", None)):
        assert one(spark, P.mask_of(c), a=a) == want
    assert one(spark, P.fit_mask(c, F.lit("LLLDDDD")), a="A8C12O4") == "ABC1204"
    for a, want in (("XABC1234", "ABC1234"), ("ABC12", "ABC12"), ("", ""), ("A8C12O4", "ABC1204"), ("??", "")):
        assert one(spark, P.normalize(c), a=a) == want
    assert not one(spark, P.is_valid(c), a="ABC1234\n") and one(spark, P.is_valid(c), a="ABC1D34")


def clean(s):
    s = "".join(x for x in s.upper() if x.isascii() and x.isalnum())
    shape = "".join("9" if x.isdigit() else "A" for x in s)
    return s[4:] + s[:4] if shape in ("9999AAA", "9A99AAA") else s


def distance(a, b):
    a, b = clean(a), clean(b)
    if not a or not b:
        return 999.0
    near = {frozenset(x) for x in P.CONFUSED.split()}
    row = [100 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [100 * i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 100, new[-1] + 100, row[j - 1] + (0 if x == y else 35 if frozenset((x, y)) in near else 100)))
        row = new
    return row[-1] / 100


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_against_plain_python(spark):
    r = random.Random(1)
    pairs = [("ABC1234", "ABC1234"), ("ABC1230", "ABC123O"), ("ABC1234", "ABC123"), ("", "ABC1234"), ("ABC1234", "1234ABC")]
    pairs += [("".join(r.choice("ABO018IL7Z") for _ in range(r.randint(0, 8))), "".join(r.choice("ABO018IL7Z") for _ in range(r.randint(0, 8)))) for _ in range(1500)]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", P.distance(a, b).alias("d"), P.common_subsequence(a, b).alias("l"), P.matches(a, b).alias("m"), P.same_places(a, b).alias("s"), P.distance(b, a).alias("e")).collect()
    assert [x.d for x in rows[:5]] == [0.0, 0.35, 1.0, 999.0, 0.0]
    for x in rows:
        assert x.d == distance(x.a, x.b) == x.e
        assert x.l == subsequence(x.a, x.b)
        p, q = clean(x.a), clean(x.b)
        shared = sum((Counter(p) & Counter(q)).values())
        assert x.m == shared == max(shared, subsequence(p, q), sum(u == v for u, v in zip(p, q, strict=False)))
        assert x.s == sum(u == v for u, v in zip(x.a, x.b, strict=False))
    (x,) = spark.createDataFrame([("ABC1234", "ABD1243")], "a string, b string").select(P.common_subsequence(a, b), P.matches(a, b)).collect()
    assert tuple(x) == (5, 6)


def readings(spark, own):
    return spark.createDataFrame([(p, k, t) for p, texts in own.items() for k, t in enumerate(texts, 1)], "passage_id long, image_ix int, ocr_text string")


def test_evaluations(spark):
    own = {1: [None, "ABC1298", "ABC1234", "ABC1239"], 2: ["ABC1239", "ABC1238"], 4: [None, None], 5: ["ZZZZZZZ"]}
    passages = spark.createDataFrame([(k, "ABC1234") for k in range(1, 6)] + [(6, "")], "passage_id long, expected_plate string")
    got = {r.passage_id: r for r in elect.evaluate_by_distance(passages, readings(spark, own | {6: ["ABC1234"]})).collect()}
    assert (got[1].image_used, got[1].difference, got[1].images_with_ocr, got[1].total_images, got[1].status) == (3, 0.0, 2, 4, elect.APPROVED)
    assert (got[2].image_used, got[2].difference, got[2].plate_result) == (1, 1.0, "ABC1234")
    assert (got[3].status, got[3].difference, got[3].total_images) == (elect.NO_IMAGE, 999.0, 0)
    assert (got[4].status, got[4].difference, got[4].image_used, got[4].plate_result) == (elect.REVIEW, 999.0, None, P.UNREAD)
    assert got[5].status == elect.REVIEW and got[5].plate_result != P.UNREAD
    assert (got[6].status, got[6].image_used) == (elect.REVIEW, None)
    read = {r.passage_id: r for r in elect.evaluate_by_distance(passages, readings(spark, own), show="read", raw="normalized").collect()}
    assert read[2].plate_result == "ABC1239" and read[2].status == elect.APPROVED
    by = {1: ["ABC9999", "ABC1999", "ABC1234"]}
    (m,) = elect.evaluate_by_matches(passages.where("passage_id = 1"), readings(spark, by)).collect()
    assert (m.image_used, m.matches, m.images_with_ocr, m.status) == (2, 4, 2, elect.APPROVED)
    assert elect.evaluate_by_distance(passages.limit(0), readings(spark, own)).count() == 0


def test_best_per_id_and_summary(spark):
    rows = spark.createDataFrame([("A", "ID - OK", elect.APPROVED, 2.9, "f1"), ("A", "ID - OK", elect.REVIEW, 0.2, "f2"), ("B", "ID - OK", "", None, "f3"), (None, "ID - OK", "", None, "f4")], "id string, id_status string, status string, difference double, file string")
    got = {r.id: r for r in report.best_per_id(rows).collect()}
    assert got["A"].file == "f1" and got["A"].score == 2 and got["B"].score == 1299 and None in got
    assert report.summary_text(report.status_summary(rows))[:2] == ["Total: 4", "approved: 1 (25%)"]


def test_text(spark):
    c = F.col("a")
    assert one(spark, T.normalize_text(c), a=" a  b–c\t d \n") == "a b-c d"
    assert one(spark, T.bounded_plate(c), a="XABC1234 ABC1D34.") == "ABC1D34"
    assert one(spark, T.first_plate(c), a="XABC1234") == "ABC1234" and one(spark, T.first_plate(c), a="none") is None
    assert one(spark, T.category(c), a="123\n 7 \n8") == "7"
    assert one(spark, T.blocks_after(c, "Data/Hora"), a="x") == [] and one(spark, T.blocks_after(c, "."), a="a.b.c") == ["b", "c"]
    broken = "Título\nE1 01/02/2024\n10:00:00 330\nABC1234 Alfa\nCONCESSIONARIA X"
    assert one(spark, T.passage_line(c), a=broken) == "Titulo E1 01/02/2024 10:00:00 330 ABC1234 Alfa"
    assert one(spark, T.line_parts(c), a="no plate 01/02/2024 10:00:00 x") is None
    assert one(spark, T.token_fields(c), a="a b c") is None
    ok = one(spark, T.alerts(F.lit("x"), F.lit("29/02/2024"), F.lit("23:59:59"), F.lit("abc1234")), a="")
    assert ok == [] and one(spark, T.alerts(c, F.lit("31/02/2024"), F.lit("24:00:00"), F.lit(None).cast("string")), a=None) == ["id vazio", "placa vazio", "placa fora do padrao", "data invalida", "hora invalida"]
    assert tuple(one(spark, T.file_id(c), a="dir/060a-F02.jpg")) == ("060A", True) and tuple(one(spark, T.file_id(c), a="nohyphen.png")) == ("NOHYPHEN", False)


def test_values(spark):
    assert V.resolve(["ID Transação", "Placa", "PLACA "], ["placa"]) == "PLACA "
    assert V.image_columns(["Foto 1", "x", "Imagem B"]) == ["Foto 1", "Imagem B"] and V.image_columns(["Imagem da Passagem 1", "Foto"], prefix="Imagem da Passagem") == ["Imagem da Passagem 1"]
    df = V.with_synonyms(spark.createDataFrame([("a", "b")], "`Id Passagem` string, Categoria string"), {"id": ["id passagem"], "time": ["hora"]})
    assert df.select("id", "time").first() == ("a", "")
    assert one(spark, V.decimal_comma(F.col("a")), a=" 9,70").as_tuple().digits == (9, 7, 0) and one(spark, V.number(F.col("a")), a="x") is None
    assert one(spark, V.has_value(F.col("a")), a=" NaN ") is False


class FakeDetector:
    def detect(self, contents):
        return [[(0, 0, 100, 40, 0.9), (0, 0, 10, 40, 0.99)] if x == b"square first" else [(0, 0, 100, 40, 0.9)] for x in contents]


class FakeReader:
    def read(self, content, box):
        return [[("AB", 0.9), ("C1234", 0.7)]] if content == b"parts" else [[(content.decode(), 0.5)]]


def test_vision_boundary(spark):
    images = spark.createDataFrame([(1, 1, None, b"ABC1234"), (1, 2, None, b"ABC1234"), (2, 1, None, b"parts"), (3, 1, None, b"square first"), (4, 1, None, None)], "passage_id long, image_ix int, mask string, content binary")
    got = {(r.passage_id, r.image_ix): r.ocr_text for r in vision.readings(images, FakeDetector, FakeReader).collect()}
    assert got == {(1, 1): "ABC1234", (1, 2): "ABC1234", (2, 1): "ABC1234", (3, 1): None, (4, 1): None}
    boxes = vision.diagnostics(vision.boxes(images.selectExpr("'x' as content_sha", "content"), FakeDetector))
    assert {r.reason for r in boxes.collect()} == {None, "too square"}


def test_html_report(spark):
    rows = spark.createDataFrame([("<A>", "A", bytearray(b"x"))], "expected string, read string, picture binary").withColumn("match", html_report.match_class(F.col("expected"), F.col("read")))
    text = "".join(html_report.page(rows, "t"))
    assert "&lt;A&gt;" in text and 'class="partial"' in text and "base64,eA==" in text


def test_stream(spark, tmp_path):
    from passaura.streaming.passages import evaluate_stream

    rows = spark.createDataFrame([(1, 1, "ABC1234", "2024-01-01 00:00:00"), (2, 1, "ZZZ0000", "2024-01-01 00:01:00"), (3, 1, "x", "2024-01-01 02:00:00")], "passage_id long, image_ix int, ocr_text string, t string")
    rows.select("passage_id", "image_ix", "ocr_text", F.to_timestamp("t").alias("read_at")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("passage_id long, image_ix int, ocr_text string, read_at timestamp").parquet(f"{tmp_path}/in")
    passages = spark.createDataFrame([(1, "ABC1234"), (2, "ABC1234"), (3, "ABC1234")], "passage_id long, expected_plate string")
    evaluate_stream(passages, stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.passage_id: r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: elect.APPROVED, 2: elect.REVIEW}


def test_without_accents_is_unicodes(spark):
    """All code points but surrogates, one by one and together, against Unicode's own decomposition."""
    import unicodedata

    points = [k for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    texts = ["".join(map(chr, points[k : k + 50])) for k in range(0, len(points), 50)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8).select("t", T.without_accents(F.col("t")).alias("b")).collect()
    wrong = [(hex(ord(c)), x.b) for x in rows if x.b != bare(x.t) for c in x.t[:1]]
    assert len(rows) == len(texts) and not wrong, wrong[:3]
    singles = [chr(k) for k in points if bare(chr(k)) != chr(k)]
    for x in spark.createDataFrame([(c,) for c in singles], "t string").select("t", T.without_accents(F.col("t")).alias("b")).collect():
        assert x.b == bare(x.t), hex(ord(x.t))


def test_sql_functions_are_the_columns(spark):
    from passaura.functions import sql

    sql.register(spark)
    r = random.Random(3)
    pairs = [(None, "ABC1234"), ("ABC1234", None), ("", ""), ("1D23ABC", "abc-1d23"), ("ABC1234", P.UNREAD)] + [("".join(r.choice("ABO018iL7Z-") for _ in range(r.randint(0, 9))), "".join(r.choice("ABO018IL7ZD23") for _ in range(r.randint(0, 9)))) for _ in range(500)]
    spark.createDataFrame(pairs, "a string, b string").createOrReplaceTempView("plate_pairs")
    a, b = F.col("a"), F.col("b")
    own = spark.table("plate_pairs").select("a", "b", P.clean(a), P.mask_of(a), P.is_valid(b), P.fit_mask(b, P.mask_of(a)), P.normalize(b, P.mask_of(a)), P.normalize(b), P.distance(a, b), P.matches(a, b))
    text = spark.sql("SELECT a, b, plate_clean(a), plate_mask(a), plate_is_valid(b), plate_fit(b, plate_mask(a)), plate_normalize(b, plate_mask(a)), plate_normalize(b, NULL), plate_distance(a, b), plate_matches(a, b) FROM plate_pairs")
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, text.collect()), key=repr)
    assert [tuple(x) for x in spark.sql("SELECT k, block FROM blocks_after('a.*b.*c', '.*')").collect()] == [(0, "b"), (1, "c")]


def test_plates_that_hold_each_other_fill_no_table(spark, monkeypatch):
    """A plate with a character lost or added at an end, and whole ones, filled the table of the weighted distance."""
    from passaura.functions import plain, sql

    pairs = [("ABC1234", "ABC123"), ("ABC1234", "XABC1234"), ("ABC1234", "BC1234"), ("ABC1234", "ABC12340"), ("AAAA", "AA"), ("ABC1234", "ABC1234"), ("ABC1234", "4321CBA"), ("ABC1O", "A8C10"), ("", "A"), (None, "A"), ("ABC1234", "C12"), ("AB", "BAB0"), ("1234ABC", "ABC1234")]
    df = sql.register(spark).createDataFrame(pairs, "a string, b string").coalesce(1)
    for x in df.selectExpr("*", "plate_distance(a, b) as d", "plate_matches(a, b) as m").withColumns({"e": P.distance(F.col("a"), F.col("b")), "n": P.matches(F.col("a"), F.col("b"))}).collect():
        assert x.d == x.e == plain.distance(x.a or "", x.b or "") and x.m == x.n == plain.matches(x.a or "", x.b or ""), x
    with monkeypatch.context() as m:
        m.setattr(P, "_table", lambda a, b, first, cell: F.raise_error(F.lit("table")).cast("int"))
        m.setattr(P, "shared_letters", lambda a, b: F.raise_error(F.lit("letters")).cast("int"))
        held = df.limit(6).select(P.distance(F.col("a"), F.col("b")).alias("d"), P.matches(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(r.d, r.m) for r in held] == [(1, 6), (1, 7), (1, 6), (1, 7), (2, 2), (0, 7)]


def test_evaluations_sort_no_readings(spark):
    """F17 to F20: stops are found in one aggregation, without a window over the readings; what comes after a stop neither counts nor is elected, a null place is the first."""
    passages = spark.createDataFrame([(1, "ABC1234"), (2, "ABC1234"), (3, "ABC1234"), (4, "ABC1234")], "passage_id long, expected_plate string")
    reads = [(1, 3, "ABC1234"), (1, 1, "XYZ9999"), (1, 2, "ABC1234"), (1, 4, "ABC1235"), (2, None, "ABC1234"), (2, 1, "ABC1234"), (3, 1, None), (3, 2, "ABC1299"), (3, 3, "ABC1239"), (3, 4, None)]
    own = spark.createDataFrame(reads, "passage_id long, image_ix int, ocr_text string")
    by_distance, by_matches = elect.evaluate_by_distance(passages, own), elect.evaluate_by_matches(passages, own)
    shown = lambda df: [(r.passage_id, r.image_used, r.total_images, r.images_with_ocr, r.ocr_raw) for r in df.orderBy("passage_id").collect()]
    assert shown(by_distance) == [(1, 2, 4, 2, "ABC1234"), (2, None, 2, 1, "ABC1234"), (3, 3, 4, 2, "ABC1239"), (4, None, 0, 0, "")]
    assert shown(by_matches) == [(1, 2, 4, 2, "ABC1234"), (2, None, 2, 1, "ABC1234"), (3, 2, 4, 1, "ABC1299"), (4, None, 0, 0, "")]
    for df in (by_distance, by_matches):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_distance_between_bounds(spark):
    """Where confusions make no difference the distance is the built-in edit distance, else weighed; the table was filled for all before."""
    kind = str.maketrans(*P.KINDS)
    assert all(x.translate(kind) == y.translate(kind) for x, y in P.CONFUSED.split())
    r = random.Random(3)
    some = lambda of: "".join(r.choice(of) for _ in range(r.randint(1, 9)))
    pairs = [(some("0OD1ILT2Z7"), some("0OD1ILT2Z7")) for _ in range(400)] + [(some("4A5S6G8BE3X"), some("4A5S6G8BE3X")) for _ in range(400)] + [(some("ABC0123O"), some("XYZ6789D")) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(x.d == plain.distance(x.a, x.b) for x in rows)
    plan = spark.createDataFrame(pairs, "a string, b string").select(P.distance(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" in plan
