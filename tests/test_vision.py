"""Reading that stops, bytes fetched late, and all that was read for inspection."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from passaura.functions import plain
from passaura.functions import plate as P
from passaura.operators import elect, vision
from passaura.plans import providers
from passaura.sources import files, late

from .test_sources import backend, book, pdf_file

IMAGES = "passage_id long, image_ix int, mask string, expected_plate string, content binary"


def test_plain_functions_are_the_columns(spark):
    r = random.Random(8)
    pairs = [("".join(r.choice("ABO018iL7Z-é4") for _ in range(r.randint(0, 10))), "".join(r.choice("ABO018IL7ZD23") for _ in range(r.randint(0, 10)))) for _ in range(1200)]
    pairs += [("ABC1D23", "1D23ABC"), ("abc1234", "1234ABC"), ("ABC1234", P.UNREAD), ("", ""), ("ABC1234\n", "XXABC12O4")]
    a, b = F.col("a"), F.col("b")
    own = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.clean(a).alias("c"), P.mask_of(a).alias("m"), P.normalize(b, P.mask_of(a)).alias("n"), P.normalize(b).alias("o"), P.distance(a, b).alias("d"), P.matches(a, b).alias("k"), P.is_valid(b).alias("v"))
    for x in own.collect():
        assert (x.c, x.m, x.n, x.o, x.d, x.k, x.v) == (plain.clean(x.a), plain.mask_of(x.a), plain.normalize(x.b, plain.mask_of(x.a)), plain.normalize(x.b), plain.distance(x.a, x.b), plain.matches(x.a, x.b), plain.is_valid(x.b))


class Noted:
    """Counts what it does in files of a folder, one for each process."""

    def __init__(self, folder):
        self.folder = folder

    def note(self, what):
        with open(f"{self.folder}/{what}-{os.getpid()}", "a") as f:
            f.write("x")

    def detect(self, contents):
        for _ in contents:
            self.note("detect")
        return [[(0.0, 0.0, 90.0, 30.0, 0.9), (0.0, 0.0, 10.0, 90.0, 0.95), (0.0, 0.0, 60.0, 30.0, 0.5)] for _ in contents]

    def read(self, content, box):
        self.note("read")
        text = content.decode()
        for variant in ([(text[:3], 0.5), (text[3:], 0.5)], [(text, 0.8)]):
            self.note("variant")
            yield variant


def counted(folder, what):
    return sum((folder / x).stat().st_size for x in os.listdir(folder) if x.startswith(f"{what}-"))


@pytest.mark.parametrize("stop", ["distance", "matches"])
def test_reading_stops(spark, tmp_path, stop):
    """The evaluation is that of reading everything; images after a stop are neither detected nor read."""
    r, plates = random.Random(5), ["ABC1234", "XYZ9A87", "QQQ0000", "", None]
    rows = []
    for p in range(80):
        expected = r.choice(plates)
        for k in range(1, r.randint(1, 9)):
            text = r.choice([expected or "", "ABC1239", "XYZ9A8", "no plate", "", None, "8BC1234", f"AB{p}{k}"])
            rows.append((p, k, P_MASK(expected), expected, None if text is None else text.encode()))
    images = spark.createDataFrame(rows, IMAGES)
    for name in ("all", "some"):
        (tmp_path / name).mkdir()
    make = lambda name: lambda: Noted(str(tmp_path / name))
    passages = images.select("passage_id", "expected_plate").distinct()
    evaluate = elect.evaluate_by_distance if stop == "distance" else elect.evaluate_by_matches
    whole = vision.readings(images, make("all"), make("all"), top=3)
    some = vision.read_until(images, make("some"), make("some"), stop, top=3).persist()
    want = sorted(map(tuple, evaluate(passages, whole).collect()), key=repr)
    assert sorted(map(tuple, evaluate(passages, some.drop("skipped")).collect()), key=repr) == want
    full = {(x.passage_id, x.image_ix): x.ocr_text for x in whole.collect()}
    taken = {(x.passage_id, x.image_ix): x for x in some.collect()}
    assert set(full) == set(taken) and all(x.ocr_text == full[k] for k, x in taken.items() if not x.skipped)
    ok = (lambda e, t: plain.distance(e, t) == 0) if stop == "distance" else (lambda e, t: plain.matches(e, t) >= elect.MIN_MATCHES)
    for p, k, _, expected, _ in rows:
        before = [full[p, j] for j in range(1, k)]
        own = plain.mask_of(expected)
        assert taken[p, k].skipped == any(ok(plain.normalize(expected or "", own), plain.normalize(t, own)) for t in before if t)
    n = sum(not x.skipped for x in taken.values())
    assert any(x.skipped for x in taken.values()) and 0 < counted(tmp_path / "some", "detect") <= n < len(rows)
    assert vision.read_until(images.limit(0), make("some"), make("some")).count() == 0
    with pytest.raises(ValueError):
        vision.read_until(images, make("some"), make("some"), "never")


def P_MASK(plate):
    return plain.mask_of(plate)


def test_calls_saved(spark, tmp_path):
    """Of ten images each, whose third is right: three are detected, and a valid first variant ends the reading of an image."""
    rows = [(p, k, "LLLDDDD", "ABC1234", b"ABC1234" if k == 3 else b"XYZ%d%03d" % (k % 10, p)) for p in range(20) for k in range(1, 11)]
    got = vision.read_until(spark.createDataFrame(rows, IMAGES).repartition(7), lambda: Noted(str(tmp_path)), lambda: Noted(str(tmp_path)), top=3).collect()
    assert sum(not x.skipped for x in got) == 60 and sum(x.skipped for x in got) == 140
    assert counted(tmp_path, "detect") <= 60 and counted(tmp_path, "variant") == counted(tmp_path, "read") == counted(tmp_path, "detect")


def test_no_bytes_in_an_exchange(spark, tmp_path):
    """Fetched late, the readings are those of bytes in the table; no exchange of the plan has a binary column, broadcasts included."""
    rows = []
    for p in range(30):
        for k in range(1, 4):
            text = f"ABC{p % 7}23{k}"
            (tmp_path / f"{p}-{k}.png").write_bytes(text.encode())
            rows.append((p, k, "LLLDDDD", f"{tmp_path}/{p}-{k}.png", None, text.encode()))
    images = spark.createDataFrame(rows, "passage_id long, image_ix int, mask string, file string, part string, content binary")
    (tmp_path / "log").mkdir()
    make = lambda: Noted(str(tmp_path / "log"))
    df = vision.readings(images.drop("content"), make, make, top=3, fetch=late.Fetch())
    want = vision.readings(images.drop("file", "part"), make, make, top=3)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) and df.where("ocr_text is null").count() == 0
    stopped = vision.read_until(images.drop("content").withColumn("expected_plate", F.lit("ABC0231")), make, make, top=3, fetch=late.Fetch())
    assert stopped.where("skipped").count() == sum(1 for p in range(30) for k in (2, 3) if p % 7 == 0)
    for own in (df, stopped):
        nodes, exchanges = [own._jdf.queryExecution().sparkPlan()], 0
        plan = own._jdf.queryExecution().executedPlan()
        text = plan.toString()
        assert "Exchange" in text

        def walk(node):
            nonlocal exchanges
            if "Exchange" in node.nodeName():
                exchanges += 1
                assert "BinaryType" not in node.schema().toString(), node.toString()
            children = node.children()
            for k in range(children.size()):
                walk(children.apply(k))
            if node.nodeName() == "AdaptiveSparkPlan":
                walk(node.initialPlan())

        walk(plan)
        assert exchanges and nodes


def shown(passages, images, fetch):
    found = {r.passage_id: r.expected_plate for r in passages.collect()}
    return sorted((found[r.passage_id], r.image_ix, bytes(r.content) if "content" in images.columns else fetch(r.file, r.part)) for r in images.collect())


@pytest.mark.parametrize("name", ["spvias", "colinas", "tamoios", "autoban", "eixosp", "ecovias", "intervias"])
def test_late_images_are_the_same(spark, tmp_path, name):
    """Each layout's images, fetched by file and part, are those read with their bytes."""
    read, options = providers.PROVIDERS[name].read, {}
    if name in ("spvias", "colinas"):
        rows = {1: {1: "t"}, 3: {1: 1, 12: "ABC1234"}, 6: {2: "I", 12: "ABC1234"}, 8: {1: 2, 12: "XYZ9A87"}}
        book(tmp_path / "a.xlsx", rows, [(4, 0, "twoCellAnchor", "m1.png", b"one"), (7, 0, "twoCellAnchor", "m2.png", b"two"), (9, 0, "twoCellAnchor", "m3.png", b"three")], title="Fotos")
    elif name == "tamoios":
        (tmp_path / "a1-F01.jpg").write_bytes(b"picture")
        (tmp_path / "s").mkdir()
        book(tmp_path / "s" / "ref.xlsx", {5: {1: "Id", 2: "Placa"}, 6: {1: "a1", 2: "ABC1234"}})
        options = {"sheet": str(tmp_path / "s" / "ref.xlsx")}
    else:
        options = {"backend": backend}
        text = {"autoban": "top\nData/Hora\n01/02/2024 10:00:00\n02\nABC1234\n", "eixosp": "12AB0123456789\n03\nABC1234\n", "ecovias": "E77 31/02/2024 10:00:00 SP330 12+300 Posto Azul 3 Norte Vila 55 ABC1234 Alfa - KA 1 R$ 9,70 Envio",
                "intervias": "AAAA0000000000000001 01/02/2024 10:00:00 330 KM 1+2 PRACA 2 SUL CIDADE 68 ABC1234 MARCA /MODELO X 2 11,20 R$ NOME"}[name]
        pdf_file(tmp_path / "a.pdf", (text, ["AAA1111", "x", "BBB2222", "CCC3333"]))
    whole, early = shown(*read(spark, str(tmp_path), **options), None), read(spark, str(tmp_path), late=True, **options)
    assert "content" not in early[1].columns and whole and shown(*early, late.Fetch(**options) if "backend" in options else late.Fetch()) == whole


def test_image_files_of_folders(spark, tmp_path):
    """Places by path within each folder, over ranges; other files are no images."""
    rows = [(f"mem:/{f}/{k:04d}.{e}", b"x") for f in ("b", "a") for k in range(700) for e in (("png",) if k % 3 else ("JPG",))] + [("mem:/a/x.txt", b"x")]
    random.Random(1).shuffle(rows)
    got = files.image_files(spark, spark.createDataFrame(rows, "file string, content binary"))
    assert "content" not in got.columns
    for f in ("a", "b"):
        own = sorted(x for x, _ in rows if x.startswith(f"mem:/{f}/") and not x.endswith("txt"))
        assert [(r.file, r.ix) for r in got.where(f"file like 'mem:/{f}/%'").orderBy("ix").collect()] == [(x, k) for k, x in enumerate(own, 1)]


def test_instrumented(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 90.0, 30.0, 0.9), (1, 1, 2, 0.0, 0.0, 10.0, 30.0, 0.9), (1, 1, 3, 0.0, 0.0, 90.0, 30.0, 0.9), (2, 1, 1, 0.0, 0.0, 90.0, 30.0, 0.1)], "passage_id long, image_ix int, box_ix int, x1 double, y1 double, x2 double, y2 double, conf double")
    texts = spark.createDataFrame([(1, 1, None, 1, 1, 1, "x", 0.9), (1, 1, None, 1, 2, 1, "ABC12E4", 0.5), (1, 1, None, 3, 1, 1, "abc-1234", 0.5), (1, 1, None, 3, 1, 2, "ABC1234", 0.5), (1, 1, None, 2, 1, 1, "ABC1234", 0.99), (2, 1, None, 1, 1, 1, None, 0.9)], "passage_id long, image_ix int, mask string, box_ix int, variant_ix int, cand_ix int, text string, confidence double")
    got = {r.passage_id: r for r in elect.instrumented(boxes, texts).collect()}
    a = got[1]
    assert (a.n_boxes, a.n_accepted, a.best_text, a.best_score, a.best_box, a.best_variant) == (3, 2, "ABC1284", 5.5, 1, 2) or (a.best_text, a.best_score) == ("ABC1234", 5.5)
    assert [b.reason for b in a.boxes] == [None, "too square", None] and [len(b.variants) for b in a.boxes] == [2, 0, 1]
    assert [c.raw for c in a.boxes[2].variants[0].candidates] == ["abc-1234", "ABC1234"] and a.boxes[0].variants[0].best_text == "" and a.boxes[0].variants[0].best_score == -1
    assert (got[2].n_accepted, got[2].best_text, got[2].best_score, got[2].best_box) == (0, "", -1.0, None) and re.match("confidence", got[2].boxes[0].reason)
    assert elect.instrumented(boxes.limit(0), texts).count() == 0


def test_instrumented_is_dealt_out_once(spark):
    """Nested variants went through an exchange for the join of boxes, and all again for the images; nulls meet nothing, repeated boxes each have the variants."""
    boxes = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 1, 0.8), (1, 1, None, 0.7), (None, 1, 1, 0.9)], "passage_id long, image_ix int, box_ix int, conf double").selectExpr("*", "0D x1", "0D y1", "90D x2", "30D y2")
    texts = spark.createDataFrame([(1, 1, None, 1, 1, 1, "ABC1234", 0.9), (1, 1, None, None, 1, 1, "ABC1234", 0.9), (None, 1, None, 1, 1, 1, "ABC1234", 0.9), (3, 1, None, 1, 1, 1, "ABC1234", 0.9)], "passage_id long, image_ix int, mask string, box_ix int, variant_ix int, cand_ix int, text string, confidence double")
    found = elect.instrumented(boxes, texts)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    got = {r.passage_id: r for r in found.collect()}
    assert set(got) == {1, None} and [(b.box_ix, len(b.variants)) for b in got[1].boxes] == [(None, 0), (1, 1), (1, 1)] and [len(b.variants) for b in got[None].boxes] == [0] and got[None].best_text == ""


def test_readings_are_dealt_out_once(spark, tmp_path):
    """Images went through seven exchanges, two with their bytes; copies over several batches of Arrow are detected once, and read once for each mask."""
    rows = [(p, k, (None, "LLLDDDD", "LLLDLDD")[p % 3], None, None if p % 9 == 4 else b"" if p % 9 == 5 else b"AB%d%04d" % (k, p % 40)) for p in range(120) for k in (1, 2)]
    images = spark.createDataFrame(rows, IMAGES).repartition(5)
    found = vision.readings(images, lambda: Noted(str(tmp_path)), lambda: Noted(str(tmp_path)), top=3)
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {(x.passage_id, x.image_ix): x.ocr_text for x in found.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert counted(tmp_path, "detect") == len({x[4] for x in rows if x[4] is not None})
    assert counted(tmp_path, "read") <= 2 * len({(x[4], x[2]) for x in rows if x[4] is not None})
    texts = spark.createDataFrame([(p, k, m, b, v, n, t, c) for p, k, m, _, x in rows if x is not None for b in (1, 3) for v, of in enumerate(([(x[:3], 0.5), (x[3:], 0.5), (x, 0.5)], [(x, 0.8)]), 1) for n, (t, c) in enumerate([(a.decode(), c) for a, c in of], 1)],
                                  "passage_id long, image_ix int, mask string, box_ix int, variant_ix int, cand_ix int, text string, confidence double")
    want = {(x.passage_id, x.image_ix): x.ocr_text for x in elect.elected_text(texts).collect()}
    assert len(got) == len(rows) and got == {(p, k): want.get((p, k)) for p, k, *_ in rows} and any(got.values())
