"""Fields of passages in the text of documents, as column functions. Digits are ASCII digits."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plate import bound, is_valid

DATE_TIME = r"[0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}"
PLATE = r"[A-Z]{3}[0-9][A-Z0-9][0-9]{2}"
#: The directions of a road that a line names.
DIRECTIONS = ("NORTE", "SUL", "LESTE", "OESTE", "INTERIOR", "CAPITAL", "CRESCENTE", "DECRESCENTE")
#: Dashes that stand for a hyphen.
DASHES = "‐‑‒–—−"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def groups(text: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that must fit the whole text, as an array; null if it does not fit."""
    return F.when(text.rlike(pattern), F.array(*(F.regexp_extract(text, pattern, k) for k in range(1, n + 1))))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def normalize_text(text: Column) -> Column:
    """Hard blanks and dashes made plain, runs of blanks and tabs one space, ends trimmed."""
    plain = F.translate(text, " " + DASHES, " " + "-" * len(DASHES))
    return trimmed(F.regexp_replace(plain, r"[ \t]+", " "))


@functools.cache
def _bare() -> tuple[str, str, dict[str, str]]:
    """Characters with one bare character and these, combining marks last; and those with several, by Unicode's compatibility decomposition."""
    one, several, marks = {}, {}, []
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000))):  # Hangul syllables are spelled by rule
        if unicodedata.combining(c):
            marks.append(c)
            continue
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if bare != c:
            (one if len(bare) == 1 else several)[c] = bare
    return "".join(one) + "".join(marks), "".join(one.values()), several


def without_accents(text: Column) -> Column:
    """Characters by their compatibility decomposition (NFKD) without combining marks: é as e, ﬁ as fi, ² as 2.

    Hangul syllables are spelled by their letters, which follow from a syllable's number.
    """
    old, new, several = _bare()
    plain, keys, spellings = F.translate(text, old, new), F.lit("".join(several)), F.array(*map(F.lit, several.values()))
    letters = lambda first, n: F.lit("".join(map(chr, range(first, first + n))))

    def spelled(c: Column) -> Column:
        place, n = F.position(c, keys), F.ascii(c) - 0xAC00
        vowel = (n % 588 / 28).cast("int")
        hangul = F.concat(letters(0x1100, 19).substr((n / 588).cast("int") + 1, F.lit(1)), letters(0x1161, 21).substr(vowel + 1, F.lit(1)), letters(0x11A8, 27).substr(n % 28, F.when(n % 28 > 0, 1).otherwise(0)))
        return F.when((c >= "\uac00") & (c <= "\ud7a3"), hangul).when((c != "") & (place > 0), F.get(spellings, place - 1)).otherwise(c)

    has = (F.length(F.translate(plain, "".join(several), "")) < F.length(plain)) | plain.rlike("[\uac00-\ud7a3]")
    return F.when(has, F.array_join(F.transform(F.split(plain, ""), spelled), "")).otherwise(plain)


def first_plate(text: Column) -> Column:
    return extract(text, f"({PLATE})")


def bounded_plate(text: Column) -> Column:
    """The first plate that no letter A-Z or digit touches."""
    return extract(text, rf"(?<![A-Z0-9])({PLATE})(?![A-Z0-9])")


def date_time(text: Column) -> Column:
    return extract(text, f"({DATE_TIME})")


def labelled_date(text: Column) -> Column:
    """The first date and time after the transit date's label; null without."""
    return extract(text, r"(?s)Data do transito.*?([0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2})")


def transaction_id(text: Column) -> Column:
    return extract(text, r"([0-9]+[A-Z]{2,3}[0-9]{10,})")


def category(text: Column) -> Column:
    """The first line that is one or two digits."""
    lines = F.transform(F.split(text, "\n"), trimmed)
    return F.get(F.filter(lines, lambda x: x.rlike(r"^[0-9]{1,2}\z")), F.lit(0))


def blocks_after(text: Column, marker: str) -> Column:
    """The parts of a page after each marker; what comes before the first is dropped."""
    parts = F.split(text, rf"\Q{marker}\E")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def passage_line(text: Column) -> Column:
    """The line of a passage: the first with a date-time and a plate.

    If extraction broke the lines of the table: up to 80 characters before the first date-time that a plate
    follows, up to the next section's title or the end, over the text as one line without accents.
    """
    dated = F.filter(lines_of(text), lambda x: x.rlike("[0-9]{2}/[0-9]{2}/[0-9]{4}"))  # which normalising leaves as it is
    direct = F.get(F.filter(F.transform(dated, normalize_text), lambda x: x.rlike(DATE_TIME) & F.upper(x).rlike(PLATE)), F.lit(0))
    one = without_accents(normalize_text(F.regexp_replace(text, "\n", " ")))
    broken = bound(one, lambda x: extract(x, rf"(?i)(.{{0,80}}{DATE_TIME}.+?{PLATE}.*?)(?:\s+CONCESSIONARIA|\s+COMUNICACAO|\s+DADOS\s+DO|\z)"))
    return F.coalesce(direct, normalize_text(broken))


def line_parts(line: Column) -> Column:
    """struct(id, date, time, plate, prefix, suffix) of a passage line; null without a date-time and a plate after it."""
    pattern = r"^(.*?)\s*([0-9]{2}/[0-9]{2}/[0-9]{4})\s+([0-9]{2}:[0-9]{2}:[0-9]{2})\s+(.+)\z"

    def split(g: Column, at: Column) -> Column:
        rest = g[3]
        parts = F.struct(
            F.upper(normalize_text(g[0])).alias("id"), g[1].alias("date"), g[2].alias("time"), F.upper(F.substring(rest, at, F.lit(7))).alias("plate"),
            normalize_text(F.substring(rest, F.lit(1), at - 1)).alias("prefix"), normalize_text(F.substring(rest, at + 7, F.length(rest))).alias("suffix"),
        )
        return F.when(at > 0, parts)

    found = bound(line, lambda x: groups(x, pattern, 4))
    return bound(found, lambda g: bound(F.regexp_instr(F.upper(g[3]), F.lit(PLATE)), lambda at: split(g, at)))


def road_and_km(prefix: Column) -> Column:
    """struct(sp, km, rest): the road (SP... or digits) and kilometre that a prefix begins with."""
    t = F.filter(F.split(prefix, r"\s+"), lambda x: x != "")
    token = lambda k: F.coalesce(F.get(t, F.lit(k)), F.lit(""))
    named = F.upper(token(0)).startswith("SP")
    numbered = ~named & token(0).rlike(r"^[0-9]+\z")
    place = r"[0-9]+\+[0-9]+"
    split_km = numbered & (F.upper(token(1)) == "KM") & token(2).rlike(place)
    joined_km = (named | numbered) & ~split_km & token(1).rlike(place)
    km = F.when(split_km, F.concat(token(1), F.lit(" "), token(2))).when(joined_km, token(1)).otherwise("")
    used = F.when(split_km, 3).when(joined_km, 2).when(named | numbered, 1).otherwise(0)
    rest = F.array_join(F.slice(t, used + 1, F.greatest(F.size(t), F.lit(1))), " ")
    return F.struct(F.when(named | numbered, token(0)).otherwise("").alias("sp"), km.alias("km"), rest.alias("rest"))


def place_parts(prefix: Column) -> Column:
    """struct(plaza, lane, direction, city, code), upper case; if the order is another, plaza has all and code a last number."""
    # The pattern, as the others of this module
    pattern = rf"(?i)^(.+?)\s+([0-9]+)\s+({'|'.join(DIRECTIONS)})\s+(.+?)\s+([0-9]+)\z"
    names = ("plaza", "lane", "direction", "city", "code")

    def of(t: Column) -> Column:
        last = F.regexp_extract(t, r"(?:^|\s)([0-9]+)\s*\z", 1)
        rough = F.struct(t.alias("plaza"), F.lit("").alias("lane"), F.lit("").alias("direction"), F.lit("").alias("city"), last.alias("code"))
        full = lambda g: F.when(g.isNotNull(), F.struct(*(F.upper(normalize_text(g[k])).alias(n) for k, n in enumerate(names))))
        return F.coalesce(bound(groups(t, pattern, 5), full), rough)

    return bound(prefix, of)


def vehicle_parts(suffix: Column) -> Column:
    """struct(model, axles, fare, responsible): by the first of three orders that fits; else model has all. Fares have a decimal comma."""
    fare = r"([0-9]+(?:[.,][0-9]{2})?)"
    # The three orders
    patterns = (rf"(?i)^(.+?)\s+([0-9]+)\s+R\$\s*{fare}\s*(.*)\z", rf"(?i)^(.+?)\s+([0-9]+)\s+{fare}\s+R\$\s*(.+)\z", rf"(?i)^(.+?)\s+([0-9]+)\s+{fare}\s+R\$?()\z")

    def of(t: Column) -> Column:
        fitting = lambda g: F.when(g.isNotNull(), F.struct(normalize_text(g[0]).alias("model"), g[1].alias("axles"), F.replace(g[2], F.lit("."), F.lit(",")).alias("fare"), normalize_text(g[3]).alias("responsible")))
        none = F.struct(t.alias("model"), F.lit("").alias("axles"), F.lit("").alias("fare"), F.lit("").alias("responsible"))
        return F.coalesce(*(bound(groups(t, p, 4), fitting) for p in patterns), none)

    return bound(suffix, of)


def token_line(text: Column) -> Column:
    """The first line that begins with twenty or more capitals and digits."""
    return F.get(F.filter(F.transform(lines_of(text), trimmed), lambda x: x.rlike("^[A-Z0-9]{20,}")), F.lit(0))


def token_fields(line: Column) -> Column:
    """The fields of a line by their place among its words; null for a line of fewer than twelve words or none.

    The model is what lies between the plate and the last four words (axles, fare, currency, responsible).
    """
    names = ("id", "date", "time", "sp", None, None, "plaza", "lane", "direction", "city", "code", "plate")

    def of(t: Column) -> Column:
        n = F.size(t)
        at = lambda k: F.get(t, F.lit(k))
        end = lambda k: F.get(t, n - k)
        fields = [at(k).alias(x) for k, x in enumerate(names) if x]
        fields.insert(4, F.concat(at(4), F.lit(" "), at(5)).alias("km"))
        model = F.array_join(F.slice(t, F.lit(13), F.greatest(n - 16, F.lit(0))), " ")
        return F.when(n >= 12, F.struct(*fields, model.alias("model"), end(4).alias("axles"), end(3).alias("fare"), end(1).alias("responsible")))

    return bound(F.split(trimmed(line), r"\s+"), of)


def alerts(passage_id: Column, date: Column, time: Column, plate: Column) -> Column:
    """What is wrong with a passage: empty fields, a plate of another form, an impossible date or time; empty if nothing."""
    blank = lambda c: F.coalesce(trimmed(c) == "", F.lit(True))
    empties = [F.when(blank(c), F.lit(f"{n} vazio")) for c, n in ((passage_id, "id"), (date, "data"), (time, "hora"), (plate, "placa"))]
    bad_plate = ~F.coalesce(is_valid(F.upper(plate)), F.lit(False))
    day = date.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z") & F.try_to_date(date, "d/M/yyyy").isNotNull()
    clock = time.rlike(r"^([01]?[0-9]|2[0-3]):[0-5]?[0-9]:([0-5]?[0-9]|6[01])\z")
    return F.array_compact(F.array(*empties, F.when(bad_plate, "placa fora do padrao"), F.when(~F.coalesce(day, F.lit(False)), "data invalida"), F.when(~F.coalesce(clock, F.lit(False)), "hora invalida")))


def passage_status(found: Column) -> Column:
    return F.when(F.size(found) == 0, "OK").otherwise("Revisar - dados da passagem")


def file_id(name: Column) -> Column:
    """struct(id, ok) of a file's name: the letters and digits before its first hyphen; without, the whole stem, not ok."""
    base = F.regexp_extract(name, r"([^/]*)\z", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]+\z", "")
    ok = stem.rlike("^[A-Za-z0-9]+-")
    return F.struct(F.upper(F.when(ok, F.regexp_extract(stem, "^([A-Za-z0-9]+)-", 1)).otherwise(stem)).alias("id"), ok.alias("ok"))
