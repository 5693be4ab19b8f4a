"""The plate functions and the page splitter as functions of Spark SQL, for queries written as text.

register(spark) makes them known to a session: plate_clean, plate_is_valid, plate_mask, plate_fit, plate_normalize, plate_distance,
plate_matches, and the table function blocks_after. They are expressions that Catalyst puts in the place of the call, and give what the columns of `plate` and
`text` give: null for null, but for plate_distance (999) and plate_matches (0); a null mask is none.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import plate as P

_LETTER, _DIGIT = (f"'{a}', '{b}'" for a, b in (P.TO_LETTER, P.TO_DIGIT))
_NOTHING = P.UNREAD.upper().replace(" ", "")


def _fit(part: str, table: str) -> str:
    return f"translate(substring(t, {part}), {table})"


def _own(text: str) -> str:
    """A text's letters, written out."""
    return f"filter(split({text}, ''), c -> c <> '')"


def _kinds(text: str) -> str:
    """A text with each character as its kind: see `plate.distance`."""
    return f"translate({text}, {', '.join(map(repr, P.KINDS))})"


def _cost(y: str) -> str:
    """What it costs, in hundredths, to exchange x for y."""
    return f"CASE WHEN x = {y} THEN 0 WHEN instr('{P.BOTH_WAYS}', concat(x, {y})) > 0 THEN 35 ELSE 100 END"


#: (name and parameters, what it returns, its body), each made of those before it.
FUNCTIONS = (
    ("plate_bare(t STRING)", "STRING", "regexp_replace(upper(t), '[^A-Z0-9]', '')"),
    ("plate_reorder(t STRING)", "STRING", r"CASE WHEN t RLIKE r'^([0-9]{4}|[0-9][A-Z][0-9]{2})[A-Z]{3}\z' THEN concat(substring(t, 5, 3), substring(t, 1, 4)) ELSE t END"),
    ("plate_clean(t STRING)", "STRING", "plate_reorder(plate_bare(t))"),
    ("plate_is_valid(t STRING)", "BOOLEAN", f"t RLIKE r'{P.VALID}'"),
    ("plate_mask(t STRING)", "STRING", f"CASE WHEN length(plate_bare(t)) = 7 THEN CASE WHEN substring(plate_bare(t), 5, 1) RLIKE '[A-Z]' THEN '{P.NEW}' ELSE '{P.OLD}' END END"),
    ("plate_fit(t STRING, m STRING)", "STRING", f"concat({_fit('1, 3', _LETTER)}, {_fit('4, 1', _DIGIT)}, CASE WHEN m = '{P.NEW}' THEN {_fit('5, 1', _LETTER)} ELSE {_fit('5, 1', _DIGIT)} END, {_fit('6, 2', _DIGIT)})"),
    ("plate_windows(t STRING)", "ARRAY<STRING>", "CASE WHEN plate_is_valid(t) OR length(t) < 7 THEN array() ELSE transform(sequence(length(t) - 6, 1), s -> substring(t, s, 7)) END"),
    ("plate_first(w ARRAY<STRING>)", "STRING", "get(filter(w, x -> x IS NOT NULL), 0)"),
    ("plate_of(t STRING, found STRING)", "STRING", "CASE WHEN plate_is_valid(t) OR t = '' THEN t WHEN length(t) >= 7 THEN coalesce(found, substring(t, 1, 7)) ELSE t END"),
    ("plate_distance_of(a STRING, b STRING)", "DOUBLE", f"""CASE WHEN a = '' OR b = '' THEN {P.UNREAD_COST}D WHEN a = b THEN 0D
        WHEN startswith(a, b) OR endswith(a, b) OR startswith(b, a) OR endswith(b, a) THEN CAST(abs(length(a) - length(b)) AS DOUBLE)
        ELSE coalesce(CASE WHEN levenshtein(a, b) = levenshtein({_kinds("a")}, {_kinds("b")}) THEN 100 * levenshtein(a, b) END,
        CASE WHEN length(a) = length(b) THEN get(filter(array(aggregate(zip_with({_own("a")}, {_own("b")}, (x, y) -> {_cost("y")}), 0, (n, x) -> n + x)), n -> n <= 200), 0) END,
        get(transform(array({_own("b")}), b -> aggregate({_own("a")}, transform(sequence(0, size(b)), j -> 100 * j), (above, x) -> aggregate(sequence(1, size(b)), array(get(above, 0) + 100),
        (row, j) -> array_append(row, least(get(above, j) + 100, get(row, j - 1) + 100, get(above, j - 1) + {_cost("get(b, j - 1)")}))), last -> get(last, size(b)))), 0)) / 100D END"""),
    ("plate_distance(expected STRING, read STRING)", "DOUBLE", "plate_distance_of(coalesce(plate_clean(expected), ''), coalesce(plate_clean(read), ''))"),
    ("plate_shared(a ARRAY<STRING>, b ARRAY<STRING>)", "INT", "aggregate(array_distinct(a), 0, (n, x) -> n + least(size(filter(a, y -> y = x)), size(filter(b, y -> y = x))))"),
    ("plate_matches_of(a STRING, b STRING)", "INT", f"CASE WHEN b = '{_NOTHING}' THEN 0 WHEN contains(a, b) THEN length(b) WHEN contains(b, a) THEN length(a) ELSE plate_shared({_own('a')}, {_own('b')}) END"),
    ("plate_matches(expected STRING, read STRING)", "INT", "plate_matches_of(coalesce(plate_clean(expected), ''), coalesce(plate_clean(read), ''))"),
    ("blocks_after(t STRING, marker STRING)", "TABLE (k INT, block STRING)", r"SELECT pos, col FROM posexplode(slice(split(t, concat(r'\Q', marker, r'\E')), 2, 1073741824))"),
)
#: plate_normalize tries the old form before the new one where there is no mask.
_NORMALIZE = "plate_of(plate_clean(t), plate_first(transform(plate_windows(plate_clean(t)), w -> {0})))"


def _window(mask: str) -> str:
    """A window w as a mask makes it, if that is valid: written out, as a function cannot be called inside a lambda."""
    own = lambda part, table: f"translate(substring(w, {part}), {table})"
    fitted = f"concat({own('1, 3', _LETTER)}, {own('4, 1', _DIGIT)}, CASE WHEN {mask} = '{P.NEW}' THEN {own('5, 1', _LETTER)} ELSE {own('5, 1', _DIGIT)} END, {own('6, 2', _DIGIT)})"
    return f"CASE WHEN {fitted} RLIKE r'{P.VALID}' THEN {fitted} END"


def statements() -> list[str]:
    """The statements that make the functions."""
    either = f"coalesce({_window(f"coalesce(m, '{P.OLD}')")}, CASE WHEN m IS NULL THEN {_window(repr(P.NEW))} END)"
    own = (*FUNCTIONS, ("plate_normalize(t STRING, m STRING)", "STRING", _NORMALIZE.format(either)))
    return [f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}" for name, kind, body in own]


def register(spark: SparkSession) -> SparkSession:
    for statement in statements():
        spark.sql(statement)
    return spark
