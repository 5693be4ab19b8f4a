"""Pieces of DuckDB SQL that say what the plate functions compute."""

from __future__ import annotations

import re

from ..functions.plate import _CONFUSED, TO_DIGIT, TO_LETTER, UNREAD
from . import fixtures as X


def filled(sql: str) -> str:
    """SQL with each {NAME} replaced by the fixture of that name."""
    return re.sub(r"\{([A-Z_]{4,})\}", lambda m: "(" + X.on_duckdb(getattr(X, m[1])) + ")", sql)


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def reorder(t: str) -> str:
    return f"case when regexp_full_match({t}, '([0-9]{{4}}|[0-9][A-Z][0-9]{{2}})[A-Z]{{3}}') then substr({t}, 5, 3) || substr({t}, 1, 4) else {t} end"


def clean(x: str) -> str:
    return let(f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')", "t", reorder("t"))


def valid(x: str) -> str:
    return f"regexp_full_match({x}, '[A-Z]{{3}}[0-9][A-Z0-9][0-9]{{2}}')"


def mask(x: str) -> str:
    return let(f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')", "m", "case when length(m) = 7 then case when substr(m, 5, 1) between 'A' and 'Z' then 'LLLDLDD' else 'LLLDDDD' end end")


def fit(w: str, m: str) -> str:
    letter = lambda p, n: f"translate(substr({w}, {p}, {n}), '{TO_LETTER[0]}', '{TO_LETTER[1]}')"
    digit = lambda p, n: f"translate(substr({w}, {p}, {n}), '{TO_DIGIT[0]}', '{TO_DIGIT[1]}')"
    return f"({letter(1, 3)} || {digit(4, 1)} || case when {m} = 'LLLDLDD' then {letter(5, 1)} else {digit(5, 1)} end || {digit(6, 2)})"


def normalize(x: str, m: str | None = None) -> str:
    made = lambda n: let(fit("w", n), "p", f"case when {valid('p')} then p end")
    either = f"coalesce({made(repr('LLLDDDD'))}, {made(repr('LLLDLDD'))})"
    best = f"case when k is null then {either} else {made('k')} end" if m else either
    found = f"list_filter(list_transform(range(length(t) - 6, 0, -1), lambda s: {let('substr(t, s, 7)', 'w', best)}), lambda f: f is not null)[1]"
    body = f"case when t = '' or {valid('t')} then t when length(t) >= 7 then coalesce({found}, substr(t, 1, 7)) else t end"
    return let(clean(x), "t", let(m, "k", body) if m else body)


def _table(a: str, b: str, first: int, cell: str) -> str:
    """The last cell of a table over the letters of a and b, as nested reductions over lists of whole numbers."""
    x, y = f"list_transform(string_split({a}, ''), lambda c: [ascii(c)])", f"list_transform(string_split({b}, ''), lambda c: ascii(c))"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda cur, j: list_append(cur, {cell}), [above[1] + {first}])"
    return let(y, "y", f"list_reduce({x}, lambda above, c: {row}, list_transform(range(0, length({b}) + 1), lambda j: j * {first}))[length({b}) + 1]")


def distance(a: str, b: str) -> str:
    cost = f"case when c[1] = y[j[1]] then 0 when strpos('{_CONFUSED}', chr(c[1]) || chr(y[j[1]])) > 0 then 35 else 100 end"
    cell = f"least(above[j[1] + 1] + 100, cur[j[1]] + 100, above[j[1]] + {cost})"
    body = f"case when a = '' or b = '' then 999.0::double when a = b then 0.0::double else ({_table('a', 'b', 100, cell)}) / 100.0::double end"
    return let(f"coalesce({clean(a)}, '')", "a", let(f"coalesce({clean(b)}, '')", "b", body))


def subsequence(a: str, b: str) -> str:
    cell = "case when c[1] = y[j[1]] then above[j[1]] + 1 else greatest(above[j[1] + 1], cur[j[1]]) end"
    return f"cast({let(a, 'a', let(b, 'b', _table('a', 'b', 0, cell)))} as int)"


def matches(a: str, b: str) -> str:
    times = lambda t: f"(length({t}) - length(replace({t}, x, '')))"
    total = f"list_sum(list_transform(list_distinct(string_split(a, '')), lambda x: least({times('a')}, {times('b')})))"
    body = f"case when a = '' or b = '' or b = '{UNREAD.upper().replace(' ', '')}' then 0 else {total} end"
    return f"cast({let(f'coalesce({clean(a)}, {chr(39) * 2})', 'a', let(f'coalesce({clean(b)}, {chr(39) * 2})', 'b', body))} as int)"


def same_places(a: str, b: str) -> str:
    return f"cast(len(list_filter(range(1, least(length({a}), length(coalesce({b}, ''))) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1))) as int)"


def _compared() -> str:
    return f"""e as (select passage_id, {mask('expected_plate')} as mask, {normalize('expected_plate', mask('expected_plate'))} as plate from {{PASSAGES}}),
c as (select r.passage_id, image_ix, plate, ocr_text as raw, {normalize('ocr_text', 'mask')} as read from {{READS}} r join e on r.passage_id = e.passage_id),
d as (select *, {distance('plate', 'read')} as difference, {matches('plate', 'read')} as matches from c)"""


def _evaluated(stop: str, counts: str, order: str, ok: str, own: str, raw: str, more: str = "") -> str:
    shown = f"coalesce(case when b.n is null then null when {ok} and {own} then e.plate else nullif(w.read, '') end, '{UNREAD}')"
    return f"""with {_compared()},
l as (select *, coalesce(bool_or({stop}) over (partition by passage_id order by image_ix rows between unbounded preceding and 1 preceding), false) as late from d),
w as (select * from l where not late and raw is not null and {counts} qualify row_number() over (partition by passage_id order by {order}) = 1),
b as (select passage_id, count(*) as n, count(*) filter (where not late and raw is not null) as m from l group by passage_id)
select e.passage_id, {shown} as plate_result, coalesce(w.{raw}, '') as ocr_raw, case when b.n is null then 'Revisar - sem imagem' when coalesce({ok}, false) then 'Aprovado - busca nas imagens' else 'Revisar' end as status,
coalesce(w.difference, 999.0) as difference, w.image_ix as image_used, cast(coalesce(b.n, 0) as int) as total_images, cast(coalesce(b.m, 0) as int) as images_with_ocr{more}
from e left join b on e.passage_id = b.passage_id left join w on e.passage_id = w.passage_id"""


def by_distance(show: str, raw: str) -> str:
    return _evaluated("difference = 0", "difference < 999", "difference, image_ix", "w.difference <= 3", "true" if show == "expected" else "false", raw)


def by_matches() -> str:
    return _evaluated("matches >= 4", "(matches > 0 or difference < 999)", "matches desc, difference, image_ix", "w.matches >= 4", "true", "raw", ", coalesce(w.matches, 0) as matches")


def election() -> str:
    score = f"confidence + case when {valid('t')} then 5.0 else 0.0 end - 2.0 * abs(length(t) - 7)"
    return f"""with c as (select passage_id, box_ix, variant_ix, cand_ix, confidence, {normalize('text', 'mask')} as t from {{CANDIDATES}}),
s as (select *, {score} as score, {valid('t')} and confidence >= 0.97 as good from c where t <> '')
select passage_id, coalesce((list(t order by box_ix, variant_ix, cand_ix) filter (where good))[1], (list(t order by score desc, box_ix, variant_ix, cand_ix) filter (where score > -1))[1]) as ocr_text from s group by passage_id"""
