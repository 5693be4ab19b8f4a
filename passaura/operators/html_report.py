"""A self-contained HTML page that shows what was detected and read, for inspection."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STYLE = "body{font:14px sans-serif}td,th{padding:3px 8px;border:1px solid #ccc}.ok{background:#dfd}.partial{background:#ffd}.fail{background:#fdd}.best{font-weight:bold}img{max-height:120px}"


def match_class(expected: Column, read: Column) -> Column:
    """ok if a reading is the expected plate, partial if it is another, fail if there is none."""
    some = F.coalesce(F.trim(read) != "", F.lit(False))
    return F.when(~some, "fail").when(F.coalesce(read == expected, F.lit(False)), "ok").otherwise("partial")


def _cell(value) -> str:
    if isinstance(value, bytes | bytearray):
        return f'<img src="data:image/png;base64,{base64.b64encode(value).decode()}">'
    return escape("" if value is None else str(value))


def page(rows: DataFrame, title: str, most: int = 500) -> Iterator[str]:
    """The page in parts: a table of rows, at most `most` of them (this is a report to look at), binary columns as pictures.

    A column `match` gives the row's class, a true column `best` marks it.
    """
    names = rows.columns
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1><table><tr>"
    yield "".join(f"<th>{escape(n)}</th>" for n in names) + "</tr>"
    for r in rows.limit(most).toLocalIterator():
        own = f"{r['match'] if 'match' in names else ''} {'best' if 'best' in names and r['best'] else ''}".strip()
        yield f'<tr class="{escape(own)}">' + "".join(f"<td>{_cell(r[n])}</td>" for n in names) + "</tr>"
    yield "</table></body></html>"


def write(parts: Iterable[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(parts)
