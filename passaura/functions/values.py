"""Cell values and column names of sheets."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Priorities of statuses in a report, best first; others come last.
PRIORITY = ("Aprovado - busca nas imagens", "Revisar", "Revisar - sem imagem", "ID não encontrado na planilha", "ID fora do padrão")


def strict_name(name: Column) -> Column:
    """Lower case, only a-z and 0-9; accented letters vanish."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "")


def strict_key(name: str) -> str:
    """strict_name of a Python string."""
    return re.sub("[^a-z0-9]+", "", name.strip().lower())


def loose_key(name: str) -> str:
    """A name in lower case without accents, runs of white space one space."""
    bare = unicodedata.normalize("NFKD", name.strip().lower())
    return re.sub(r"\s+", " ", "".join(c for c in bare if not unicodedata.combining(c)))


def resolve(columns: list[str], candidates: list[str], key=strict_key) -> str | None:
    """The column that the first candidate found names; of columns alike the last."""
    known = {key(c): c for c in columns}
    return next((known[key(x)] for x in candidates if key(x) in known), None)


def with_synonyms(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """df with each canonical column, from the first synonym present; missing ones are empty strings."""
    for name, candidates in synonyms.items():
        found = resolve(df.columns, candidates, loose_key)
        df = df.withColumn(name, F.col(f"`{found}`") if found else F.lit(""))
    return df


def image_columns(columns: list[str], contains: tuple[str, ...] = ("imagem", "foto"), prefix: str | None = None) -> list[str]:
    """The columns that hold images: by a part of the strict name, or by a prefix as written."""
    if prefix is not None:
        return [c for c in columns if c.strip().lower().startswith(prefix.lower())]
    return [c for c in columns if any(x in strict_key(c) for x in contains)]


def has_value(value: Column) -> Column:
    """Not null, blank, nan, none or null."""
    return F.coalesce(~F.lower(F.trim(value)).isin("", "nan", "none", "null"), F.lit(False))


def shown(value: Column) -> Column:
    """Null as the empty string; for sinks only."""
    return F.coalesce(value.cast("string"), F.lit(""))


def number(value: Column) -> Column:
    """A text as a double; null if it is none."""
    return F.trim(value).try_cast("double")


def decimal_comma(value: Column) -> Column:
    """A fare with a decimal comma or point as decimal(10,2); null if it is none."""
    return F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("decimal(10,2)")


def priority(status: Column) -> Column:
    """A status's place in PRIORITY from 0; 5 for others and null."""
    out = F.lit(5)
    for k, s in enumerate(PRIORITY):
        out = F.when(status == s, k).otherwise(out)
    return out


def drop_empty_rows(df: DataFrame, apart: tuple[str, ...] = ("sheet_row",)) -> DataFrame:
    """df without rows that are null in all columns but those of `apart`."""
    return df.na.drop("all", subset=[c for c in df.columns if c not in apart])
