"""Where a provider's report goes, and writing it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import xlsx

#: The kinds of report, and the providers of each.
CATEGORIES = {"evasao": ("ecovias", "intervias", "eixosp"), "isencao": ("autoban", "tamoios"), "eixo": ("colinas", "spvias", "eixovp", "bandeiras")}
SHEETS = {"tamoios": ("Resultado Completo", "Melhor Resultado ID"), "eixosp": ("Processamento Completo",)}


def category_of(provider: str) -> str:
    return next(c for c, names in CATEGORIES.items() if provider in names)


def report_path(base: str, provider: str, name: str = "resultado") -> str:
    """base/category/name_provider.xlsx; folders are made when the report is written."""
    return f"{base.rstrip('/')}/{category_of(provider)}/{name}_{provider}.xlsx"


def write_report(provider: str, frames: list[DataFrame], path: str) -> bool:
    """One sheet for each frame, under the provider's sheet names; nothing is written for no rows."""
    titles = SHEETS.get(provider, ("Sheet1",))
    if len(frames) > len(titles):
        raise ValueError(f"{provider} has {len(titles)} sheets")
    return xlsx.write(dict(zip(titles, frames, strict=False)), path)
