"""The command line: `python -m passaura PROVIDER PATH`, or a menu if no provider is named.

Reads a provider's documents, evaluates their passages, writes the report and prints its summary. With --page an
HTML page for inspection is written too.
"""

from __future__ import annotations

import argparse
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import html_report, report, vision
from .plans import output, providers
from .sources import backends, late
from .sources.scratch import scratch_path


def chosen(ask: Callable[[str], str] = input, tell: Callable[[str], None] = print) -> tuple[str, str, dict] | None:
    """(provider, path, options) from a menu; None to leave it. Asks again until the number is one of the list."""
    names = list(providers.PROVIDERS)
    while True:
        for k, name in enumerate(names, 1):
            tell(f"{k}. {name} ({output.category_of(name)})")
        tell("0. quit")
        number = ask("provider: ").strip()
        if number == "0":
            return None
        if number.isdigit() and int(number) <= len(names):
            name = names[int(number) - 1]
            path = ask("file or folder: ").strip()
            return name, path, {"sheet": ask("reference sheet: ").strip()} if name == "tamoios" else {}
        tell(f"no such provider: {number}")


def run(spark: SparkSession, name: str, path: str, out: str, read: Callable[[DataFrame], DataFrame], page: str | None = None, **options) -> list[str]:
    """Write the report of a provider's documents under the folder out; the lines of its summary, the report's path first.

    The evaluation is written to a scratch table, so that images are read once for all that is made of it.
    """
    provider = providers.PROVIDERS[name]
    scratch = scratch_path(spark, "evaluated")
    providers.evaluated(provider, *provider.read(spark, path, **options), read).write.parquet(scratch)
    rows = spark.read.parquet(scratch)
    target = output.report_path(out, name)
    frames = [report.labelled(rows, provider.labels)]
    if name == "tamoios":
        frames.append(providers.best_of_folder(rows))
    wrote = output.write_report(name, frames, target)
    if page:
        shown = rows.select("expected_plate", "ocr_raw", "status", html_report.match_class(F.col("expected_plate"), F.col("plate_result")).alias("match"))
        html_report.write(html_report.page(shown, name), page)
    return [target if wrote else "nothing to report", *report.summary_text(report.status_summary(rows))]


def main(arguments: list[str] | None = None) -> None:
    known = argparse.ArgumentParser(prog="passaura", description=__doc__)
    known.add_argument("provider", nargs="?", choices=list(providers.PROVIDERS))
    known.add_argument("path", nargs="?", help="a file or a folder")
    known.add_argument("--out", default="results", help="the folder of the reports")
    known.add_argument("--sheet", help="the reference sheet of an image folder")
    known.add_argument("--weights", default="best.pt", help="the detector's weights")
    known.add_argument("--variants", default="three", choices=list(backends.VARIANTS))
    known.add_argument("--cpu", action="store_true", help="no GPU")
    known.add_argument("--stop", action="store_true", help="leave a passage's further images unread after one that is good enough")
    known.add_argument("--page", help="an HTML page for inspection")
    given = known.parse_args(arguments)
    job = (given.provider, given.path, {"sheet": given.sheet} if given.sheet else {}) if given.provider else chosen()
    if not job:
        return
    if not job[1]:
        known.error("a file or folder is needed")
    detector = functools.partial(backends.YoloDetector, given.weights, device="cpu" if given.cpu else None)
    reader = functools.partial(backends.EasyOcrReader, given.variants, gpu=not given.cpu)
    spark = SparkSession.builder.getOrCreate()
    stop = "matches" if providers.PROVIDERS[job[0]].by_matches else "distance"

    def read(images: DataFrame) -> DataFrame:
        fetch = None if "content" in images.columns else late.Fetch()
        return vision.read_until(images, detector, reader, stop, fetch=fetch) if given.stop else vision.readings(images, detector, reader, fetch=fetch)

    for line in run(spark, job[0], job[1], given.out, read, given.page, late=True, **job[2]):
        print(line)


if __name__ == "__main__":
    main()
