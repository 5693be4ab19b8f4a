"""The driver's entry points, with and without the optional parts."""

import subprocess
import sys

import __spark_entry__ as entry
from passaura.plans import catalog

from .conftest import SF


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE) and set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_record_queries_without_the_optional_part():
    """What the optional subpackage needs and cannot import does not take the record queries with it."""
    code = "import sys; sys.modules['passaura.llm'] = None; import __spark_entry__ as e; from passaura.plans import catalog; assert set(e.queries()) == set(catalog.QUERIES) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0], timeout=120)


def test_entry(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
