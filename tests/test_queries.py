"""Every query that SQL can tell, against DuckDB; the others run and have rows."""

import importlib

import pytest

from . import compare
from .conftest import DATA

entry = importlib.import_module("__spark_entry__")
SF = f"{DATA}/sf0.001"
ORACLE = entry.oracle_sql()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    return compare.connection(SF)


@pytest.mark.parametrize("name", [n for n in OWN if n in ORACLE])
def test_against_sql(spark, duck, name):
    assert compare.difference(entry.queries()[name](spark, SF), duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", [n for n in OWN if n not in ORACLE])
def test_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
