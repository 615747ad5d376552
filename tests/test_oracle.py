"""Every registered query against its SQL, on the smallest data."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from courtline import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
ENTRIES = catalog.entries()
#: Queries whose right answer on the smallest data is no rows (seasons, samples or folds are too
#: small there): these run on the next size.
LARGER = frozenset((
    "player_exposure", "plus_minus_ratings", "rating_extremes", "lambda_scores", "best_lambda", "rating_residuals",
    "held_out_errors", "exact_drift_p_values", "walk_forward_predictions",
))
LARGER_DIR = os.environ.get("ORACLE_LARGER_DIR", "/root/testdata/sf0.01")


def folder(name):
    return LARGER_DIR if name in LARGER else SF_DIR


@pytest.fixture(scope="module")
def ducks():
    return {d: oracle.connect(d) for d in (SF_DIR, LARGER_DIR)}


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_equals_sql(spark, ducks, name):
    e = ENTRIES[name]
    assert oracle.compare(spark, ducks[folder(name)], name, e.run, e.sql, folder(name)) is None
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql])
def test_runs(spark, name):
    df = ENTRIES[name].run(spark, folder(name))
    assert df.columns and df.count() > 0
    spark.catalog.clearCache()


def test_entry_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
