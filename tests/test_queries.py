import pytest

import __spark_entry__ as entry
from checks.compare import check, duck
from checks.queries import REGISTERED

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_counterpart():
    assert set(REGISTERED) <= set(entry.queries())
    assert set(REGISTERED) <= set(entry.oracle_sql())


@pytest.mark.parametrize(
    "name", ["evolving_batches", "heal_coerced_values", "drift_catalog_reports", "quarantine_stats_sets", "registry_flags",
             "reserved_names", "late_typed_column", "run_retry"]
)
def test_both_engines_agree(spark, con, name):
    good, note = check(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert good, note


def test_entry(spark):
    assert entry.entry(spark).count() == 10
