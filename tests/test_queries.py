"""Every registered query against its SQL twin, and properties of the plans."""

import os
import re

import pytest
from oracle import connect, difference

import __spark_entry__ as entry
from leadspark.plans import load_all

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# queries of the optional modules are tested beside them
NAMES = sorted(load_all()[0])


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(con, df, sql) is None


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(NAMES) <= set(entry.oracle_sql())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "conversion_by_decile", "target_email_phone", "target_variants", "attribution_temporal", "conversions_dedup", "buyers_tracked",
    "campaign_metrics", "utm_economics_1d_3d_7d", "utm_economics_ad", "adset_comparison", "fair_controls", "fuzzy_residue", "leakage",
])
def test_no_products_of_tables(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    # nested loops only against one-row scalars
    for line in re.findall(r".*BroadcastNestedLoopJoin.*", text):
        assert "Cross" in line, line
    assert text.count("BroadcastNestedLoopJoin") <= 4


def test_scans_are_pruned(spark):
    text = plan(entry.queries()["target_email_only"](spark, SF))
    events = [line for line in re.findall(r"FileScan parquet.*?ReadSchema: \S+", text) if "events.parquet" in line]
    assert events and all("value" not in e.split("ReadSchema")[1] and "props" not in e for e in events)
    assert "PushedFilters" in text
