"""Plan-level guards: no Python evaluation on the data path, and filters on stored tables
reach the Parquet scan."""

import os
import re

import pytest

import __spark_entry__ as entry
from riskloom import rules
from riskloom.operators import changes as C
from riskloom.plans import catalog
from riskloom.sources import change_log
from tests.conftest import SF_SMALL

PYTHON_NODES = re.compile(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonUDF")


@pytest.mark.parametrize("name", ["monitor_run", "alert_since", "indicator_match", "risk_reason", "change_log_history"])
def test_no_python_nodes(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    assert not PYTHON_NODES.search(df._jdf.queryExecution().executedPlan().toString())


def test_filters_reach_the_scan_of_a_stored_log(spark, tmp_out):
    path = os.path.join(tmp_out, "log")
    change_log.write_changes(catalog.change_log(spark, SF_SMALL), path, "r1")
    stored = change_log.read_change_log(spark, path)
    one = C.vendor_change_history(stored, "Supplier#000000003")
    scan = [l for l in one._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in l]
    assert scan and all("vendor" in l and "Supplier#000000003" in l for l in scan)
    since = C.risk_changes_since(stored, rules.RUN_START)
    scan = [l for l in since._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in l]
    assert scan and "field" in scan[0] and "changed_at" in scan[0]


def _scans(df):
    return [l for l in df._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in l]


def test_a_since_query_reads_only_its_dates(spark, tmp_out):
    path = os.path.join(tmp_out, "log")
    change_log.write_changes(catalog.change_log(spark, SF_SMALL), path, "r1")
    since = C.risk_changes_since(change_log.read_change_log(spark, path, since=rules.RUN_START), rules.RUN_START)
    scan = _scans(since)
    assert scan and all("PartitionFilters" in l and "changed_date" in l.split("PartitionFilters")[1].split("PushedFilters")[0] for l in scan)
    dates = {os.path.dirname(f).split("changed_date=")[1].split("/")[0] for f in since.inputFiles()}
    assert since.count() > 0 and len(dates) >= 1


def test_no_aggregate_carries_a_note_text(spark):
    for df in (catalog.q_latest_note(spark, SF_SMALL), catalog.q_change_payload(spark, SF_SMALL), catalog.q_note_sink_rows(spark, SF_SMALL)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [l for l in plan.split("\n") if "Aggregate" in l and "text#" in l]
