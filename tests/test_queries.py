"""Every query with SQL agrees with it; the others run; plans stay as intended."""

import importlib
import importlib.util
import sys

import pytest

import __spark_entry__ as entry
from compare import differences
from gaitloom import oracles, queries

SQL = oracles.statements()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, tiny, name):
    query = queries.queries()[name]
    if name in SQL:
        assert differences(spark, tiny, query, SQL[name]) == ""
    else:
        assert query(spark, tiny).count() > 0


def test_entry(spark, tiny):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bm25_search", "facets_self_excluding", "confidence_levels", "entries_page", "assignment_report", "subtree_counts"])
def test_relational_queries_stay_in_the_jvm(spark, tiny, name):
    plan = queries.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned(spark, tiny):
    plan = queries.scan_filter_assets(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "loaded_at" not in plan
    text = queries.dataset_summary(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "captured_at" not in text


def test_a_missing_dependency_is_no_missing_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("gaitloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    if importlib.util.find_spec("gaitloom.llm") is None:
        pytest.skip("the package isn't there")
    monkeypatch.setitem(sys.modules, "xxhash", None)
    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        importlib.reload(entry)
    monkeypatch.undo()
    importlib.reload(entry)


def test_the_rest_works_without_the_training_data_package(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("gaitloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import gaitloom

    monkeypatch.delattr(gaitloom, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "gaitloom.llm", None)
    again = importlib.reload(entry)
    assert not any(n.startswith("p1_") for n in again.queries()) and "bm25_search" in again.queries()
    monkeypatch.undo()
    importlib.reload(entry)
