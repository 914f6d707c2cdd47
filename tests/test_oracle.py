"""Every query with a SQL twin returns exactly the DuckDB rows (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from eddy.plans.catalog import ORACLE, QUERIES  # noqa: E402
from oracle_check import compare  # noqa: E402

from data_paths import SF_MID, SF_SMALL  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)
    status, detail = res[name]
    assert status == "match", detail


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_contract(spark):
    import importlib.util
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("entry_mod", os.path.join(root, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())


def test_merge_queries_merge(spark):
    """The inputs of the merge queries overlap, so that their rows exercise the rules."""
    rows = {n: QUERIES[n](spark, SF_MID).cache() for n in ("overlap_pairs", "overlap_merge", "near_components", "macro_merge", "cf_by_tick")}
    pairs = [(r.tick, r.mc_id, r.parent_id) for r in rows["overlap_pairs"].collect()]
    assert len({(t, m) for t, m, _ in pairs}) > 20
    members = [r.ids.count(",") + 1 for r in rows["overlap_merge"].collect()]
    models = sum(members)
    assert len(members) < models and max(members) > 2
    assert rows["near_components"].count() > 40 and rows["macro_merge"].count() < models - 20
