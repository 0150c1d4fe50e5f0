"""The driver's contract."""

import re

import __spark_entry__ as entry


def test_entry_runs(spark, data):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(sql) > 90
    for n in (3, 4, 7):
        assert f"p{n}_found" in q


def test_some_queries_equal_their_sql(spark, data):
    import compare

    con = compare.duck(data)
    for name in ("latest_version", "concept_coverage", "scorecard", "tree_diff", "lease_order", "p3_found", "p4_found", "p7_found", "bm25_scripts", "six_lane_search", "hydrated_results", "ground_residual", "concept_discovery", "lifecycle_rebind", "rescan_plan", "summary_hints"):
        said = compare.compare(spark, con, data, name)
        assert said.startswith("ok"), said


def test_core_does_not_know_the_optional_part():
    from pathlib import Path

    root = Path(entry.__file__).parent / "knotwork"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"knotwork\.llm", p.read_text()), p
