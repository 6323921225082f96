"""Queries on the smallest tables against their SQL, and the entry's guard."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from keylattice import plans

SF = Path("/root/testdata/sf0.001")
LIGHT = ["token_census", "census_bands", "radar_islands", "symbol_index", "lookup_symbol", "diff_units", "token_drift", "pairwise_prf", "mojofm", "latency_percentiles", "task_fingerprint", "body_pattern_tokens", "telemetry_rollup", "schema_validate", "incremental_partition", "language_units", "import_edges_js", "import_edges_python", "packages", "python_units", "js_routes", "longest_prefix_import", "strip_noise", "suspended_tokens", "resurrected_edges", "pool_stats", "odd_groups", "forecast_heuristic", "seam_bundles", "cluster_graph", "twin_context", "guided_context", "classify_prompt", "incremental_scan", "keylock_capped_edges", "probe_counts", "risk_report", "adoption_rollup", "telemetry_histograms"]
EMPTY: set[str] = set()


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(plans.ORACLE[name]).df()
    got = plans.QUERIES[name](spark, str(SF)).toPandas()[list(want.columns)]
    key = lambda d: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in d.values.tolist())
    assert key(got) == key(want)
    assert len(got) or name in EMPTY


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(plans.QUERIES) <= set(q)


def test_library_does_not_import_the_text_subpackage():
    root = Path(plans.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "keylattice.llm" not in p.read_text(), p


def test_entry_without_the_text_subpackage(tmp_path):
    import shutil

    here = Path(plans.__file__).parents[2]
    shutil.copytree(here / "keylattice", tmp_path / "keylattice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
