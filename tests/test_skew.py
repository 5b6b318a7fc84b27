"""The same queries where one scan, project, user and build hold a third of all rows."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import rows_of
from scanlake.plans import bindings

TABLES = {
    "orders": "select * replace (case when o_orderkey % 3 = 0 then 7 else o_custkey end as o_custkey) from t",
    "lineitem": "select * replace (case when l_partkey % 3 = 0 then 5 else l_orderkey end as l_orderkey, case when l_partkey % 3 = 1 then 3 else l_suppkey end as l_suppkey) from t",
    "events": "select * replace (case when event_id % 3 = 0 then 4 else user_id end as user_id) from t",
    "documents": "select * replace (case when doc_id % 3 = 0 then 'src1' else source end as source) from t",
    "conversations": "select * replace (case when conv_id % 3 = 0 then 0 else conv_id end as conv_id, conv_id * 100 + turn as turn) from t",
}
NAMES = (
    "severity_gate_from_reports", "findings_union", "leading_quality_issues", "severity_totals_unified", "totals_by_type", "totals_by_tool",
    "scan_summary", "resolve_scan_dir", "trace_findings", "suppress_findings", "top_findings", "top_issues", "read_sbom", "sbom_totals",
    "gosum_components", "phase_timeline", "phase_changes", "stream_phase_changes", "stream_stale_agents", "register_build", "recent_builds",
    "rollup_result", "detect_adapters", "discover_modules", "test_dirs", "remove_root_duplicates", "leading_hardcoded_ips", "lines_of_code",
    "directory_tree", "write_comprehensive", "read_artifacts",
)


@pytest.fixture(scope="module")
def skewed(sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        change = TABLES.get(name, "select * from t").replace(" from t", f" from '{sf}/{name}.parquet'")
        con.execute(f"copy ({change}) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_change_nothing(spark, skewed, name):
    folder, con = skewed
    df = entry_points.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = con.execute(entry_points.oracle_sql()[name])
    assert got == rows_of([column[0] for column in result.description], result.fetchall())


def test_no_report_file_grows_with_its_scan(spark, skewed, monkeypatch):
    """With a smaller key range the hot scan gets more files, not longer ones."""
    folder, _ = skewed
    monkeypatch.setattr(bindings._pack, "__defaults__", (50,))
    sizes = bindings.vuln_reports(spark, folder).selectExpr("scan_id", "regexp_count(content, '\"Severity\"') as n")
    hot = [r.n for r in sizes.where("scan_id = 'scan-7'").collect()]
    assert len(hot) > 20 and max(hot) <= 50
