import duckdb
import pytest

import __spark_entry__ as entry
from lintlake.plans.queries import ORACLES, QUERIES

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["rule_py003", "rule_rs001", "rule_perf002", "review_score", "dedup_line_category", "quality_gate", "sink_line_matches", "import_edges", "fp_suppressions", "pr_file_filter", "diff_hunk_ranges", "confusion_matrix", "event_sessions", "sarif_findings", "semgrep_findings", "golden_scores", "pull_reports", "stored_current", "apply_suppressions", "shaped_metrics", "rule_perf001", "graph_edges", "graph_siblings", "taint_candidates", "python_blocks", "asof_clicks", "shipped_in_ranges", "feedback_within",
        "rule_cl003", "taint_findings", "report_unread_fields", "report_fields", "graph_table_edges", "review_bonuses", "agent_prompts", "app_installations", "app_pulls"]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    a = sorted(str(tuple(_plain(r[c]) for c in cols)) for r in df.collect())
    b = sorted(str(tuple(_plain(r[want.columns.index(c)]) for c in cols)) for r in want.fetchall())
    assert a == b
