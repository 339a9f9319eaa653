"""Physical plans, and registered queries against SQL."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
PLANNED = [
    "rule_must_have", "rule_verdict", "orphan_values", "coverage_profile_lineitem", "table_compare_details", "table_compare_text_export",
    "result_compare_different", "snapshot_changes", "json_rules", "json_flatten", "field_verdicts", "mask_columns", "scrub_documents",
    "query_log_scrubbed", "fingerprints", "timeline", "verified_links", "linked_counts", "identifier_search", "generated_rows", "duplicate_texts",
    "join_along_path", "latest_and_previous",
]
AGAINST_SQL = [
    "rule_must_have", "rule_null_keys_verdict", "filter_list", "filter_not_equal", "duplicates_summary", "coverage_profile", "edge_cases_part",
    "table_compare_details", "result_compare_different", "field_verdicts_expected", "json_flatten", "scrub_text", "fingerprints",
    "latest_and_previous", "timeline_filtered", "verified_links_b", "identifier_search",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def queries():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no sample data")
    return entry.queries()


@pytest.mark.parametrize("name", PLANNED)
def test_plans_stay_native_and_use_equi_joins(spark, queries, name):
    text = plan(queries[name](spark, SF_DIR))
    for word in ("Python", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert word not in text, text


def test_filters_and_columns_reach_the_scan(spark, queries):
    text = plan(queries["filter_equals"](spark, SF_DIR))
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    text = plan(queries["filter_one_of"](spark, SF_DIR))
    assert "In(o_custkey, [101,102,103])" in text
    text = plan(queries["identifier_search"](spark, SF_DIR))
    assert "In(o_orderkey, [42,77])" in text


def test_profile_is_one_pass(spark, queries):
    assert plan(queries["coverage_profile_lineitem"](spark, SF_DIR)).count("FileScan") == 1


def test_newest_runs_are_limited_before_the_shuffle(spark, queries):
    text = plan(queries["latest_and_previous"](spark, SF_DIR))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_entry(spark, queries):
    df = entry.entry(spark)
    assert df.count() > 0 and "o_orderkey" in df.columns


def test_every_query_is_callable_and_named_once(queries):
    oracles = entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


@pytest.mark.parametrize("name", AGAINST_SQL)
def test_against_sql(spark, queries, name):
    duckdb = pytest.importorskip("duckdb")
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from verify import plain

    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_DIR}/{f}')")
    df = queries[name](spark, SF_DIR)
    cols = sorted(df.columns)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_the_library_stands_without_the_training_data_operators():
    code = (
        "import sys; sys.modules['plumbline.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = e.queries()\n"
        "assert 'rule_must_have' in names and not [n for n in names if n.startswith('op') and '_' in n[:5]] and 'pipeline' not in names"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0


def test_catalog_queries_read_the_columns_they_name(spark, queries):
    text = plan(queries["column_search"](spark, SF_DIR))
    assert "embedding" not in text and "html" not in text and text.count("FileScan") <= 14


@pytest.mark.parametrize("name", ["table_compare_details", "table_compare_summary", "field_verdicts", "result_compare_different", "snapshot_changes", "record_diff"])
def test_first_rows_need_no_sorted_aggregate(spark, queries, name):
    assert "SortAggregate" not in plan(queries[name](spark, SF_DIR))


def test_history_is_not_windowed_by_check_alone(spark, queries):
    text = plan(queries["changes_between_runs"](spark, SF_DIR))
    assert "rangepartitioning(connection" in text and "hashpartitioning(_range" in text


WHOLE = ["linked_timeline_mixed", "table_compare_long_keys", "snapshot_decimal_scale", "json_flatten_deep", "json_rules_odd"]


@pytest.mark.parametrize("name", WHOLE)
def test_mixed_queries_over_whole_tables(spark, queries, name):
    for word in ("LessThan", "r_regionkey"):
        assert word not in plan(queries[name](spark, SF_DIR))
    test_against_sql(spark, queries, name)
