"""Registered queries against DuckDB at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from medgrain.queries import REGISTRY

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
FAST = [n for n in REGISTRY if n.startswith(("flt_", "join_", "set_", "srt_", "dq_", "str_", "src_", "ml_"))] + [
    "agg_primary_action", "agg_window_harms", "agg_ordinal_agreement", "agg_set_union", "agg_top_row_summary",
    "agg_review_report", "win_collapse_intervals", "win_asof_summary", "win_review_queue", "win_interleave",
    "win_subject_split", "fn_rule_score", "fn_review_time", "fn_dictionary_class", "fn_row_id", "job_state", "job_mapping_far",
    "job_pipeline_counts",
]
NAMES = list(REGISTRY) if os.environ.get("ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    query = REGISTRY[name]
    df = query.run(spark, SF)
    rows = sorted((tuple(r) for r in df.collect()), key=_key)
    sql = query.oracle()
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    assert [d[0] for d in cursor.description] == df.columns
    assert rows == sorted(cursor.fetchall(), key=_key)
