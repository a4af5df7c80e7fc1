"""A few registered queries against their SQL on the smallest tables, as the driver does for all."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
NAMES = [
    "n2_token_set", "n6_parse_timestamp", "n8_n9_phrases", "s6_chunks", "s8_skip_report", "s17_upsert", "l9_current_state", "t1_frequency", "t5_source_bound",
    "v1_top_k", "r12_assembly", "p1_policy", "e1_ndcg", "e3_tie_bands", "documents_by_lang_and_source", "f17_near_repeats", "s2_import", "s3_chats", "s23_rebuilt", "x2_ingest", "l12_declines", "e10_levers", "f13_requests", "p9_low_value", "v2_federated", "x1_delivery_frequency", "x3_windows",
    "m2_replay", "e9_arms", "f16_patterns", "f15_signals", "t6_nightly", "x4_buffers", "m9_design", "r7_states", "s12_ingest",
]


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple("%.9g" % r[k] if isinstance(r[k], float) else str(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = __spark_entry__.queries()[name](spark, SF)
    want = db.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
