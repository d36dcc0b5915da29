"""Every query of the library against its DuckDB SQL on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from quillstream import registry

SF = "/root/testdata/sf0.001"
#: Queries without SQL whose whole results tests/test_whole_results.py recomputes
IN_PYTHON = {
    "cdc_1_from_bytes", "cdc_1_page_text_hash", "er_5_fuzzy_titles", "html_5_title_on_old_page", "str_18_link_match",
    "er_7_renames", "evt_3_rename_events", "evt_9_verified_titles", "er_8_sorted_neighbours", "html_1_visible_text", "html_2_main_text", "html_3_links", "html_4_match_form", "str_10_sequence_ratio", "str_11_title_similarity",
    "str_17_title_on_page", "str_22_segments", "str_26_topic_codes", "str_32_signature", "str_34_visible_hash", "url_14_first_subpages", "url_7_absolute", "win_3_greedy_best_match",
}
#: and those that only run here; their functions have tests of their own
RUN_ONLY = {"str_23_compact_diff"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    rows = registry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(tuple(map(plain, r)) for r in rows.select(columns).collect())
    if (sql := registry.oracle_sql().get(name)) is None:
        assert name in IN_PYTHON | RUN_ONLY
        return
    found = duck.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({sql})")
    assert sorted(duck.sql(sql).columns) == columns
    assert got == sorted(tuple(map(plain, r)) for r in found.fetchall())


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
