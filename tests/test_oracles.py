"""A part of the queries against their SQL equivalents on the smallest given tables; the driver compares all of them."""

import datetime
import os

import pytest

from cadenza.plans import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["a1_facets", "a2_coverage", "a6_album_rollup", "a24_weighted_rates", "a34_segments", "a42_observed_counters", "a42_stage_counters", "f1_catalog_filter", "f1_index_blocks", "f1_indexed_filter", "f1_indexed_short", "f2_artist_album_filter", "j1_match_join", "j5_library_match", "j19_tree_changes", "j8_deletions", "j8_tree_deletions", "m2_merge_fields", "m6_validate_labels", "o6_home_blocks", "o7_indexed_search", "o7_search", "p17_query_forms", "p17_retrieved", "w6_early_stop", "p34_sanitize", "p48_clean_tracks", "q2_stratified_sample", "s9_unwrap", "t1_catalog_refresh_stream", "t3_new_completions_stream", "w11_failure_streaks"]


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return tuple(map(plain, value)) if isinstance(value, list) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("the given tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, found.fetchall())
