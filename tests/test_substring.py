"""Substring search by the stored index against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import substring as S

ODD = [None, "", "ab", "abc", "ABC", "a%c", "100% _sure_", "Ünïcödé", "日本語の歌", "naïve \\d+ [x]", "x" * 5000 + "needle" + "y" * 5000]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = [" ".join(rng.choice(["red", "blue", "bluer", "Tred", "dark", "rk bl", "Ärger"]) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    return list(enumerate(made + ODD * 2))


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    df = spark.createDataFrame([(i, t, 7, i % 5) for i, t in rows], "id long, t string, _block int, gram int").repartition(7)
    return S.build_search_index(df, F.col("t"), ["t", "id"], zone_rows=700, block_rows=16, folder=str(tmp_path_factory.mktemp("ix") / "i"))


@pytest.mark.parametrize("q", ["red", "RED BL", "ark bl", "bluer dark", "c", "ab", "", "%", "a%c", "_su", "日本語", "ïcö", "\\d+ [", "xneedley", "absent words", "ärger"])
def test_search_equals_a_scan(spark, rows, index, q):
    want = sorted(i for i, t in rows if t is not None and q.lower() in t.lower())
    assert sorted(r.id for r in S.search_index(spark, index, q).collect()) == want


def test_many_blocks_are_met_by_a_join(spark, rows, index, monkeypatch):
    monkeypatch.setattr(S, "LISTED", 3)
    want = sorted(i for i, t in rows if t is not None and "blue" in t.lower())
    found = S.search_index(spark, index, "blue")
    assert sorted(r.id for r in found.collect()) == want and found.columns == ["id", "t", "gram"]


def test_only_named_blocks_are_read(spark, index):
    named = S.blocks_of(spark, index, "xneedley").collect()
    assert 1 <= len(named) <= 2  # two equal rows stand side by side
    plan = S.search_index(spark, index, "xneedley")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(_zone" in scan and "_block" in scan.split("PushedFilters")[1]
    assert index.table(spark).select("_zone").distinct().count() > 3
    assert S.search_index(spark, index, "absent words").collect() == []


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, t string")
    index = S.build_search_index(empty, F.col("t"), ["t"], folder=str(tmp_path / "i"))
    assert S.search_index(spark, index, "abc").collect() == [] and S.search_index(spark, index, "a").collect() == []


def test_bitmaps_end_with_their_last_block(spark, index):
    """A zone of few rows holds few blocks; whole bitmaps of 4096 bytes for each gram of each zone would outweigh the rows."""
    assert S.ZONE_ROWS <= 1 << 16
    stored = spark.read.parquet(index.grams).agg(F.max(F.length("blocks")).alias("most"), F.min(F.length("blocks")).alias("least")).first()
    assert 1 <= stored.least and stored.most < 4096
