"""Digest trees against plain comparisons of the listings."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import digest_tree as D
from cadenza.operators import link as L

SCHEMA = "filePath string, mtime long, size long"


def listing(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def random_files(seed, n=2000):
    rng = random.Random(seed)
    paths = {"/".join([f"d{rng.randrange(6)}" for _ in range(rng.randrange(5))] + [f"f{i}"]) for i in range(n)}
    return {p: (rng.randrange(100), rng.choice([None, 1, 2])) for p in paths}


@pytest.mark.parametrize("share", [0.0, 0.002, 0.3])
def test_changes_equal_those_of_all_files(spark, share):
    rng, old = random.Random(int(share * 1000)), random_files(1)
    new = {p: v if rng.random() >= share else (v[0] + 1, v[1]) for p, v in old.items() if rng.random() >= share}
    new |= {f"d1/new{i}/x": (1, 1) for i in range(int(share * 100))}
    rows = [listing(spark, [(p, *v) for p, v in side.items()]) for side in (old, new)]
    folders = D.changed_folders(*map(D.build_tree, rows))
    want = {(p, "added") for p in new.keys() - old.keys()} | {(p, "removed") for p in old.keys() - new.keys()} | {(p, "changed") for p in old.keys() & new.keys() if old[p] != new[p]}
    assert {tuple(r) for r in D.file_changes(*rows, folders).collect()} == want
    parent = lambda p: p.rpartition("/")[0]
    assert sorted(r.folder for r in folders.collect()) == sorted({parent(p) for p, _ in want})


def test_guards_equal_those_of_the_join(spark):
    old = [(f"a/b{i % 9}/f{i}", 1, 1) for i in range(100)]
    for new in (old, old[7:], old[60:], []):
        sides = [listing(spark, side) for side in (old, new)]
        got = D.tree_deletions(*sides, *map(D.build_tree, sides)).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, L.deletions(*sides).select("filePath", "verdict").collect()))


def test_tree_has_the_sums_of_all_folders(spark):
    tree = D.build_tree(listing(spark, [("a/b/x", 1, 1), ("a/y", 1, 1), ("/z", 1, 1), ("w", 1, None), (None, 1, 1), ("a//v", 2, 2), ("a/y", 1, 1)]))
    got = {r.folder: (r.parent, r.depth, r.own_n, r.all_n) for r in tree.collect()}
    assert got == {"": (None, 0, 2, 6), "a": ("", 1, 2, 4), "a/b": ("a", 2, 1, 1), "a/": ("a", 2, 1, 1)}
    assert D.build_tree(listing(spark, [])).collect() == []


def test_null_columns_and_repeats_are_told_apart(spark):
    make = lambda *rows: D.build_tree(listing(spark, list(rows)))
    pairs = [(("p/a", None, 1), ("p/a", 1, None)), (("p/a", 1, 1), ("p/b", 1, 1))]
    for x, y in pairs:
        assert [r.folder for r in D.changed_folders(make(x), make(y)).collect()] == ["p"]
        assert [r.folder for r in D.changed_folders(make(x, x), make(y, y)).collect()] == ["p"]
        assert D.changed_folders(make(x, y), make(y, x)).collect() == []


def test_only_files_of_changed_folders_are_joined(spark):
    old = listing(spark, [(f"d{i % 50}/f{i}", 1, 1) for i in range(5000)])
    new = old.where("filePath <> 'd7/f7'")
    folders = D.changed_folders(D.build_tree(old), D.build_tree(new))
    assert [r.folder for r in folders.collect()] == ["d7"]
    plan = D.file_changes(old, new, folders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
    assert D.file_changes(old, new, folders).where(F.col("change") == "removed").count() == 1
