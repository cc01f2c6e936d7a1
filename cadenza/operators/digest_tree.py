"""Digest trees of file listings: which folders differ is found from the root down, and only their files are joined.

A file's digest is a hash of its path and the compared columns; a folder has the sums of the digests of its own files and
of all files below it. Sums don't depend on order, add up over folders, and count files that are listed twice. Trees are
stored by depth: comparing two listings reads the root, then the children of each folder that differs. Two hashes of
30 bits and the number of files stand for a folder, so different folders are taken for equal once in 2^60.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.shared import work_folder, written

_OWN, _BELOW = ("own_a", "own_b", "own_n"), ("all_a", "all_b", "all_n")


def folder_of(path: Column) -> Column:
    """What stands before the last slash; nothing for a file of the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _depth(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))


def build_tree(listing: DataFrame, columns: tuple[str, ...] = ("mtime", "size"), path: str = "filePath") -> DataFrame:
    """folder, parent, depth and the sums of each folder of a listing and of those above it, stored by depth.

    Files are summed up by folder before they are shuffled. Rows of a null path are left out; a null in a compared column is
    a value of its own. An empty listing gives an empty tree.
    """
    # hashes leave nulls out, so that each column is told by its name
    digest = F.xxhash64(path, F.to_json(F.struct(*columns)))
    files = listing.where(F.col(path).isNotNull()).select(folder_of(F.col(path)).alias("folder"), digest.bitwiseAND(F.lit((1 << 30) - 1)).alias("a"), F.shiftrightunsigned(digest, 34).alias("b"))
    own = written(files.groupBy("folder").agg(F.sum("a").alias("own_a"), F.sum("b").alias("own_b"), F.count(F.lit(1)).alias("own_n")), "folders")
    names = F.split("folder", "/")
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "/")))
    each = own.select(F.explode(F.array_distinct(above)).alias("above"), "*")
    mine = lambda c: F.sum(F.when(F.col("above") == F.col("folder"), F.col(c)).otherwise(F.lit(0))).alias(c)
    tree = each.groupBy("above").agg(*(mine(c) for c in _OWN), *(F.sum(o).alias(b) for o, b in zip(_OWN, _BELOW, strict=True))).withColumnRenamed("above", "folder")
    tree = tree.select("folder", F.when(F.col("folder") != "", folder_of(F.col("folder"))).alias("parent"), *_OWN, *_BELOW, _depth(F.col("folder")).alias("depth"))
    place = work_folder(listing.sparkSession, "tree")
    tree.write.partitionBy("depth").parquet(place)
    return listing.sparkSession.read.schema(tree.schema).parquet(place)


def changed_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """folder of those whose own files differ between two trees. One join for each depth that differences reach, of the children of folders that differ."""
    spark, out, depth, differing = old.sparkSession, [], 0, None
    names = (*_OWN, *_BELOW)
    while True:
        sides = [t.where(F.col("depth") == depth) for t in (old, new)]
        if differing is not None:
            sides = [s.join(differing.select(F.col("folder").alias("parent")), "parent", "left_semi") for s in sides]
        left, right = (s.select("folder", *(F.col(c).alias(f"{c}{i}") for c in names)) for i, s in enumerate(sides))
        differs = lambda cs: reduce(Column.__or__, (~F.coalesce(F.col(f"{c}0"), F.lit(0)).eqNullSafe(F.coalesce(F.col(f"{c}1"), F.lit(0))) for c in cs))
        met = left.join(right, "folder", "full").where(differs(_BELOW) | differs(_OWN))
        differing = written(met.select("folder", differs(_OWN).alias("own")), "differing")
        if differing.isEmpty():
            return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "folder string")
        out.append(differing.where("own").select("folder"))
        depth += 1


def file_changes(old: DataFrame, new: DataFrame, folders: DataFrame, columns: tuple[str, ...] = ("mtime", "size"), path: str = "filePath") -> DataFrame:
    """path, change (added, removed or changed) of the files of ``folders`` that differ; other folders' files aren't shuffled.

    A path that a listing holds several times counts with its greatest row.
    """
    # the folders that changed, not the listings, are what the join sends around
    inside = [df.withColumn("_folder", folder_of(F.col(path))).join(folders.select(F.col("folder").alias("_folder")), "_folder", "left_semi") for df in (old, new)]
    left, right = (df.groupBy(path).agg(F.max(F.struct(*columns)).alias(f"_{i}")) for i, df in enumerate(inside))
    change = F.when(F.col("_0").isNull(), "added").when(F.col("_1").isNull(), "removed").when(~F.col("_0").eqNullSafe(F.col("_1")), "changed")
    return left.join(right, path, "full").select(path, change.alias("change")).where("change is not null")


def tree_deletions(known: DataFrame, listing: DataFrame, known_tree: DataFrame, listing_tree: DataFrame, *, most: float = 0.5) -> DataFrame:
    """As ``link.deletions`` of the same tables, with the guards' numbers from the roots of the trees."""
    changes = file_changes(known, listing, changed_folders(known_tree, listing_tree))
    gone = written(changes.where("change = 'removed'").select("filePath"), "gone")
    total = lambda tree, name: tree.where("depth = 0").agg(F.coalesce(F.sum("all_n"), F.lit(0)).alias(name))
    # one row of counts
    facts = gone.agg(F.count(F.lit(1)).alias("gone_n")).join(total(known_tree, "all_n"), F.lit(True)).join(total(listing_tree, "list_n"), F.lit(True))
    verdict = F.when(F.col("list_n") == 0, "empty-enumeration").when(F.col("gone_n") > most * F.col("all_n"), "ratio-guard").otherwise("removed")
    one = facts.select(F.lit(1).alias("_one"), verdict.alias("verdict"))
    return gone.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")
