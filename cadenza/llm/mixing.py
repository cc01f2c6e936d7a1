"""Mixing sources to target weights in a tree of domains, languages and sources.

A token budget flows down the tree. At each node it is shared among the children by weight; a child that
can't supply its share (its leaves' tokens times the epochs allowed) gives what it has, and its siblings
take over the rest by weight. Only what a whole node can't supply reaches its ancestors' other children. Each leaf
then gives its budget as whole epochs and a token prefix of one more epoch, in a seeded order of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, packed

WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """The integer weight of a value of ``level``; values without one weigh what None says, 1 if nothing does."""
    given = weights.get(level, {})
    out = F.lit(given.get(None, 1))
    for value, weight in given.items():
        if value is not None:
            out = F.when(F.col(level) == value, F.lit(weight)).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Adds ``budget`` to nodes (parents, name, weight, cap, given): ``given`` shared among the children of a parent.

    Children in the order of cap / weight are full as long as their caps fit their shares of what is left; the
    others split the rest by weight, rounded down.
    """
    order = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight").cast("double")).otherwise(F.lit(1e308))
    by_ratio = order.orderBy("_ratio", name)
    used = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    heavy = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    left = F.greatest(F.col("given") - F.col("_used"), F.lit(0)).cast("double")
    rate = F.when(F.col("_heavy") > 0, left / F.col("_heavy").cast("double")).otherwise(F.lit(0.0))
    out = nodes.withColumn("_ratio", ratio).withColumn("_used", used).withColumn("_heavy", heavy).withColumn("_rate", rate)
    out = out.withColumn("_full", F.col("_ratio") <= F.col("_rate"))
    level = F.coalesce(F.max(F.when(~F.col("_full"), F.col("_rate"))).over(order), F.lit(0.0))
    budget = F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(level * F.col("weight").cast("double"))))
    return out.withColumn("budget", budget.cast("long")).drop("_ratio", "_used", "_heavy", "_rate", "_full")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], fraction: float, epochs: int) -> DataFrame:
    """leaves (levels, tokens) with ``budget``: ``fraction`` of all tokens, shared down the tree."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    whole = caps.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)).cast("double") * fraction).cast("long").alias("given"))
    given, parents = whole.withColumn("_one", F.lit(1)), []
    for depth, level in enumerate(levels, 1):
        here = list(levels[:depth])
        nodes = caps.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        if not parents:
            nodes = nodes.withColumn("_one", F.lit(1)).join(given, "_one").drop("_one")
        else:
            nodes = nodes.join(given, parents)
        nodes = share(nodes, parents, level)
        given, parents = nodes.select(*here, F.col("budget").alias("given")), here
    return leaves.join(given.withColumnRenamed("given", "budget"), list(levels))


ADDED = ("n_tokens", "epoch")


def mix(
    docs: DataFrame, levels: Mapping[str, Column] | Sequence[str], weights: Mapping[str, Mapping[str, int]], fraction: float, epochs: int, seed: int = 0,
    key: str = "doc_id", text: str = "text", range_rows: int = 2000, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` (their columns ``keep``, all by default) as often as they are selected, with ``n_tokens`` and
    ``epoch`` (from 0) added; columns of these names are replaced, all others come back as they were.

    ``levels`` are string columns, or names with column expressions, from the root's children down to the leaves, ``weights``
    integer weights by level and value (None: any other value; 1 if not given). A null in a level counts as the value ''.
    A leaf's epochs before the last are whole; of the last, the documents whose running token count stays within the rest
    are taken, in the order of a digest of seed, epoch, key and text, then of the key and the token count. Texts that are
    null or empty have 0 tokens; they are ordered like others and cost nothing. Repeated rows count and are selected
    each by itself. An empty table or a zero budget selects nothing.
    """
    levels = levels if isinstance(levels, Mapping) else {c: F.col(c) for c in levels}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    leaf = [f"l{i}" for i in range(len(levels))]
    tokens = token_count(F.col(text)).alias("n_tokens")
    nodes = [F.coalesce(c, F.lit("")).alias(x) for c, x in zip(levels.values(), leaf, strict=True)]
    leaves = materialize(docs.select(tokens, *nodes).groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    named = {x: weights[c] for c, x in zip(levels, leaf, strict=True) if c in weights}
    plan = leaf_budgets(leaves, leaf, named, fraction, epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    plan = plan.withColumn("whole", F.least(whole, F.lit(epochs))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = plan.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("rows") / range_rows)))
    plan = materialize(plan.where("budget > 0").select(*leaf, "whole", "rest", "ranges"), "plan")
    # the text is part of the digest so that rows that repeat a key spread over the ranges
    texts = F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5")
    rows = packed(docs, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(key).alias("id"), texts, tokens, *nodes, keep=kept)
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), "name", "text_md5")), 1, 8)
    placed = rows.join(plan, leaf).withColumn("digest", F.conv(digest, 16, 10).cast("long")).drop("name", "text_md5")
    placed = placed.withColumn("range", F.floor(F.col("digest") * F.col("ranges") / F.lit(float(1 << 32))).cast("long"))
    ranges = placed.groupBy(*leaf, "range").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(*leaf).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(*leaf, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*leaf, "range").orderBy("digest", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("sum", F.sum("n_tokens").over(inside)).join(offsets, [*leaf, "range"])
    times = F.col("whole") + F.when(F.col("offset") + F.col("sum") <= F.col("rest"), F.lit(1)).otherwise(F.lit(0))
    times = F.least(times, F.lit(epochs))
    return summed.where(times > 0).select("row", "n_tokens", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch")).select("row.*", *ADDED)
