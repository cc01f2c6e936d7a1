"""Similarity joins of short texts: all pairs of a least similarity, found by prefix filters instead of all pairs.

Two texts of lengths m and n that are k edits apart share max(m, n) - 1 - 2k bigrams at least. With a least similarity
that is a number of shared bigrams, so in one global order of bigrams the first few of either text, as many as they can
lack and one more, must have one in common. The order is by frequency, rarest first; frequencies are counted for
FREQUENCIES hashed classes of bigrams, a table of fixed size that every task gets. Pairs that meet on a bigram are
tried by length, then by the characters that only one of them has, then by edit distance with a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.shared import shuffled

#: Classes of bigrams whose frequencies are counted.
FREQUENCIES = 1 << 14


def char_mask(c: Column) -> Column:
    """The characters of a text as a set of 64 classes."""
    classes = F.transform(F.array_distinct(F.split(c, "")), lambda x: F.pmod(F.ascii(x), F.lit(64)))
    return F.aggregate(classes, F.lit(0).cast("bigint"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))


def may_be_near(x: str, y: str, most: Column) -> Column:
    """Whether lengths and characters allow ``most`` edits between the texts whose prefixed columns n and mask are given."""
    only = lambda a, b: F.bit_count(F.col(a + "mask").bitwiseAND(F.bitwise_not(F.col(b + "mask"))))
    return (F.abs(F.col(x + "n") - F.col(y + "n")) <= most) & (only(x, y) <= most) & (only(y, x) <= most)


def edits_allowed(longer: Column, least: Column) -> Column:
    return F.floor((1 - least) * longer + 1e-9).cast("int")


def within(a: Column, b: Column, most: Column) -> Column:
    """Whether ``a`` and ``b`` are at most so many edits apart."""
    return F.call_function("levenshtein", a, b, most) >= 0


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Dealt by columns into as many parts as the session shuffles into, or more. A join whose small sides make many pairs
    needs them: adaptive execution counts the bytes of the sides only."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *by)


def _bigrams(c: Column) -> Column:
    """The bigrams in sorted order, each with its number among equal ones."""
    n = F.char_length(c)
    runs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    numbered = lambda s: F.transform(s, lambda g, i: F.struct(g.alias("g"), (i - F.array_position(s, g)).alias("k")))
    return F.element_at(F.transform(F.array(F.array_sort(runs)), numbered), 1)


def _class(g: Column) -> Column:
    return F.pmod(F.xxhash64(g), F.lit(FREQUENCIES)).cast("int")


def _frequencies(*sides: DataFrame) -> DataFrame:
    """One row: how often each class of bigrams occurs."""
    spark, every = sides[0].sparkSession, None
    for df in sides:
        part = df.select(F.explode(F.transform("grams", lambda x: _class(x["g"]))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        every = part if every is None else every.unionByName(part)
    dense = spark.range(FREQUENCIES).select(F.col("id").cast("int").alias("id")).join(every, "id", "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "n"))), lambda x: x["n"]).alias("often"))


def _keys(df: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """The texts once for each of their first bigrams in the global order; very short ones also for each character."""
    n, share = F.col("n"), 2 * least - 1
    rare = F.array_sort(F.transform("grams", lambda x: F.struct(F.get("often", _class(x["g"])).alias("o"), x["g"].alias("g"), x["k"].alias("k"))))
    common = F.greatest(F.lit(1), F.ceil(share * n - 1 - 1e-9).cast("int"))  # bigrams that any partner shares at least
    first = F.transform(F.slice(rare, F.lit(1), F.greatest(n - common, F.lit(0))), lambda x: F.concat(x["g"], x["k"].cast("string")))
    chars = F.transform(F.array_distinct(F.split("text", "")), lambda c: F.concat(F.lit("."), c))
    keys = F.when(share * n - 1 <= 1e-9, F.concat(first, chars)).otherwise(first)
    # one row of a fixed number of counts
    return df.crossJoin(F.broadcast(often)).withColumn("key", F.explode(keys)).drop("often", "grams")


def _side(df: DataFrame, key: str, text: str, blocked: bool, more: tuple[str, ...] = ()) -> DataFrame:
    own = df.select(F.col(key).alias("id"), F.col(text).alias("text"), *more, *([F.explode("b").alias("b")] if blocked else [])).where("text <> ''")
    return own.withColumns({"n": F.char_length("text"), "mask": char_mask(F.col("text"))})


def near_pairs(left: DataFrame, right: DataFrame, least: float, also: Column | None = None, need: Column | None = None, more: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())) -> DataFrame:
    """(l, r), each once, of left (l, x) and right (r, y) where 1 - edits / longer length is ``least`` (above 0.5) or more.

    Both may carry a column ``b``, an array: only pairs that share a value there are returned. ``also`` narrows the pairs
    before they are compared, ``need`` raises ``least`` for a pair; both are of columns ``more`` of either side, prefixed x_
    and y_. Empty and null texts have no pairs. Exact: no pair is missed, and none is capped.
    """
    if least <= 0.5:
        raise ValueError("bigrams can't find pairs of a similarity of 0.5 or less")
    blocked = "b" in left.columns
    with_grams = lambda df: df.withColumn("grams", _bigrams(F.col("text")))
    often = _frequencies(*(with_grams(_side(df, k, t, False)).select("grams") for df, k, t in ((left, "l", "x"), (right, "r", "y"))))
    one, two = (_keys(with_grams(_side(df, k, t, blocked, m)), often, least) for df, k, t, m in ((left, "l", "x", more[0]), (right, "r", "y", more[1])))
    on = ["key", "b"] if blocked else ["key"]
    named = lambda df, p: df.select(*(F.col(c).alias(c if c in on else p + c) for c in df.columns))
    longer = F.greatest("x_n", "y_n")
    most, own = edits_allowed(longer, F.lit(least)), edits_allowed(longer, F.lit(least) if need is None else need)
    met = spread(named(one, "x_"), *on).join(shuffled(spread(named(two, "y_"), *on)), on).where(F.lit(True) if also is None else also)
    met = met.where(may_be_near("x_", "y_", most)).where(within(F.col("x_text"), F.col("y_text"), own))
    return met.select(F.col("x_id").alias("l"), F.col("y_id").alias("r")).distinct()


def grams(c: Column, n: int = 3) -> Column:
    """Distinct n-grams; a shorter text is its own gram."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(runs)


def contained_pairs(left: DataFrame, right: DataFrame, n: int = 3) -> DataFrame:
    """(l, r) where the texts x and y, both non-empty, hold one another. The rarest gram of the inner text must be among the outer one's.

    Both may carry a column ``b``, an array: only pairs that share a value there are returned.
    """
    blocked = "b" in left.columns
    on = ["g", "b"] if blocked else ["g"]
    spread_blocks = lambda df: df.withColumn("b", F.explode("b")) if blocked else df
    more = ["b"] if blocked else []

    def inside(inner: DataFrame, a: str, s: str, outer: DataFrame, b: str, t: str) -> DataFrame:
        outer_grams = outer.select(b, *more, F.explode(grams(F.col(t), n)).alias("g"))
        seen = outer_grams.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
        own = inner.where(F.char_length(s) >= n).select(a, F.explode(grams(F.col(s), n)).alias("g")).join(shuffled(seen), "g", "left")
        rare = own.groupBy(a).agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g")).alias("m")).where("m.c > 0").select(a, F.col("m.g").alias("g"))
        rare = rare.join(shuffled(inner.select(a, s, *more)), a)
        long_pairs = spread_blocks(rare).join(shuffled(spread_blocks(outer_grams.join(shuffled(outer.select(b, t)), b))), on)
        # a text shorter than n characters is itself one of the outer text's grams of its length
        short = outer.select(b, t, *more, F.explode(F.array_distinct(F.concat(*(grams(F.col(t), k) for k in range(1, n))))).alias("g"))
        tiny = inner.where((F.char_length(s) < n) & (F.col(s) != "")).select(a, s, *more, F.col(s).alias("g"))
        both = long_pairs.select(a, s, b, t).unionByName(spread_blocks(tiny).join(shuffled(spread_blocks(short)), on).select(a, s, b, t))
        return both.where(F.contains(F.col(t), F.col(s)) & (F.col(t) != "")).select(a, b)

    return inside(left, "l", "x", right, "r", "y").unionByName(inside(right, "r", "y", left, "l", "x").select("l", "r")).distinct()
