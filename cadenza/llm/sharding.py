"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions only.

A key's shard follows from the key and the shard count alone; going from n to n + 1 shards moves rows only
into the new shard, about 1 / (n + 1) of them. There is no ring table. Rows are then numbered inside
each shard without gathering a shard in one task: rows fall into ranges of a key digest, the small counts
of the ranges are summed up, and each range numbers its own rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import named, packed

#: Multiplier of the published generator, and its halves.
MULTIPLIER = 2862933555777941757
HIGH, LOW, MASK = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF, 0xFFFFFFFF


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _times_low32(x: Column, factor: int) -> Column:
    """The low 32 bits of a 32-bit ``x`` times a 32-bit ``factor``; no product passes 2^49."""
    upper = _low(F.shiftright(x, 16) * F.lit(factor), 16)
    return _low(_low(x, 16) * F.lit(factor) + F.shiftleft(upper, 16), 32)


def _next_key(hi: Column, lo: Column) -> Column:
    """(key * MULTIPLIER + 1) mod 2^64 as its halves; no partial result leaves a signed long."""
    upper = F.shiftright(lo, 16) * F.lit(LOW)
    lower = F.shiftleft(_low(upper, 16), 16) + _low(lo, 16) * F.lit(LOW) + F.lit(1)
    carried = F.shiftright(upper, 16) + F.shiftright(lower, 32)
    return F.struct(_low(carried + _times_low32(hi, LOW) + _times_low32(lo, HIGH), 32).alias("hi"), _low(lower, 32).alias("lo"))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of an integer key, taken as unsigned 64 bits. A null key counts as 0.

    The published loop ends after about ln(shards) jumps. A fold can't stop early, so a short one runs
    first, and a key that it leaves unfinished goes on to one of ``shards`` steps, which always suffices
    because each jump moves on by at least 1.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        def jumped(k: Column) -> Column:
            to = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(k["hi"], 1) + 1).cast("double")))
            return F.struct(k["hi"].alias("hi"), k["lo"].alias("lo"), s["j"].alias("b"), to.cast("long").alias("j"))

        return F.when(s["j"] >= shards, s).otherwise(_let(_next_key(s["hi"], s["lo"]), jumped))

    whole = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(whole, 32).alias("hi"), _low(whole, 32).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )
    short = min(shards, 16 + 4 * math.ceil(math.log(shards)))
    first = F.aggregate(F.sequence(F.lit(1), F.lit(short)), start, step)
    if short == shards:
        return first["b"].cast("int")
    done = _let(first, lambda s: F.when(s["j"] >= shards, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), s, step)))
    return done["b"].cast("int")


def shard_key(df: DataFrame, key: str) -> Column:
    """Integer keys as they are; any other key as the 64-bit hash of its text. A null key stays null."""
    column = named(key)
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return column.cast("long")
    return F.when(column.isNotNull(), F.xxhash64(column.cast("string")))


ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", range_rows: int = 2000, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``law``
    (always ``key``), ``shard``, ``slot`` and ``grown_shard`` (the shard if there were one more) added; columns of these
    names in ``df`` are replaced, all others come back as they were.

    ``slot`` counts each shard's rows from 0 without gaps, in the order of a 32-bit digest of the key and the text's
    checksum, then of the key, the checksum and the size. ``range_rows`` is about the number of rows that one task numbers at
    a time; it doesn't change the result. A null text has no bytes and checksum 0, a null key goes where key 0 goes. Keys that
    aren't integers, such as strings, are hashed to 64 bits first.
    Repeated rows each get a slot of their own; rows that repeat a key with other texts are numbered in many ranges, though
    the law puts them all into one shard. An empty table gives an empty one.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ADDED]
    total = df.select(F.lit(1)).count()
    ranges = max(1, math.ceil(total / shards / range_rows))
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), crc)), 1, 8), 16, 10).cast("long")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    placed_by = shard_key(df, key)
    shard, grown = jump_hash(placed_by, shards), jump_hash(placed_by, shards + 1)
    placed = packed(
        df, F.col(key).alias("id"), size.alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), shard.alias("shard"), grown.alias("grown_shard"), digest.alias("digest"), keep=kept
    ).withColumn("range", F.floor(F.col("digest") * ranges / F.lit(float(1 << 32))).cast("int"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range").orderBy("digest", "id", "text_crc32", "size")
    numbered = placed.withColumn("place", F.row_number().over(inside)).join(offsets, ["shard", "range"])
    return numbered.withColumn("slot", (F.col("offset") + F.col("place") - 1).cast("long")).select("row.*", *ADDED)


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text", range_rows: int = 100_000) -> None:
    """Writes the sharded rows as Parquet under ``path/shard=N``, a file for each range of slots."""
    out = assign_shards(df, shards, key, text)
    piece = F.floor(F.col("slot") / range_rows)
    out.repartition("shard", piece).write.partitionBy("shard").option("maxRecordsPerFile", range_rows).parquet(path)
