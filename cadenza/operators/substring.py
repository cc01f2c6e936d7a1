"""Substring search: a stored index of 3-grams with bitmaps of row blocks.

Rows are stored in order of given columns, in zones (folders) of about ``ZONE_ROWS`` rows, and inside a zone in blocks of
``BLOCK_ROWS``. A task sorts one zone, or counts the grams of one, so zones bound its memory. For each gram of the folded text the index has a bitmap of the blocks of a zone that hold it. A search
meets the bitmaps of its grams, reads the blocks that are left, and verifies each row by ``contains``; so its rows are those
of a scan. Texts that repeat from row to row, as names of artists and albums do, share blocks when they are in the order.

A gram may cross from one column to the next where the searched text does. Texts shorter than three characters have no
gram: searches for them read all blocks. Null texts are in no gram and are never found.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.sources.shared import work_folder

GRAM = 3
BLOCK_ROWS, ZONE_ROWS = 64, 1 << 16
#: Up to so many blocks are named to the scan as values; more are met by a join.
LISTED = 1000
_PLACE = ("_zone", "_block")
#: A block's number is its zone times this plus its number in the zone, from 1 as bitmaps count.
_APART = 1 << 33
#: Bytes of a whole bitmap.
_BYTES = 4096


@dataclass(frozen=True)
class SearchIndex:
    """The folders of an index, the schema of its rows and the text that is searched."""

    rows: str
    grams: str
    schema: str
    text: Column

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows, with their zone and block."""
        return spark.read.schema(f"{self.schema}, _block bigint, _zone int").parquet(self.rows)


def grams(text: Column) -> Column:
    """Distinct runs of three characters of a text, lower-cased; null or shorter texts have none."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1)))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(GRAM))))


def build_search_index(df: DataFrame, text: Column, order: Sequence[str], zone_rows: int = ZONE_ROWS, block_rows: int = BLOCK_ROWS, folder: str | None = None) -> SearchIndex:
    """Stores ``df`` in blocks, ordered by ``order``, and the bitmaps of the grams of ``text``, an expression over its columns.

    Extra columns are stored as they are; those named _zone and _block are replaced. An empty table gives an empty index.
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, "substring-index")
    index = SearchIndex(f"{folder}/rows", f"{folder}/grams", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(*_PLACE).schema), text)
    zones = max(1, -(-df.count() // zone_rows))
    ranged = df.drop(*_PLACE).repartitionByRange(zones, *order).sortWithinPartitions(*order)
    # the low 33 bits number the rows of a partition
    within = F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / block_rows) + 1
    placed = ranged.withColumn("_zone", F.spark_partition_id()).withColumn("_block", F.col("_zone") * F.lit(_APART) + within)
    # pages as small as blocks, so that the scan can leave out what the blocks' range doesn't touch
    placed.write.option("parquet.page.row.count.limit", block_rows).partitionBy("_zone").parquet(index.rows)
    held = index.table(spark).select(*_PLACE, F.explode(grams(text)).alias("gram"))
    block = F.col("_block") - F.col("_zone") * F.lit(_APART)
    bit = F.bitmap_bit_position(block)
    bits = held.groupBy("gram", "_zone", F.bitmap_bucket_number(block).alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("blocks"), F.max(bit).alias("last"))
    # without the empty bytes behind the last block: a zone fills a small part of a bitmap's 4096
    bits = bits.select("gram", "_zone", "bucket", F.substring("blocks", F.lit(1), (F.floor(F.col("last") / 8) + 1).cast("int")).alias("blocks"))
    bits.repartitionByRange("gram").sortWithinPartitions("gram", "_zone").write.parquet(index.grams)
    return index


def blocks_of(spark: SparkSession, index: SearchIndex, q: str) -> DataFrame:
    """_zone, _block of the blocks that hold every gram of ``q``; a superset of those in which ``q`` stands."""
    low = q.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    known = spark.read.schema("gram string, _zone int, bucket bigint, blocks binary").parquet(index.grams).where(F.col("gram").isin(wanted))
    both = known.groupBy("_zone", "bucket").agg(F.bitmap_and_agg(F.rpad("blocks", _BYTES, F.lit(b"\0"))).alias("blocks"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
    digits = F.hex("blocks")
    value = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")  # noqa: E731  byte i
    filled = F.filter(F.sequence(F.lit(0), F.length("blocks") - 1), lambda i: F.substring(digits, 2 * i + 1, F.lit(2)) != "00")
    at = lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.when(F.call_function("shiftright", value(i), b).bitwiseAND(F.lit(1)) == 1, 8 * i + b)), lambda x: x.isNotNull())
    # buckets are numbered from 1 and hold 32768 bits
    bit = F.explode(F.flatten(F.transform(filled, at))).alias("bit")
    return both.select("_zone", "bucket", bit).select("_zone", (F.col("_zone") * F.lit(_APART) + (F.col("bucket") - 1) * 32768 + F.col("bit") + 1).alias("_block"))


def search_index(spark: SparkSession, index: SearchIndex, q: str) -> DataFrame:
    """The rows whose text holds ``q``, case-folded."""
    table = index.table(spark)
    verified = F.contains(F.lower(index.text), F.lit(q.lower()))
    if len(q.lower()) < GRAM:
        return table.where(verified).drop(*_PLACE)
    named = blocks_of(spark, index, q)
    few = named.limit(LISTED + 1).collect()
    if len(few) > LISTED:
        read = table.join(named, list(_PLACE), "left_semi")
    else:
        # zones are folders, and blocks are pushed to the scan: other folders and pages aren't read
        read = table.where(F.col("_zone").isin(sorted({r["_zone"] for r in few})) & F.col("_block").isin(sorted(r["_block"] for r in few)))
    return read.where(verified).drop(*_PLACE)


def page_of(found: DataFrame, kind: str, item: str, n: int) -> DataFrame:
    """type, rank, item, total: the first ``n`` of the items found, in order, and how many there are."""
    total = found.agg(F.count(F.lit(1)).alias("total")).withColumn("type", F.lit(kind))
    top = found.select(F.lit(kind).alias("type"), F.col(item).alias("item")).orderBy("item").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy("item"))).join(total, "type").select("type", "rank", "item", "total")
