"""Writers: CSV and JSON exports, catalog tables, reports, failure lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the CSV export.
EXPORT_COLUMNS = ("id", "filePath", "cleanTitle", "cleanArtist", "album", "year", "era", "genre", "mood", "scene", "lang", "qualityLevel", "confidence")


def export_rows(df: DataFrame, columns: Sequence[str] = EXPORT_COLUMNS) -> DataFrame:
    """Columns as strings, arrays joined by spaces, nulls empty."""
    kinds = dict(df.dtypes)
    text = lambda c: F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c).cast("string")
    return df.select(*(F.coalesce(text(c), F.lit("")).alias(c) for c in columns))


def export_csv(df: DataFrame, path: str, columns: Sequence[str] = EXPORT_COLUMNS) -> None:
    """Quoted values, doubled quotes, CRLF, a header in each part."""
    export_rows(df, columns).write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def csv_lines(df: DataFrame, columns: Sequence[str] = EXPORT_COLUMNS) -> DataFrame:
    """The same lines as a column, for a sink that takes text."""
    quoted = [F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return export_rows(df, columns).select(F.concat_ws(",", *quoted).alias("line"))


def export_json(df: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines; gives a row with the number of them."""
    df.write.json(path)
    return df.sparkSession.read.text(path).agg(F.count(F.lit(1)).alias("total"))


def write_catalog(df: DataFrame, path: str, order: str = "filePath") -> None:
    """Parquet in ranges of paths, with rows in the order of their paths inside each file, which lets readers skip by path."""
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    df.repartitionByRange(ranges, order, "id").sortWithinPartitions(order, "id").write.parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """report, metric, value as JSON lines."""
    metrics.select("report", "metric", "value").write.json(path)


def markdown_lines(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A report's rows as lines of a Markdown table, without its head."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns: Sequence[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


def failure_list(df: DataFrame, path: str, stage: str, reason: str) -> None:
    """Rows with a reason, as CSV of filePath, stage, reason."""
    df.where(F.col(reason).isNotNull()).select("filePath", F.lit(stage).alias("stage"), F.col(reason).alias("reason")).write.option("header", True).csv(path)
