"""The driver's tables in the roles of a catalog: tracks, plays, favourites, candidates, attempts, tasks and files.

Each view is stated once for Spark and once for DuckDB; most expressions are the same text in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.shared import path_exists, work_folder

ERA_SQL = "case when year <= 0 then '未知' when year < 1990 then '80s及更早' when year < 2000 then '90s' when year < 2010 then '2000s' when year < 2020 then '2010s' else '2020s' end"

_TRACK = {
    "id": "'tp_' || p_partkey",
    "partkey": "p_partkey",
    "title": "p_name",
    "cleanTitle": "p_name",
    "artist": "p_brand",
    "cleanArtist": "case when p_partkey % 11 = 0 then null else p_brand end",
    "album": "case when p_partkey % 7 = 0 then '' else p_type || ' ' || (p_size % 10) end",
    "albumGroup": "case when p_partkey % 7 = 0 then 'unknown' else 'real' end",
    "genre": "case when p_partkey % 5 = 0 then null else p_type end",
    "lang": "case p_size % 3 when 0 then 'en' when 1 then 'de' else 'fr' end",
    "year": "cast(case when p_partkey % 6 = 0 then 0 else 1975 + p_size end as int)",
    "durationSec": "cast(p_size * 10 as int)",
    "coverId": "case when p_partkey % 3 = 0 then '' else 'cv_' || (p_partkey % 50) end",
    "lyrics": "case when p_partkey % 4 = 0 then 'la la la la la' end",
    "confidence": "round((p_retailprice - 900) / 100, 3)",
    "createdAt": "1577836800 + p_partkey * 3600",
    "isAd": "p_partkey % 40 = 0",
    "isGarbled": "p_partkey % 90 = 1",
    "filePath": "p_brand || '/' || p_type || '/' || p_name || ' ' || p_partkey || '.mp3'",
    "fileName": "p_name || ' ' || p_partkey || '.mp3'",
    "sizeBytes": "p_partkey * 1000 + p_size",
}


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where this process has stored tables that several queries share: (application, name, folder of the tables) -> path.
_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` that ``build`` derives from the tables of ``sf_dir``: written to the shared folder once, read by all later queries."""
    known = (spark.sparkContext.applicationId, name, sf_dir)
    path = _STORED.get(known)
    if path is None or not path_exists(spark, f"{path}/_SUCCESS"):
        path = work_folder(spark, name)
        build().write.parquet(path)
        _STORED[known] = path
    return spark.read.parquet(path)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = tables(spark, sf_dir, "part").selectExpr(*(f"{v} as {k}" for k, v in _TRACK.items()), "p_name", "p_type")
    return base.selectExpr(
        "*", f"{ERA_SQL} as era", "array(split_part(p_name, ' ', 1)) as mood", "array(split_part(p_name, ' ', 2), lower(p_type)) as scene",
        "map('genre', case when partkey % 2 = 0 then 'online:netease' else 'embed' end) as sourceMap",
        "map('cleanArtist', 0.9D, 'genre', 0.7D) as fieldConfidence", "array('old_' || partkey) as legacyIds", "confidence < 0.3 as needReview",
        "case when confidence >= 0.8 then 'high' when confidence >= 0.4 then 'medium' else 'low' end as qualityLevel",
    ).drop("p_name", "p_type")


TRACKS_SQL = (
    "tracks0 as (select " + ", ".join(f'{v} as "{k}"' for k, v in _TRACK.items()) + ", p_name, p_type from part), "
    f"tracks as (select * exclude (p_name, p_type), {ERA_SQL} as era, [split_part(p_name, ' ', 1)] as mood, [split_part(p_name, ' ', 2), lower(p_type)] as scene, "
    "case when partkey % 2 = 0 then 'online:netease' else 'embed' end as src, 'old_' || partkey as legacy, confidence < 0.3 as needReview, "
    "case when confidence >= 0.8 then 'high' when confidence >= 0.4 then 'medium' else 'low' end as qualityLevel from tracks0)"
)


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "lineitem").selectExpr("'tp_' || l_partkey as track_id", "l_shipdate as played_at", "cast(l_quantity as int) as duration_sec", "l_orderkey as event", "l_linenumber as line")


PLAYS_SQL = "plays as (select 'tp_' || l_partkey as track_id, l_shipdate as played_at, cast(l_quantity as int) as duration_sec, l_orderkey as event, l_linenumber as line from lineitem)"


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.expr("'tp_' || l_partkey").alias("track_id")).agg(F.min("l_shipdate").alias("added_at"))


FAVORITES_SQL = "favorites as (select 'tp_' || l_partkey as track_id, min(l_shipdate) as added_at from lineitem where l_returnflag = 'R' group by 1)"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "case o_orderstatus when 'F' then 'finished' when 'O' then 'queue' else 'downloading' end as status", "'T' || (o_custkey % 97) as name",
        "cast(unix_timestamp(cast(o_orderdate as timestamp)) as string) as startedAt", "cast(unix_timestamp(cast(o_orderdate as timestamp)) + o_custkey as string) as updatedAt", "cast(o_custkey % 320 as int) as kbps", "cast(o_orderkey % 600 as int) as seconds",
        "o_totalprice / 4000 as progress",
    )


TASKS_SQL = (
    "tasks as (select o_orderkey as id, case o_orderstatus when 'F' then 'finished' when 'O' then 'queue' else 'downloading' end as status, 'T' || (o_custkey % 97) as name, "
    "epoch(o_orderdate)::bigint as s, epoch(o_orderdate)::bigint + o_custkey as e, (o_custkey % 320)::int as kbps, (o_orderkey % 600)::int as seconds, o_totalprice / 4000 as progress from orders)"
)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type as the source, value as the elapsed time, a code out of props, and a running index."""
    return tables(spark, sf_dir, "events").selectExpr(
        "event_id as idx", "ts", "event_type as source", "value as elapsed", "cast(get_json_object(props, '$.k') as int) as code", "cast(user_id as string) as q",
        "event_type <> 'error' as ok", "cast(get_json_object(props, '$.k') as int) % 10 as n_found",
    )


ATTEMPTS_SQL = "attempts as (select event_id as idx, ts, event_type as source, value as elapsed, cast(json_extract_string(props, '$.k') as int) as code, cast(user_id as varchar) as q, event_type <> 'error' as ok, cast(json_extract_string(props, '$.k') as int) % 10 as n_found from events)"
