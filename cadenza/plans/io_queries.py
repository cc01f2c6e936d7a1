"""Queries of the writers and the streaming jobs: they write to the shared folder and return what is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import link as L
from cadenza.operators import merge as M
from cadenza.plans.link_queries import _items, _library
from cadenza.plans.merge_queries import NOW, _candidates, _current
from cadenza.plans.registry import query
from cadenza.plans.views import PLAYS_SQL, TRACKS_SQL, tables, tracks
from cadenza.sources import ingest, sinks
from cadenza.sources.shared import work_folder
from cadenza.streaming import jobs


def _stream(spark, sf, name: str):
    """A table as a stream of its files. The schema is that of the files."""
    schema = tables(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("s16_json_export", f"with {TRACKS_SQL} select id, title, cleanArtist as \"cleanArtist\", year, mood[1] as mood from tracks")
def _s16(spark, sf):
    path = work_folder(spark, "export")
    sinks.export_json(tracks(spark, sf), path)
    back = spark.read.schema("id string, title string, cleanArtist string, year int, mood array<string>").json(path)
    return back.select("id", "title", "cleanArtist", "year", F.get("mood", 0).alias("mood"))


@query("s17_catalog_round_trip", f"with {TRACKS_SQL} select id, filePath as \"filePath\", title, year from tracks")
def _s17(spark, sf):
    path = work_folder(spark, "catalog")
    sinks.write_catalog(tracks(spark, sf), path)
    return spark.read.parquet(path).select("id", "filePath", "title", "year")


@query("s19_failure_list", f"with {TRACKS_SQL} select filePath as \"filePath\", 'L1' as stage, 'no genre' as reason from tracks where genre is null")
def _s19(spark, sf):
    path = work_folder(spark, "failures")
    sinks.failure_list(tracks(spark, sf).withColumn("why", F.when(F.col("genre").isNull(), "no genre")), path, "L1", "why")
    return spark.read.option("header", True).schema("filePath string, stage string, reason string").csv(path)


@query("s13_sidecar_lyrics", f"with {TRACKS_SQL} select id, 'words of ' || id || chr(10) || title || chr(10) as lyrics from tracks where partkey % 200 = 0")
def _s13(spark, sf):
    # one text file for each 200th track, as few tracks have one, in a folder named by the track
    root = work_folder(spark, "sidecar")
    t = tracks(spark, sf).select("id", "title", "partkey")
    t.where("partkey % 200 = 0").select("id", F.concat_ws("\n", F.concat(F.lit("words of "), "id"), "title").alias("value")).write.partitionBy("id").text(root)
    sidecar = ingest.sidecar_lyrics(spark, root, "*.txt").select(F.regexp_extract("stem", "id=([^/]+)/[^/]+$", 1).alias("id"), "lyrics")
    return t.join(sidecar, "id").select("id", "lyrics")


def _stage(spark, sf, n: int):
    return L.library_match(_items(spark, sf), _library(spark, sf)).where(F.col("stage") == n).select("item", "id")


_WANT = "want as (select p_partkey as item, replace(lower(case p_partkey % 3 when 0 then p_name || ' ' || p_partkey when 1 then 'The ' || p_name || ' ' || p_partkey else p_name || '_' || p_partkey end), ' ', '') as n, lower(p_brand) as a from part)"


@query("j2_exact_titles", f"with {_WANT}, have as (select p_partkey as id, replace(lower(p_name || ' ' || p_partkey), ' ', '') as t, lower(p_brand) as b from part) select item, min(id) as id from want join have on n = t where contains(a, b) or contains(b, a) group by 1")
def _j2(spark, sf):
    return L.exact_titles(_items(spark, sf), _library(spark, sf))


@query("j4_file_names", f"with {_WANT}, have as (select p_partkey as id, replace(lower(p_name || ' ' || p_partkey), ' ', '') as t, lower(p_brand) as b, replace(lower(p_name || '_' || p_partkey), ' ', '') as f from part), early as (select distinct item from want join have on contains(n, t) or contains(t, n) where contains(a, b) or contains(b, a)) select item, min(id) as id from want join have on n = f or starts_with(n, f) or starts_with(f, n) where (contains(a, b) or contains(b, a) or contains(f || '-' || b, a)) and item not in (select item from early) group by 1")
def _j4(spark, sf):
    return _stage(spark, sf, 3)


@query("m1_apply_one_field", "select p_partkey as id, case when p_partkey % 13 = 0 or p_partkey % 2 = 1 then p_name when p_partkey % 3 = 2 then p_type when p_partkey % 3 = 1 then p_type else p_name end as value from part")
def _m1(spark, sf):
    one = _candidates(spark, sf).where("seq = 1")
    return M.merge_fields(_current(spark, sf), one, NOW).select("id", "value")


@query("t2_play_history_stream", f"with {PLAYS_SQL} select track_id, max(played_at) as played_at, count(*) as plays from plays group by 1")
def _t2(spark, sf):
    plays = _stream(spark, sf, "lineitem").selectExpr("'tp_' || l_partkey as track_id", "l_shipdate as played_at", "cast(l_quantity as int) as duration_sec")
    out, marks = work_folder(spark, "history"), work_folder(spark, "history-state")

    def keep(batch, number):  # a batch holds the tracks that it changed, and writes the same rows when it is run again
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    jobs.play_history(plays).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("track_id").agg(F.max_by(F.struct("played_at", "plays"), "batch").alias("r"))
    return last.select("track_id", "r.played_at", "r.plays")


def _in_turn(spark, name: str, parts, run):
    """Writes one part after the other to a folder and lets the stream of its files take each up; ``run`` starts the stream where it left off."""
    folder = work_folder(spark, name)
    for part in parts:
        part.write.mode("append").parquet(folder)
        run(spark.readStream.schema(part.schema).parquet(folder)).awaitTermination()


#: States over which the ids of a source are spread.
SLOTS = 32


@query(
    "t3_new_completions_stream",
    """with done as (select o_orderpriority as source, year(o_orderdate) as y, o_orderdate as ts from orders where o_orderstatus = 'F')
 select source, epoch_ms(max(ts)) as at, count(*) as completed from done where y >= 1997 group by source, (y >= 1999)""",
)
def _t3(spark, sf):
    # three polls by the year of the order; the tasks of 1996 and 1998 come twice, and aren't new the second time
    tasks = tables(spark, sf, "orders").selectExpr("o_orderpriority as source", "o_orderkey as id", "case o_orderstatus when 'F' then 'success' else 'running' end as status", "cast(o_orderdate as timestamp) as ts", "year(o_orderdate) as y")
    polls = [tasks.where(rule).drop("y") for rule in ("y < 1997", "y between 1996 and 1998", "y >= 1998")]
    out, marks = work_folder(spark, "signals"), work_folder(spark, "signals-state")
    # the ids of each poll may be more than are remembered by default
    with jobs.keyed_state(spark):
        _in_turn(spark, "polls", polls, lambda s: jobs.new_completions(s, most=1 << 40, slots=SLOTS).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start())
    return spark.read.schema("source string, at long, completed long").parquet(out)


@query("t4_telemetry_stream", "with w as (select time_bucket(interval '1 hour', ts) as start, event_type as source, event_type <> 'error' as ok from events) select start, source, count(*) as n, count(*) filter (where not ok) as failed from w where start + interval '1 hour' <= (select max(ts) - interval '1 hour' from events) group by 1, 2")
def _t4(spark, sf):
    attempts = _stream(spark, sf, "events").selectExpr("cast(ts as timestamp) as ts", "event_type as source", "event_type <> 'error' as ok", "value as elapsed")
    out, marks = work_folder(spark, "telemetry"), work_folder(spark, "telemetry-state")
    jobs.live_telemetry(attempts).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "source", "n", "failed")


@query("t1_catalog_refresh_stream", "select 'f' || p_partkey as \"filePath\", case when p_partkey % 3 = 0 then p_partkey % 97 + 1 else p_partkey % 97 end as mtime, p_size::bigint as size from part where p_partkey % 5 <> 0")
def _t1(spark, sf):
    # two enumerations: in the second a fifth of the files is gone and a third of the rest has changed
    files = tables(spark, sf, "part").selectExpr("'f' || p_partkey as filePath", "cast(p_partkey % 97 as bigint) as mtime", "cast(p_size as bigint) as size", "p_partkey as k")
    again = files.where("k % 5 <> 0").withColumn("mtime", F.expr("case when k % 3 = 0 then mtime + 1 else mtime end"))
    catalog, marks = work_folder(spark, "versions"), work_folder(spark, "versions-state")
    _in_turn(spark, "listings", [files.drop("k"), again.drop("k")], lambda s: jobs.refresh_catalog(s, spark, catalog, marks, whole=True))
    return jobs.read_catalog(spark, catalog)
