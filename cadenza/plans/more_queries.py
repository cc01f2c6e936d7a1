"""Queries of the cleaning job and of operators that combine others."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions import values as V
from cadenza.operators import clean as C
from cadenza.operators import link as L
from cadenza.operators import quality as Q
from cadenza.plans.link_queries import _BEST, _NAMES, SCORED_SQL, WHOLE_POOLED_SQL, _pooled, _scored
from cadenza.plans.registry import ORACLE_SQL, query
from cadenza.plans.views import tables
from cadenza.sources import ingest
from cadenza.sources.shared import work_folder


def _files(spark, sf):
    return tables(spark, sf, "part").selectExpr(
        "p_brand || '/' || p_type || '/' || p_name || ' ' || p_partkey || '.mp3' as filePath", "p_name || ' ' || p_partkey || '.mp3' as fileName", "2 as dirDepth", "p_partkey as partkey",
        "case p_partkey % 4 when 0 then p_name || '-' || p_brand when 1 then '' when 2 then '[HD] ' || p_name else p_name || ' live' end as title",
        "case p_partkey % 3 when 0 then p_brand when 1 then 'Unknown Artist' else null end as artist", "case when p_partkey % 5 = 0 then 'N/A' when p_partkey % 7 = 0 then 'Music' else p_type end as album",
        "cast(case when p_partkey % 6 = 0 then 0 else 1975 + p_size end as int) as year", "case when p_partkey % 8 = 0 then '[0:01] some words' end as lyrics", "cast(p_size * 10 as int) as durationSec",
    )


_CLEAN_SQL = """files as (select p_partkey as partkey, 'tp_' || substr(sha1(p_brand || '/' || p_type || '/' || p_name || ' ' || p_partkey || '.mp3'), 1, 12) as id, p_name, p_brand, p_type, p_size, p_partkey % 3 = 0 as usable, p_partkey % 4 as shape from part),
clean as (select *, case shape when 1 then p_name || ' ' || partkey when 3 then p_name || ' live' when 2 then 'HD ' || p_name else p_name end as ct,
 case when usable then p_brand when shape = 0 then p_brand else p_brand end as ca, case when usable then 'embed' when shape = 0 then 'filename' else 'path' end as asrc, shape = 1 as named,
 case when partkey % 5 = 0 then p_type when partkey % 7 = 0 then 'Music' else p_type end as al, case when partkey % 5 = 0 then 'path' else 'embed' end as alsrc from files)"""


@query("p48_clean_tracks", f"with {_CLEAN_SQL} select id, ct as \"cleanTitle\", ca as \"cleanArtist\", al as album, case when partkey % 5 <> 0 and partkey % 7 = 0 then 'unknown' else 'real' end as \"albumGroup\", shape = 3 as \"isLive\", p_size < 6 as \"isShort\", case when named then 'filename' else 'embed' end as title_source, asrc as artist_source, alsrc as album_source, case when usable then 0.9 when shape = 0 then 0.4 else 0.6 end::double as artist_confidence, partkey % 8 = 0 as timed from clean")
def _p48(spark, sf):
    t = C.clean_tracks(_files(spark, sf), "2024-01-01")
    source = lambda f: F.element_at("sourceMap", f)
    return t.select("id", "cleanTitle", "cleanArtist", "album", "albumGroup", "isLive", "isShort", source("cleanTitle").alias("title_source"), source("cleanArtist").alias("artist_source"), source("album").alias("album_source"), F.element_at("fieldConfidence", "cleanArtist").alias("artist_confidence"), F.col("lyricsHasTimeline").alias("timed"))


@query("a42_stage_counters", f"with {_CLEAN_SQL} select count(*) as done, 0::bigint as repaired, 0::bigint as promotional, count(*) filter (where named) as title_from_name, count(*) filter (where asrc = 'filename') as artist_from_title, count(*) filter (where asrc = 'path') as artist_from_path, count(*) filter (where partkey % 8 = 0) as lyrics from clean")
def _a42(spark, sf):
    return C.stage_counters(C.clean_tracks(_files(spark, sf), "2024-01-01"))


@query("a42_observed_counters", ORACLE_SQL["a42_stage_counters"])
def _a42o(spark, sf):
    # the run that writes the tracks counts them
    counts = C.write_counted(C.clean_tracks(_files(spark, sf), "2024-01-01"), work_folder(spark, "tracks"))
    return spark.createDataFrame([counts], ", ".join(f"{k} long" for k in counts))


@query("w5_best_by_strategy", f"with {WHOLE_POOLED_SQL} select track_id, source, strategy, c_cand_id from pooled qualify row_number() over (partition by track_id, source, strategy {_BEST}, query_no) = 1")
def _w5(spark, sf):
    best = L.best_candidate(_pooled(spark, sf), "track_id", "source", "strategy")
    return best.select("track_id", "source", "strategy", "c_cand_id")


@query("u5_rescored_changes", f"with {SCORED_SQL}, b as (select * from scored qualify row_number() over (partition by track_id {_BEST}) = 1), s as (select track_id, {_NAMES}[st + 1] as now, case when track_id % 4 = 0 then 'weak' else {_NAMES}[st + 1] end as stored from b) select * from s where now <> stored")
def _u5(spark, sf):
    best = L.best_candidate(_scored(spark, sf), "track_id").select("track_id", F.col("strict.tier").alias("now"))
    stored = best.select("track_id", F.when(F.col("track_id") % 4 == 0, "weak").otherwise(F.col("now")).alias("stored"))
    return best.join(stored, "track_id").where("now <> stored")


@query("j17_adjudication", f"with {SCORED_SQL}, b as (select track_id, source, {_NAMES}[st + 1] as tier from scored qualify row_number() over (partition by track_id, source {_BEST}) = 1), a as (select p_partkey as track_id, case when p_partkey % 3 = 0 then 'netease' else 'musicbrainz' end as source, p_size % 2 = 0 as ok from part) select source, tier, count(*) as n, count(*) filter (where ok) as confirmed from b join a using (track_id, source) group by 1, 2")
def _j17(spark, sf):
    best = L.best_candidate(_scored(spark, sf), "track_id", "source").select("track_id", "source", F.col("strict.tier").alias("tier"))
    audit = tables(spark, sf, "part").selectExpr("p_partkey as track_id", "case when p_partkey % 3 = 0 then 'netease' else 'musicbrainz' end as source", "p_size % 2 = 0 as ok")
    return best.join(audit, ["track_id", "source"]).groupBy("source", "tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("confirmed"))


@query("f9_usable_artist", "select p_partkey as id, p_partkey % 3 = 0 as usable from part")
def _f9(spark, sf):
    a = F.expr("case p_partkey % 3 when 0 then p_brand when 1 then 'Various Artists' else '加群' || p_brand end")
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), (~X.is_promo(a) & ~X.is_unknown(a)).alias("usable"))


@query("p23_compare_artists", "select p_partkey as id, case p_partkey % 2 when 0 then 'same' else 'different' end as verdict from part")
def _p23(spark, sf):
    b = F.expr("case p_partkey % 2 when 0 then replace(lower(p_brand), '#', '-') else p_brand || 'x' end")
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.compare_artists(F.col("p_brand"), b).alias("verdict"))


@query("s3_catalog_songs", "select p_partkey::varchar as id, p_type as genre, p_brand as artist, p_size as seconds, 2 as depth from part")
def _s3(spark, sf):
    body = F.expr("to_json(named_struct('id', cast(p_partkey as string), 'title', p_name, 'genres', array(named_struct('name', ''), named_struct('name', p_type)), 'artists', array(named_struct('name', p_brand)), 'duration', p_size + 0.2D, 'path', p_brand || '/' || p_type || '/' || p_name || '.mp3', 'suffix', 'mp3'))")
    songs = tables(spark, sf, "part").select(F.from_json(body, ingest.CATALOG_SCHEMA).alias("s")).select("s.*")
    flat = ingest.catalog_songs(songs)
    depth = (F.size(F.split("path", "/")) - 1).alias("depth")
    return flat.select("id", F.get("genres", 0).alias("genre"), F.get("artists", 0).alias("artist"), F.round("duration").cast("int").alias("seconds"), depth)


@query("s4_catalog_tags", "select p_name as title, p_brand as artist, p_type as genre, 0 as year, 2 as \"dirDepth\", 'mp3' as \"fileExt\" from part")
def _s4(spark, sf):
    songs = tables(spark, sf, "part").selectExpr(
        "p_brand || '/' || p_type || '/x.mp3' as path", "cast(null as string) as suffix", "p_name as title", "cast(null as string) as displayArtist", "p_brand as artist", "array(p_brand) as artists", "cast(null as string) as albumArtist",
        "p_type as album", "array(p_type) as genres", "cast(null as int) as year", "1 as track", "p_size + 0D as duration", "320D as bitRate", "1000D as size",
    )
    return ingest.catalog_to_tags(songs).select("title", "artist", "genre", "year", "dirDepth", "fileExt")


@query("s14_image_heads", "select p_partkey as id, case when p_partkey % 2 = 0 then 'image/png' else 'image/jpeg' end as mime, case when p_partkey % 2 = 0 then p_size else 0 end as width from part")
def _s14(spark, sf):
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex("p_size"), 8, "0")), F.unhex(F.lit("00000010")))
    content = F.when(F.col("p_partkey") % 2 == 0, png).otherwise(F.unhex(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0043")))
    s = V.sniff_image(content)
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), s["mime"].alias("mime"), s["width"].alias("width"))


@query("a41_confidence_bands", "select case when p_partkey % 10 >= 8 then '>=0.8' when p_partkey % 10 >= 6 then '0.6-0.8' else '<0.6' end as band, count(*) as n from part group by 1")
def _a41b(spark, sf):
    c = F.col("p_partkey") % 10
    return Q.first_reason(tables(spark, sf, "part"), [(">=0.8", c >= 8), ("0.6-0.8", c >= 6)], "<0.6").withColumnRenamed("reason", "band")
