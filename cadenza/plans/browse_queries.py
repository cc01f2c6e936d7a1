"""Queries of the browse operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.text import blank
from cadenza.operators import browse as B
from cadenza.operators import merge as M
from cadenza.operators import substring as S
from cadenza.plans.registry import ORACLE_SQL, query
from cadenza.plans.views import FAVORITES_SQL, PLAYS_SQL, TRACKS_SQL, favorites, plays, tables, tracks
from cadenza.sources.shared import path_exists

LITE = ("id", "title", "artist", "album", "year", "durationSec")
_LITE = ", ".join(f'"{c}"' for c in LITE)


def _tracks(body: str, *more: str) -> str:
    return f"with {', '.join((TRACKS_SQL, *more))} {body}"


_NAME = "coalesce(nullif(cleanArtist, ''), artist)"
_REAL = "case when albumGroup = 'real' and album <> '' then album end"


@query("f1_catalog_filter", _tracks(f"select {_LITE} from tracks where contains(lower(title || cleanTitle || artist || coalesce(cleanArtist, '') || album), 'ring') and genre = 'SMALL' and list_contains(mood, 'red') and not needReview and contains(src, 'netease')"))
def _f1(spark, sf):
    return B.filter_tracks(tracks(spark, sf), q="RING", genre="SMALL", mood="red", need_review=False, source="netease").select(*LITE)


@query("f2_artist_album_filter", _tracks(f"select {_LITE} from tracks where lower({_NAME}) = 'brand#19' and lower(album) = 'medium 6'"))
def _f2(spark, sf):
    return B.filter_tracks(tracks(spark, sf), artist="BRAND#19", album="medium 6").select(*LITE)


_ALBUMS = f"""albums as (select coalesce({_REAL}, 'unknown') as album, count(*) as tracks, arg_min(nullif(coverId, ''), filePath || id) filter (where coverId <> '') as "coverId",
 arg_min(year, filePath || id) filter (where year <> 0) as year, arg_min({_NAME}, filePath || id) as artist, max(createdAt) as "addedAt" from tracks group by 1)"""


@query("f3_album_filter", _tracks("select * from albums where contains(lower(album || artist), 'promo') and album <> 'unknown'", _ALBUMS))
def _f3(spark, sf):
    return B.filter_albums(B.albums(tracks(spark, sf)), q="Promo", real_only=True)


_ARTISTS = f"""artists as (select {_NAME} as name, count(*) as tracks, count(distinct {_REAL}) as albums, arg_min(coverId, filePath || id) filter (where coverId <> '') as "coverId" from tracks group by 1)"""


@query("f4_artist_filter", _tracks("select * from artists where contains(lower(name), '#1')", _ARTISTS))
def _f4(spark, sf):
    return B.filter_artists(B.artists(tracks(spark, sf)), "#1")


@query("f5_log_filter", "select epoch_us(ts) as t, case event_type when 'error' then 'error' when 'signup' then 'warn' else 'info' end as level, event_type as mod, props as msg from events where event_type in ('error', 'signup') and contains(props, '7') order by ts desc limit 300")
def _f5(spark, sf):
    logs = tables(spark, sf, "events").selectExpr("unix_micros(cast(ts as timestamp)) as t", "case event_type when 'error' then 'error' when 'signup' then 'warn' else 'info' end as level", "event_type as mod", "props as msg", "map('k', '') as fields")
    return B.filter_logs(logs, "warn", "7", 300).select("t", "level", "mod", "msg")


@query("f11_sampled_rows", _tracks("select id, artist from tracks where partkey % 9 = 0"))
def _f11(spark, sf):
    staged = tracks(spark, sf).withColumn("scrapeStage", F.expr("case when partkey % 9 = 0 then 'L2_done' else 'L1_only' end"))
    return staged.where("scrapeStage <> 'L1_only'").select("id", "artist")


@query("o1_catalog_sort", _tracks(f"select {_LITE} from tracks order by artist desc, id limit 500"))
def _o1(spark, sf):
    return tracks(spark, sf).orderBy(F.desc("artist"), "id").limit(500).select(*LITE)


@query("o2_sort_key", _tracks(f"select {_LITE} from tracks order by year desc, id limit 400"))
def _o2(spark, sf):
    return B.sort_tracks(tracks(spark, sf), "year", True).limit(400).select(*LITE)


@query("o3_album_sort", _tracks("select * from albums order by tracks desc, album limit 20", _ALBUMS))
def _o3(spark, sf):
    return B.sort_albums(B.albums(tracks(spark, sf)), "tracks").limit(20)


@query("o4_page", _tracks(f"select {_LITE} from tracks order by cleanTitle, id limit 200 offset 400"))
def _o4(spark, sf):
    limit, offset = B.clamp_page(500, None, 3)
    return B.take_page(B.sort_tracks(tracks(spark, sf), "title"), limit, offset).select(*LITE)


@query("o4_page_info", _tracks("select count(*) as total, 200 as \"limit\", 400 as \"offset\", count(*) > 600 as \"hasMore\" from tracks"))
def _o4i(spark, sf):
    return B.page_info(tracks(spark, sf), *B.clamp_page(500, None, 3))


@query("o4_page_after", _tracks(f"select {_LITE} from tracks where year > 1990 or (year = 1990 and id > 'tp_5') order by year, id limit 50"))
def _o4a(spark, sf):
    return B.page_after(tracks(spark, sf), "year", 1990, "tp_5", 50).select(*LITE)


@query("o5_seeded_order", _tracks("select id, title from tracks order by md5('s7' || id), id limit 100"))
def _o5(spark, sf):
    return B.shuffled(tracks(spark, sf), "s7").limit(100).select("id", "title")


@query(
    "o6_home_blocks",
    _tracks(
        """, last as (select track_id, max(played_at) as p from plays group by 1),
 blocks as (select 'random' as block, row_number() over (order by md5('day1' || id), id) as rank, id as item from tracks
 union all select 'newest', row_number() over (order by createdAt desc, id), id from tracks
 union all select 'played', row_number() over (order by p desc, track_id), track_id from last
 union all select 'favorites', row_number() over (order by added_at desc, track_id), track_id from favorites
 union all select 'albums', row_number() over (order by "addedAt" desc, album), album from albums where album <> 'unknown')
 select * from blocks where rank <= 10""".lstrip(", "),
        PLAYS_SQL, FAVORITES_SQL, _ALBUMS + ", __",
    ).replace(", __ last", ", last"),
)
def _o6(spark, sf):
    return B.home_blocks(tracks(spark, sf), plays(spark, sf), favorites(spark, sf), "day1")


@query(
    "o7_search",
    _tracks(
        f"""select * from (select 'track' as type, row_number() over (order by id) as rank, id as item, count(*) over () as total from tracks where contains(lower(title || cleanTitle || artist || coalesce(cleanArtist, '') || album), 'brand#2') qualify rank <= 10
 union all select 'artist', row_number() over (order by name) r, name, count(*) over () from artists where contains(lower(name), 'brand#2') qualify r <= 8
 union all select 'album', row_number() over (order by album) r, album, count(*) over () from albums where contains(lower(album || artist), 'brand#2') and album <> 'unknown' qualify r <= 8)""",
        _ARTISTS, _ALBUMS,
    ),
)
def _o7(spark, sf):
    return B.search(tracks(spark, sf), "Brand#2")


@query("o8_album_members", _tracks(f"select {_LITE} from tracks where albumGroup = 'real' and album = 'SMALL 3'"))
def _o8(spark, sf):
    return B.members(tracks(spark, sf), "album", "SMALL 3").select(*LITE)


@query("o8_artist_members", _tracks(f"select {_LITE} from tracks where {_NAME} = 'Brand#7'"))
def _o8a(spark, sf):
    return B.members(tracks(spark, sf), "artist", "Brand#7").select(*LITE)


@query("o8_playlist_members", _tracks(f"select {_LITE} from tracks where list_contains(mood, 'red') or list_contains(scene, 'red') or genre = 'red'"))
def _o8p(spark, sf):
    return B.members(tracks(spark, sf), "playlist", "red").select(*LITE)


_REASON = """concat_ws(' / ', case when confidence < 0.6 then 'low confidence' end, case when isAd then 'promotional' end, case when isGarbled then 'garbled' end, case when era = '未知' then 'no era' end, case when genre is null then 'no genre' end)"""


@query("o9_review_queue", _tracks(f"select id, confidence, {_REASON} as reason from tracks where needReview"))
def _o9(spark, sf):
    return B.review_queue(tracks(spark, sf)).select("id", "confidence", "reason")


_FACETS = """facets as (select dim, value, count(*) as n from (select 'genre' as dim, genre as value from tracks union all select 'lang', lang from tracks union all select 'era', era from tracks
 union all select 'mood', unnest(mood) from tracks union all select 'scene', unnest(scene) from tracks) where value is not null and value <> '' group by all)"""


@query("a1_facets", _tracks("select * from facets", _FACETS))
def _a1(spark, sf):
    return B.facets(tracks(spark, sf))


_LEVEL = """case when 1 + 1 + (genre is not null)::int + 1 + (coverId <> '')::int + (lyrics is not null)::int >= 5 and confidence >= 0.8 then 'high'
 when 1 + 1 + (genre is not null)::int + 1 + (coverId <> '')::int + (lyrics is not null)::int >= 3 then 'medium' else 'low' end"""
_REVIEW = "(confidence < 0.6 or isAd or isGarbled or era = '未知' or genre is null)"


@query(
    "a2_coverage",
    _tracks(
        f"""select metric, n, round(100.0 * n / (select greatest(1, count(*)) from tracks), 1) as percent from (select unnest([
 {{'metric': 'filled:cleanTitle', 'n': count(*)}}, {{'metric': 'filled:cleanArtist', 'n': count(cleanArtist)}}, {{'metric': 'filled:album', 'n': count(*) filter (where album <> '')}}, {{'metric': 'filled:year', 'n': count(*) filter (where year <> 0)}},
 {{'metric': 'filled:genre', 'n': count(genre)}}, {{'metric': 'filled:mood', 'n': count(*)}}, {{'metric': 'filled:scene', 'n': count(*)}}, {{'metric': 'filled:era', 'n': count(*)}}, {{'metric': 'filled:coverId', 'n': count(*) filter (where coverId <> '')}},
 {{'metric': 'filled:lyrics', 'n': count(lyrics)}}, {{'metric': 'quality:high', 'n': count(*) filter (where {_LEVEL} = 'high')}}, {{'metric': 'quality:medium', 'n': count(*) filter (where {_LEVEL} = 'medium')}},
 {{'metric': 'quality:low', 'n': count(*) filter (where {_LEVEL} = 'low')}}, {{'metric': 'review', 'n': count(*) filter (where {_REVIEW})}}], recursive := true) from tracks)"""
    ),
)
def _a2(spark, sf):
    return B.coverage(tracks(spark, sf))


@query("a3_quality_level", _tracks(f"select id, {_LEVEL} as level from tracks"))
def _a3(spark, sf):
    return tracks(spark, sf).select("id", B.quality_level().alias("level"))


@query("a4_need_review", _tracks(f"select id, {_REVIEW} as review from tracks"))
def _a4(spark, sf):
    return tracks(spark, sf).select("id", B.need_review().alias("review"))


_CONFIDENCE = """round(((cleanArtist is not null)::int * 0.9 * 3 + 0.5 * 2 + (year <> 0)::int * 0.5 * 2 + (genre is not null)::int * 0.7 * 2 + 0.5 * 1.5 + 0.5 + 0.5 * 2 + (coverId <> '')::int * 0.5 + (lyrics is not null)::int * 0.5)::double
 / ((cleanArtist is not null)::int * 3 + 2 + (year <> 0)::int * 2 + (genre is not null)::int * 2 + 1.5 + 1 + 2 + (coverId <> '')::int + (lyrics is not null)::int)::double, 3)"""


@query("a5_overall_confidence", _tracks(f"select id, {_CONFIDENCE} as confidence from tracks"))
def _a5(spark, sf):
    return tracks(spark, sf).select("id", B.overall_confidence().alias("confidence"))


@query("m12_finalize", _tracks(f"select id, confidence, {_LEVEL} as \"qualityLevel\", {_REVIEW} as \"needReview\", '2024-01-01' as \"updatedAt\" from done", f"done as (select * exclude (confidence), {_CONFIDENCE} as confidence from tracks)"))
def _m12(spark, sf):
    return M.finalize(tracks(spark, sf), "2024-01-01").select("id", "confidence", "qualityLevel", "needReview", "updatedAt")


@query("a6_album_rollup", _tracks("select * from albums", _ALBUMS))
def _a6(spark, sf):
    return B.albums(tracks(spark, sf))


@query("a7_artist_rollup", _tracks("select * from artists", _ARTISTS))
def _a7(spark, sf):
    return B.artists(tracks(spark, sf))


@query("a8_genre_rollup", _tracks("select genre, count(*) as tracks, arg_min(coverId, filePath || id) filter (where coverId <> '') as \"coverId\" from tracks where genre is not null group by 1"))
def _a8(spark, sf):
    return B.genres(tracks(spark, sf))


@query("a9_system_playlists", _tracks("select dim, value, row_number() over (partition by dim order by value) as ord, n as tracks from facets where dim in ('mood', 'scene') and n >= 3", _FACETS))
def _a9(spark, sf):
    t = tracks(spark, sf)
    words = t.select(F.lit("mood").alias("dim"), F.explode("mood").alias("value")).union(t.select(F.lit("scene"), F.explode("scene"))).distinct()
    vocabulary = words.withColumn("ord", F.row_number().over(Window.partitionBy("dim").orderBy("value")))
    return B.playlists(t, vocabulary)


@query(
    "a10_library_stats",
    _tracks(f"select count(*) as tracks, count(distinct {_NAME}) as artists, count(distinct {_REAL}) as albums, count(distinct genre) as genres, count(*) filter (where coverId <> '') as covers, count(lyrics) as lyrics, sum(durationSec)::bigint as seconds from tracks"),
)
def _a10(spark, sf):
    return B.library_stats(tracks(spark, sf))


_HISTORY = "history as (select track_id, max(played_at) as played_at, arg_max(duration_sec, (played_at, duration_sec)) as duration_sec, count(*) as plays from plays group by 1)"


@query("a14_distinct_history", f"with {PLAYS_SQL}, {_HISTORY} select * from history")
def _a14(spark, sf):
    return B.distinct_history(plays(spark, sf))


@query("a15_user_counts", f"with {PLAYS_SQL}, {FAVORITES_SQL} select 'favorites' as kind, count(*) as n from favorites union all select 'plays', count(*) from plays")
def _a15(spark, sf):
    return B.user_counts(favorites(spark, sf), plays(spark, sf))


@query("j9_id_resolution", _tracks(", asked as (select case o_orderkey % 4 when 0 then 'tp_' || (o_orderkey % 2500) when 1 then 'old_' || (o_orderkey % 2500) when 2 then '110|red ring ' || (o_orderkey % 2500) || '.mp3' else 'none' end as ref from orders group by 1) select a.ref, coalesce(t.id, l.id, n.id) as id from asked a left join tracks t on t.id = a.ref left join tracks l on l.legacy = a.ref left join tracks n on n.durationSec || '|' || n.fileName = a.ref".lstrip(", "), "__").replace(", __ asked", ", asked"))
def _j9(spark, sf):
    asked = tables(spark, sf, "orders").selectExpr("case o_orderkey % 4 when 0 then 'tp_' || (o_orderkey % 2500) when 1 then 'old_' || (o_orderkey % 2500) when 2 then '110|red ring ' || (o_orderkey % 2500) || '.mp3' else 'none' end as ref").distinct()
    return B.resolve_ids(asked, tracks(spark, sf))


@query("j12_favorites_list", _tracks("select id, title, added_at from favorites join tracks on track_id = id", FAVORITES_SQL))
def _j12(spark, sf):
    return B.favorites_list(favorites(spark, sf), tracks(spark, sf)).select("id", "title", "added_at")


@query("j13_history_distinct", _tracks("select id, title, played_at, plays from history join tracks on track_id = id", PLAYS_SQL, _HISTORY))
def _j13(spark, sf):
    return B.history_list(plays(spark, sf), tracks(spark, sf), True).select("id", "title", "played_at", "plays")


@query("j13_history_raw", _tracks("select id, title, played_at from plays join tracks on track_id = id where genre = 'PROMO'", PLAYS_SQL))
def _j13r(spark, sf):
    return B.history_list(plays(spark, sf), tracks(spark, sf).where("genre = 'PROMO'")).select("id", "title", "played_at")


@query("w8_newest_plays", f"with {PLAYS_SQL} select track_id, played_at, event, line from plays order by played_at desc, event, line limit 5000")
def _w8(spark, sf):
    return B.newest(plays(spark, sf), "played_at", 5000, "event", "line").select("track_id", "played_at", "event", "line")


@query("w9_last_runs", "with r as (select o_custkey as run_id, o_orderdate as started, o_orderkey as version from orders), l as (select * from r qualify row_number() over (partition by run_id order by started desc, version desc) = 1) select * from l order by started desc, run_id limit 20")
def _w9(spark, sf):
    return B.last_runs(tables(spark, sf, "orders").selectExpr("o_custkey as run_id", "o_orderdate as started", "o_orderkey as version"))


@query("p8_pseudo_to_null", _tracks("select id, nullif(album, '') as album, nullif(coverId, '') as \"coverId\" from tracks"))
def _p8(spark, sf):
    return B.pseudo_to_null(tracks(spark, sf), ["album", "coverId"]).select("id", "album", "coverId")


@query("p43_lite_projection", _tracks(f"select id, coalesce(nullif(cleanTitle, ''), title) as title, {_NAME} as artist, case when coverId <> '' then '/cover/' || coverId end as cover, durationSec as \"durationSec\" from tracks"))
def _p43(spark, sf):
    return tracks(spark, sf).select("id", B.display("cleanTitle", "title").alias("title"), B.display("cleanArtist", "artist").alias("artist"), F.when(F.col("coverId") != "", F.concat(F.lit("/cover/"), "coverId")).alias("cover"), "durationSec")


# Substring search by a stored index

#: Indexes that this process has stored: (application, what, folder of the tables) -> index.
_INDEXES: dict[tuple[str, str, str], S.SearchIndex] = {}
_FREE = "lower(title || cleanTitle || artist || coalesce(cleanArtist, '') || album)"


def _index(spark, sf: str, what: str) -> S.SearchIndex:
    known = (spark.sparkContext.applicationId, what, sf)
    found = _INDEXES.get(known)
    if found is None or not path_exists(spark, f"{found.grams}/_SUCCESS"):
        joined = lambda *names: F.concat(*(blank(F.col(c)) for c in names))
        build = {
            "tracks": lambda: S.build_search_index(tracks(spark, sf), joined(*B.FREE_TEXT), ["artist", "album", "title", "id"]),
            "artists": lambda: S.build_search_index(B.artists(tracks(spark, sf)), F.col("name"), ["name"]),
            "albums": lambda: S.build_search_index(B.albums(tracks(spark, sf)), joined("album", "artist"), ["album"]),
        }
        found = _INDEXES[known] = build[what]()
    return found


@query("f1_indexed_filter", _tracks(f"select {_LITE} from tracks where contains({_FREE}, '1medium') and contains(src, 'netease')"))
def _f1i(spark, sf):
    # the text searched runs from the artist into the album
    found = S.search_index(spark, _index(spark, sf, "tracks"), "1MEDIUM")
    return B.filter_tracks(found, source="netease").select(*LITE)


@query("f1_indexed_short", _tracks(f"select {_LITE} from tracks where contains({_FREE}, '7e')"))
def _f1s(spark, sf):
    return S.search_index(spark, _index(spark, sf, "tracks"), "7E").select(*LITE)


@query("f1_index_blocks", _tracks(f"select artist, count(*) as found from tracks where contains({_FREE}, 'brand#3') group by 1"))
def _f1b(spark, sf):
    # the blocks that the bitmaps name hold every row found
    index = _index(spark, sf, "tracks")
    named = index.table(spark).join(S.blocks_of(spark, index, "Brand#3"), ["_zone", "_block"], "left_semi")
    return named.where(F.contains(F.lower(index.text), F.lit("brand#3"))).groupBy("artist").agg(F.count(F.lit(1)).alias("found"))


@query("o7_indexed_search", ORACLE_SQL["o7_search"].replace("brand#2", "brand#3"))
def _o7i(spark, sf):
    hits = {what: S.search_index(spark, _index(spark, sf, what), "Brand#3") for what in ("tracks", "artists", "albums")}
    pages = [S.page_of(hits["tracks"], "track", "id", 10), S.page_of(hits["artists"], "artist", "name", 8), S.page_of(hits["albums"].where("album <> 'unknown'"), "album", "album", 8)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])
