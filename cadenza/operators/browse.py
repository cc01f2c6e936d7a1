"""Browse operators over a table of tracks: filters, sorts, pages, roll-ups, rankings, search and history.

Tracks carry at least id, title, cleanTitle, artist, cleanArtist, album, albumGroup, genre, mood[], scene[], lang, era, year,
durationSec, coverId, lyrics, confidence, fieldConfidence{}, sourceMap{}, isAd, isGarbled, needReview, qualityLevel, createdAt and filePath.
Every order ends in the id, so results don't depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import PSEUDO_VALUES, blank, is_pseudo

FREE_TEXT = ("title", "cleanTitle", "artist", "cleanArtist", "album")
# Weights of the fields in the overall confidence.
CONFIDENCE_WEIGHTS = {"cleanArtist": 3.0, "cleanTitle": 2.0, "year": 2.0, "genre": 2.0, "mood": 1.5, "scene": 1.0, "era": 2.0, "coverId": 1.0, "lyrics": 1.0}
ARRAYS, NUMBERS = ("mood", "scene"), ("year", "durationSec")
SORT_KEYS = {"title": "cleanTitle", "artist": "cleanArtist", "album": "album", "year": "year", "duration": "durationSec", "added": "createdAt", "confidence": "confidence", "path": "filePath"}


def _missing(name: str) -> Column:
    return is_pseudo(F.col(name), "array" if name in ARRAYS else "number" if name in NUMBERS else "string")


def display(name: str, other: str) -> Column:
    """The first of two columns that isn't a stand-in for a missing value."""
    return F.when(~_missing(name), F.col(name)).otherwise(F.when(~_missing(other), F.col(other)))


# Filters


def filter_tracks(df: DataFrame, *, q: str | None = None, genre=None, lang=None, era=None, album_group=None, quality=None, mood=None, scene=None, need_review: bool | None = None, source: str | None = None, artist: str | None = None, album: str | None = None, between: str = "") -> DataFrame:
    """Every condition given must hold. ``q`` is looked for in the free-text columns, joined by ``between``."""
    if q:
        df = df.where(F.contains(F.lower(F.concat_ws(between, *(blank(F.col(c)) for c in FREE_TEXT))), F.lit(q.lower())))
    for name, value in (("genre", genre), ("lang", lang), ("era", era), ("albumGroup", album_group), ("qualityLevel", quality)):
        if value is not None:
            df = df.where(F.col(name) == value)
    for name, value in (("mood", mood), ("scene", scene)):
        if value is not None:
            df = df.where(F.array_contains(name, value))
    if need_review is not None:
        df = df.where(F.col("needReview") == need_review)
    if source:
        df = df.where(F.exists(F.map_values("sourceMap"), lambda v: F.contains(v, F.lit(source))))
    if artist is not None:
        df = df.where(F.lower(display("cleanArtist", "artist")) == artist.lower())
    if album is not None:
        df = df.where(F.lower("album") == album.lower())
    return df


def filter_albums(albums: DataFrame, q: str | None = None, artist: str | None = None, real_only: bool = False) -> DataFrame:
    if q:
        albums = albums.where(F.contains(F.lower(F.concat(blank(F.col("album")), blank(F.col("artist")))), F.lit(q.lower())))
    if artist is not None:
        albums = albums.where(F.lower("artist") == artist.lower())
    return albums.where(F.col("album") != "unknown") if real_only else albums


def filter_artists(artists: DataFrame, q: str) -> DataFrame:
    return artists.where(F.contains(F.lower("name"), F.lit(q.lower())))


def filter_logs(logs: DataFrame, level: str = "debug", q: str | None = None, tail: int | None = 200) -> DataFrame:
    """Log rows (t, level, mod, msg, fields) of a level or worse, with a keyword in any field, the newest ``tail`` of them."""
    ranks = {"debug": 0, "info": 1, "warn": 2, "error": 3}
    rank = F.coalesce(*(F.when(F.col("level") == k, v) for k, v in ranks.items()), F.lit(1))
    logs = logs.where(rank >= ranks.get(level, 0))
    if q:
        logs = logs.where(F.contains(F.lower(F.to_json(F.struct("level", "mod", "msg", "fields"))), F.lit(q.lower())))
    n = 200 if not isinstance(tail, int) or tail < 0 else min(tail, 2000)
    return logs.orderBy(F.desc("t"), "mod", "msg").limit(n)


# Sorts and pages


def sort_tracks(df: DataFrame, key: str = "title", descending: bool = False, collation: str | None = None) -> DataFrame:
    c = F.col(SORT_KEYS.get(key, key))
    if key in ARRAYS:
        c = F.array_join(c, ",")
    if collation:
        c = F.collate(c, collation)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "id")


def clamp_page(limit: int | None = None, offset: int | None = None, page: int | None = None, default: int = 50) -> tuple[int, int]:
    """(limit within 1 to 200, offset); a page number goes before an offset."""
    n = max(1, min(200, default if limit is None else limit))
    return n, max(0, (page - 1) * n if page is not None and page >= 1 else offset or 0)


def take_page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    return df.offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: total, limit, offset, hasMore."""
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.col("total") > offset + limit).alias("hasMore"))


def page_after(df: DataFrame, key: str, value, last_id, limit: int) -> DataFrame:
    """The page behind a row of which the sort value and id are known: deep pages without reading those before them."""
    c = F.col(SORT_KEYS.get(key, key))
    return df.where((c > value) | ((c == value) & (F.col("id") > last_id))).orderBy(c, "id").limit(limit)


def shuffled(df: DataFrame, seed: str, id_column: str = "id") -> DataFrame:
    """An order that the seed and the ids decide."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(id_column).cast("string"))), id_column)


# Quality of a row


def quality_level(confidence: str = "confidence") -> Column:
    """high: five of six core fields and confidence of 0.8; medium: three; else low."""
    artist = ~_missing("cleanArtist") | ~_missing("artist")
    filled = sum((x.cast("int") for x in (artist, *(~_missing(c) for c in ("era", "genre", "mood", "coverId", "lyrics")))), F.lit(0))
    return F.when((filled >= 5) & (F.coalesce(F.col(confidence), F.lit(0.0)) >= 0.8), "high").when(filled >= 3, "medium").otherwise("low")


def need_review(confidence: str = "confidence") -> Column:
    conflict = F.exists(F.map_entries("fieldConfidence"), lambda e: e["key"].endswith("Conflict") & (e["value"] > 0))
    return (
        (F.coalesce(F.col(confidence), F.lit(0.0)) < 0.6) | F.coalesce(F.col("isAd"), F.lit(False)) | F.coalesce(F.col("isGarbled"), F.lit(False)) | F.coalesce(conflict, F.lit(False))
        | (_missing("cleanArtist") & _missing("artist")) | _missing("era") | (F.col("era") == "未知") | _missing("genre")
    )


def overall_confidence() -> Column:
    """Mean of the filled fields' confidences by weight, 0.5 where unknown, to 3 decimals; 0 without any."""
    total = weight = F.lit(0.0)
    for name, w in CONFIDENCE_WEIGHTS.items():
        filled = ~_missing(name)
        known = F.coalesce(F.element_at("fieldConfidence", name), F.lit(0.5))
        total, weight = total + F.when(filled, known * w).otherwise(0.0), weight + F.when(filled, w).otherwise(0.0)
    return F.when(weight > 0, F.round(total / weight, 3)).otherwise(F.lit(0.0))


def review_reasons() -> Column:
    rules = {
        "low confidence": F.coalesce(F.col("confidence"), F.lit(0.0)) < 0.6, "promotional": F.col("isAd"), "garbled": F.col("isGarbled"),
        "no artist": _missing("cleanArtist") & _missing("artist"), "no era": _missing("era") | (F.col("era") == "未知"), "no genre": _missing("genre"),
    }
    return F.array_join(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items()))), " / ")


def review_queue(df: DataFrame) -> DataFrame:
    """Rows that need review with their reasons, least confident first."""
    return df.where("needReview").withColumn("reason", review_reasons()).orderBy(F.asc_nulls_first("confidence"), "id")


# Roll-ups


def facets(df: DataFrame) -> DataFrame:
    """dim, value, n for five dimensions in one pass; array elements count one by one."""
    entry = lambda dim, value: F.struct(F.lit(dim).alias("dim"), value.alias("value"))
    single = F.array(*(entry(d, F.col(d)) for d in ("genre", "lang", "era")))
    elements = lambda dim: F.transform(dim, lambda v: entry(dim, v))
    several = [elements(d) for d in ARRAYS]
    flat = df.select(F.explode(F.concat(single, *(F.coalesce(s, F.filter(single, lambda _: F.lit(False))) for s in several))).alias("e")).select("e.dim", "e.value")
    return flat.where(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"))


COVERED = ("cleanTitle", "cleanArtist", "album", "year", "genre", "mood", "scene", "era", "coverId", "lyrics")


def coverage(df: DataFrame) -> DataFrame:
    """metric, n, percent: filled fields, quality levels and rows to review, in one pass."""
    level = quality_level()
    counts = {f"filled:{c}": ~_missing(c) for c in COVERED} | {f"quality:{q}": level == q for q in ("high", "medium", "low")} | {"review": need_review()}
    one = df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(v).alias(k) for k, v in counts.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("n")) for k in counts)))
    return one.select("total", pairs.alias("p")).select("p.metric", "p.n", F.round(100 * F.col("p.n") / F.greatest(F.lit(1), F.col("total")), 1).alias("percent"))


def _first_filled(name: str) -> Column:
    """The first non-empty value in the order of the paths."""
    return F.min_by(F.when(~_missing(name), F.col(name)), F.when(~_missing(name), F.struct("filePath", "id")))


def albums(df: DataFrame) -> DataFrame:
    """One row per real album, and one for all other tracks."""
    key = F.when((F.col("albumGroup") == "real") & ~_missing("album"), F.col("album")).otherwise(F.lit("unknown"))
    out = df.withColumn("_album", key).withColumn("_artist", display("cleanArtist", "artist"))
    first_artist = F.min_by("_artist", F.when(F.col("_artist").isNotNull(), F.struct("filePath", "id")))
    return out.groupBy(F.col("_album").alias("album")).agg(
        F.count(F.lit(1)).alias("tracks"), _first_filled("coverId").alias("coverId"), _first_filled("year").alias("year"), first_artist.alias("artist"), F.max("createdAt").alias("addedAt")
    )


def artists(df: DataFrame) -> DataFrame:
    name = F.coalesce(display("cleanArtist", "artist"), F.lit("unknown"))
    real = F.when((F.col("albumGroup") == "real") & ~_missing("album"), F.col("album"))
    return df.withColumn("name", name).groupBy("name").agg(F.count(F.lit(1)).alias("tracks"), F.count_distinct(real).alias("albums"), _first_filled("coverId").alias("coverId"))


def genres(df: DataFrame) -> DataFrame:
    return df.where(~_missing("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("tracks"), _first_filled("coverId").alias("coverId"))


def playlists(df: DataFrame, vocabulary: DataFrame, least: int = 3) -> DataFrame:
    """dim, value, ord, tracks of vocabulary values (dim, value, ord) with at least ``least`` tracks."""
    counts = facets(df).where(F.col("n") >= least)
    return counts.join(vocabulary, ["dim", "value"]).select("dim", "value", "ord", F.col("n").alias("tracks"))


def library_stats(df: DataFrame) -> DataFrame:
    name = display("cleanArtist", "artist")
    real = F.when((F.col("albumGroup") == "real") & ~_missing("album"), F.col("album"))
    return df.agg(
        F.count(F.lit(1)).alias("tracks"), F.count_distinct(name).alias("artists"), F.count_distinct(real).alias("albums"), F.count_distinct(F.when(~_missing("genre"), F.col("genre"))).alias("genres"),
        F.count_if(~_missing("coverId")).alias("covers"), F.count_if(~_missing("lyrics")).alias("lyrics"), F.coalesce(F.sum("durationSec"), F.lit(0)).alias("seconds"),
    )


def sort_albums(df: DataFrame, by: str = "tracks") -> DataFrame:
    return df.orderBy(F.desc(by) if by in ("tracks", "addedAt", "year") else F.asc(by), "album")


# Blocks, search and details


def home_blocks(tracks: DataFrame, plays: DataFrame, favorites: DataFrame, seed: str, n: int = 10) -> DataFrame:
    """block, rank, item: random, newest, last played and favourite tracks, and the newest albums."""

    def block(name: str, df: DataFrame, item: str, *order: Column) -> DataFrame:
        top = df.orderBy(*order, item).limit(n)
        rank = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order, item))  # of at most n rows
        return top.select(F.lit(name).alias("block"), rank.alias("rank"), F.col(item).alias("item"))

    last = distinct_history(plays).join(tracks.select(F.col("id").alias("track_id")), "track_id")
    liked = favorites.join(tracks.select(F.col("id").alias("track_id")), "track_id")
    parts = [
        block("random", tracks, "id", F.md5(F.concat(F.lit(seed), "id"))), block("newest", tracks, "id", F.desc("createdAt")), block("played", last, "track_id", F.desc("played_at")),
        block("favorites", liked, "track_id", F.desc("added_at")), block("albums", albums(tracks).where("album <> 'unknown'"), "album", F.desc("addedAt")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search(tracks: DataFrame, q: str, lists: DataFrame | None = None) -> DataFrame:
    """type, rank, item, total: the first tracks, artists, albums and playlists that hold ``q``, with the totals."""
    found = [("track", filter_tracks(tracks, q=q), "id", 10), ("artist", filter_artists(artists(tracks), q), "name", 8), ("album", filter_albums(albums(tracks), q, real_only=True), "album", 8)]
    if lists is not None:
        found.append(("playlist", lists.where(F.contains(F.lower("value"), F.lit(q.lower()))), "value", 8))
    out = None
    for kind, df, item, n in found:
        total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("type", F.lit(kind))
        rank = F.row_number().over(Window.partitionBy("type").orderBy("item"))
        top = df.select(F.lit(kind).alias("type"), F.col(item).alias("item")).orderBy("item").limit(n).withColumn("rank", rank)
        part = top.join(total, "type").select("type", "rank", "item", "total")
        out = part if out is None else out.unionByName(part)
    return out


def members(tracks: DataFrame, kind: str, name: str) -> DataFrame:
    """Tracks of an album, artist, genre or playlist."""
    if kind == "album":
        return tracks.where((F.col("albumGroup") == "real") & (F.col("album") == name))
    if kind == "artist":
        return tracks.where(F.coalesce(display("cleanArtist", "artist"), F.lit("unknown")) == name)
    if kind == "genre":
        return tracks.where(F.col("genre") == name)
    return tracks.where(F.array_contains("mood", name) | F.array_contains("scene", name) | (F.col("genre") == name))


# History and favourites


def distinct_history(plays: DataFrame) -> DataFrame:
    """track_id, played_at (latest), duration_sec of that play, plays."""
    latest = F.max_by("duration_sec", F.struct("played_at", "duration_sec"))
    return plays.groupBy("track_id").agg(F.max("played_at").alias("played_at"), latest.alias("duration_sec"), F.count(F.lit(1)).alias("plays"))


def newest(df: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """The newest ``n`` rows; Spark keeps n rows of each partition, not all of them in one."""
    return df.orderBy(F.desc(order), *ties).limit(n)


def favorites_list(favorites: DataFrame, tracks: DataFrame) -> DataFrame:
    """Favourites that still exist."""
    return favorites.join(tracks, favorites["track_id"] == tracks["id"]).drop("track_id")


def history_list(plays: DataFrame, tracks: DataFrame, distinct: bool = False) -> DataFrame:
    rows = distinct_history(plays) if distinct else plays
    return rows.join(tracks, rows["track_id"] == tracks["id"]).drop("track_id")


def user_counts(favorites: DataFrame, plays: DataFrame) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in (("favorites", favorites), ("plays", plays))]
    return parts[0].unionByName(parts[1])


def last_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The latest row of each run, of the last ``n`` runs."""
    one = runs.withColumn("_r", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("started"), F.desc("version")))).where("_r = 1").drop("_r")
    return one.orderBy(F.desc("started"), "run_id").limit(n)


def resolve_ids(asked: DataFrame, tracks: DataFrame) -> DataFrame:
    """asked (ref) with the track it names: by id, else by a legacy id, else by "duration|file name"; first by path."""
    first = lambda df: df.groupBy("ref").agg(F.min_by("id", F.struct("filePath", "id")).alias("id"))
    legacy = first(tracks.select(F.explode("legacyIds").alias("ref"), "id", "filePath")).withColumnRenamed("id", "by_legacy")
    names = F.concat_ws("|", F.col("durationSec").cast("string"), "fileName")
    named = first(tracks.select(names.alias("ref"), "id", "filePath")).withColumnRenamed("id", "by_name")
    own = tracks.select(F.col("id").alias("ref"), F.col("id").alias("by_id"))
    return asked.join(own, "ref", "left").join(legacy, "ref", "left").join(named, "ref", "left").select("ref", F.coalesce("by_id", "by_legacy", "by_name").alias("id"))


def pseudo_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stand-in strings as nulls."""
    return df.withColumns({c: F.when(~F.trim(F.col(c)).isin(*PSEUDO_VALUES), F.col(c)) for c in columns})
