"""The cleaning job: files with their tags to tracks with cleaned fields, flags and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions.values import stable_id, year_to_era
from cadenza.operators.merge import finalize
from cadenza.sources.shared import dealt

LEAST_LYRICS = 10


def clean_tracks(files: DataFrame, updated_at, path_depth: int = 2) -> DataFrame:
    """files (filePath, fileName, dirDepth, title, artist, album, year, lyrics, durationSec) with the cleaned columns.

    Added: id, cleanTitle, cleanArtist, albumIsPlaceholder, albumGroup, era, lyricsHasTimeline, lyricsSource, the content flags,
    isShort, isAd, isGarbled, sourceMap, fieldConfidence, and what ``finalize`` adds. Broken encodings are repaired
    first. A title comes from the file name if there is none, an artist from the title's other side, then from the path.
    mood, scene, genre and coverId are empty if ``files`` doesn't have them.
    """
    for name, kind in (("mood", "array<string>"), ("scene", "array<string>"), ("genre", "string"), ("coverId", "string")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    raw = {c: F.col(c) for c in ("title", "artist", "album")}
    df = dealt(files).withColumns({f"_{c}": F.trim(X.blank(X.repair_mojibake(v))) for c, v in raw.items()})
    garbled = [F.coalesce(F.col(f"_{c}") != F.trim(X.blank(v)), F.lit(False)) for c, v in raw.items()]
    named = F.col("_title") == ""
    usable = ~X.is_pseudo_artist(F.col("_artist")) & ~X.is_promo(F.col("_artist"))
    df = df.withColumns({
        "id": stable_id(F.col("filePath"), "tp_"), "isGarbled": garbled[0] | garbled[1] | garbled[2], "isAd": X.is_promo(F.col("_title")) | X.is_promo(F.col("_artist")) | X.is_promo(F.col("_album")),
        "_named": named, "title": F.when(named, X.strip_extension(F.col("fileName"))).otherwise(F.col("_title")), "_usable": F.when(usable, F.col("_artist")).otherwise(F.lit("")),
    })
    df = df.withColumn("_split", X.split_title(F.col("title"), F.col("_usable"))).withColumn("_path", X.infer_from_path(F.col("filePath"), F.col("dirDepth"), path_depth))
    first = F.coalesce(F.get("_split.titles", 0), F.col("title"))
    bare = X.strip_trailing_groups(X.strip_leading_groups(X.strip_track_number(first)))
    guessed = F.get("_split.artists", 0)
    album = F.when(~X.is_pseudo(F.col("_album")), F.col("_album"))
    lyrics = X.sanitize_lyrics(F.col("lyrics"))
    has_lyrics = F.char_length(F.trim(X.blank(F.col("lyrics")))) > LEAST_LYRICS
    sources = {
        "cleanTitle": F.when(F.col("_named"), "filename").otherwise("embed"),
        "cleanArtist": F.when(F.col("_usable") != "", "embed").when(guessed.isNotNull(), "filename").when(F.col("_path.artist").isNotNull(), "path"),
        "album": F.when(album.isNotNull(), "embed").when(F.col("_path.album").isNotNull(), "path"),
        "year": F.when(F.col("year") > 0, "embed"), "era": F.when(F.col("year") > 0, "embed"), "lyrics": F.when(has_lyrics, "embed"),
    }
    placeholder = X.is_placeholder_album(album)
    trust = {
        "cleanTitle": F.when(F.col("_named"), 0.4).otherwise(0.7),
        "cleanArtist": F.when(F.col("_usable") != "", 0.9).when(guessed.isNotNull(), 0.4).otherwise(0.6),
        "album": F.when(album.isNull(), 0.6).when(placeholder, 0.3).otherwise(0.85),
        "year": F.lit(0.9), "era": F.lit(0.85), "lyrics": F.lit(0.9),
    }
    entry = lambda k, v: F.when(sources[k].isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value")))
    tables: dict[str, Column] = {n: F.map_from_entries(F.array_compact(F.array(*(entry(k, m[k]) for k in sources)))) for n, m in (("sourceMap", sources), ("fieldConfidence", trust))}
    df = df.withColumns({
        **tables, "cleanTitle": F.when(bare != "", bare).otherwise(first), "cleanArtist": F.coalesce(F.nullif("_usable", F.lit("")), guessed, F.col("_path.artist")),
        "album": F.coalesce(album, F.col("_path.album")), "albumIsPlaceholder": placeholder, "era": year_to_era(F.col("year")), "lyrics": F.when(has_lyrics, lyrics),
        "lyricsHasTimeline": has_lyrics & X.has_timeline(lyrics), "lyricsSource": F.when(has_lyrics, "embedded"), "isShort": F.coalesce((F.col("durationSec") > 0) & (F.col("durationSec") < 60), F.lit(False)), "artist": F.nullif("_artist", F.lit("")),
    })
    real = F.col("album").isNotNull() & ~F.col("albumIsPlaceholder")
    flags = X.content_flags(F.col("title"), F.col("album"), F.col("artist"), F.col("cleanTitle"))
    df = df.withColumns({**flags, "albumGroup": F.when(real, "real").otherwise("unknown"), "scrapeStage": F.lit("L1_only")})
    return finalize(df.drop("_title", "_artist", "_album", "_named", "_usable", "_split", "_path"), updated_at)


def _counters() -> list[Column]:
    source = lambda f, v: F.count_if(F.coalesce(F.element_at("sourceMap", f) == v, F.lit(False)))
    return [
        F.count(F.lit(1)).alias("done"), F.count_if("isGarbled").alias("repaired"), F.count_if("isAd").alias("promotional"), source("cleanTitle", "filename").alias("title_from_name"), source("cleanArtist", "filename").alias("artist_from_title"),
        source("cleanArtist", "path").alias("artist_from_path"), F.count_if(F.col("lyrics").isNotNull()).alias("lyrics"),
    ]


def stage_counters(tracks: DataFrame) -> DataFrame:
    """One row: rows, repaired, promotional, from file names, from paths, with lyrics."""
    return tracks.agg(*_counters())


def write_counted(tracks: DataFrame, path: str) -> dict[str, int]:
    """Writes tracks and gives the counters of ``stage_counters``, observed by the job that writes: no pass of their own.

    An empty table is written as such and counts nothing.
    """
    seen = Observation("stages")
    tracks.observe(seen, *_counters()).write.parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}
