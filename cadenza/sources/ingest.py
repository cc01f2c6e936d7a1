"""Readers: file inventories, catalog JSON, candidate payloads, tasks, labels, legacy ids, sidecar lyrics.

All take explicit schemas; malformed records come back as nulls or in a table of their own instead of failing a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.text import blank, file_core

# Audio file extensions, and path parts that a scan passes over.
AUDIO_EXTENSIONS = ("mp3", "flac", "m4a", "mp4", "m4b", "ogg", "oga", "opus", "wav", "wma", "aac", "ape")
IGNORED = ("@eaDir", ".DS_Store", "#recycle", "Thumbs.db")


def file_inventory(spark: SparkSession, root: str, ignored: Sequence[str] = IGNORED, extensions: Sequence[str] = AUDIO_EXTENSIONS) -> DataFrame:
    """filePath (below the root), fileName, fileExt, fileSizeBytes, fileMtime, dirDepth of audio files; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^\\Q" + base + "\\E/", "")
    rows = found.select(rel.alias("filePath"), F.col("length").alias("fileSizeBytes"), F.col("modificationTime").alias("fileMtime"))
    return inventory_columns(skip_ignored(rows, ignored), extensions)


def skip_ignored(df: DataFrame, ignored: Sequence[str] = IGNORED, path: str = "filePath") -> DataFrame:
    """Without rows that have an ignored name as any part of their path."""
    return df.where(~F.arrays_overlap(F.split(path, r"[\\/]"), F.array(*map(F.lit, ignored))))


def inventory_columns(df: DataFrame, extensions: Sequence[str] = AUDIO_EXTENSIONS, path: str = "filePath") -> DataFrame:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    out = df.withColumns({"fileName": name, "fileExt": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), "dirDepth": F.size(parts) - 1})
    return out.where(F.col("fileExt").isin(*extensions))


CATALOG_SCHEMA = (
    "id string, title string, album string, artist string, displayArtist string, albumArtist string, artists array<struct<name:string>>, genres array<struct<name:string>>, moods array<string>, isrc array<string>, "
    "track int, discNumber int, year int, duration double, bitRate double, size double, suffix string, contentType string, path string, coverArt string, albumId string, artistId string, created string, comment string"
)


def catalog_songs(raw: DataFrame) -> DataFrame:
    """Flat tracks of nested catalog songs; names of artists and genres as arrays without empty ones."""
    names = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<name:string>>")), lambda x: F.trim(x["name"])), lambda x: x != "")
    kept = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x != "")
    return raw.withColumns({"artists": names("artists"), "genres": names("genres"), "moods": kept("moods"), "isrc": kept("isrc")})


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog_songs(spark.read.schema(CATALOG_SCHEMA).json(path))


def catalog_to_tags(songs: DataFrame) -> DataFrame:
    """Inventory and tag columns of catalog songs. A missing release year stays missing: the time of import says nothing of it."""
    return songs.select(
        F.col("path").alias("filePath"), F.lower(F.coalesce("suffix", F.regexp_extract("path", r"\.([^.]+)$", 1))).alias("fileExt"), (F.size(F.split("path", "/")) - 1).alias("dirDepth"),
        "title", F.coalesce("displayArtist", "artist", F.get("artists", 0)).alias("artist"), "albumArtist", "album", F.get("genres", 0).alias("genre"), F.coalesce("year", F.lit(0)).alias("year"),
        F.coalesce("track", F.lit(0)).alias("trackNo"), F.round("duration").cast("int").alias("durationSec"), F.col("bitRate").cast("int").alias("bitrate"), F.col("size").cast("long").alias("fileSizeBytes"),
    )


_PERSON = "array<struct<name:string>>"
SHAPE_A = f"id string, name string, ar {_PERSON}, artists {_PERSON}, al struct<id:string,name:string>, album struct<id:string,name:string>, dt double, duration double, publishTime bigint"


def candidates_a(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Candidates of search results in either of two spellings: milliseconds to seconds, epoch milliseconds to a year."""
    s = F.from_json(body, SHAPE_A)
    rows = payloads.withColumn("s", s)
    artists = F.transform(F.coalesce("s.ar", "s.artists"), lambda x: x["name"])
    year = F.when(F.col("s.publishTime") > 0, F.year(F.timestamp_millis("s.publishTime")))
    return rows.select(
        *(c for c in payloads.columns if c != body), F.col("s.id").alias("cand_id"), F.col("s.name").alias("title"), artists.alias("artists"), F.array_join(artists, "/").alias("artist_text"),
        F.coalesce("s.al.name", "s.album.name").alias("album"), year.alias("year"), F.round(F.coalesce("s.dt", "s.duration") / 1000).cast("int").alias("duration_sec"),
    ).where("cand_id is not null and title is not null")


SHAPE_B = "id string, title string, length double, `artist-credit` array<struct<name:string>>, releases array<struct<title:string,date:string>>, `first-release-date` string"


def candidates_b(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Candidates of recordings: credited artists, the first release, the year out of its date."""
    rows = payloads.withColumn("s", F.from_json(body, SHAPE_B))
    artists = F.filter(F.transform("s.artist-credit", lambda x: x["name"]), lambda x: x.isNotNull() & (x != ""))
    first = F.get("s.releases", 0)
    date = F.coalesce(F.col("s.first-release-date"), first["date"], F.lit(""))
    year = F.nullif(F.regexp_extract(date, r"(\d{4})", 1), F.lit("")).cast("int")
    return rows.select(
        *(c for c in payloads.columns if c != body), F.col("s.id").alias("cand_id"), F.col("s.title").alias("title"), artists.alias("artists"), F.array_join(artists, " / ").alias("artist_text"),
        first["title"].alias("album"), year.alias("year"), F.round(F.col("s.length") / 1000).cast("int").alias("duration_sec"),
    ).where("cand_id is not null and title is not null")


def split_names(c: Column) -> Column:
    """Names in one string, separated by comma, slash, semicolon or " & "."""
    return F.filter(F.transform(F.split(blank(c), r"[,/、;；]|\s+&\s+"), lambda x: F.trim(x)), lambda x: x != "")


def search_results(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Search results whose id and name stand under one of several keys; rows without either drop out."""
    pick = lambda *keys: F.coalesce(*(F.nullif(F.get_json_object(body, f"$.{k}"), F.lit("")) for k in keys))
    out = payloads.select(
        *(c for c in payloads.columns if c != body), pick("id", "songId", "musicId").alias("id"), pick("name", "title", "songName").alias("name"), split_names(pick("artist", "singer", "artistName")).alias("artists"), pick("album", "albumName").alias("albumName")
    )
    return out.where("id is not null and name is not null")


def task_records(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Download tasks: vendor keys first, guesses after; a duration over 600 is in milliseconds; JSON inside a string is read too."""
    pick = lambda *keys: F.coalesce(*(F.nullif(F.get_json_object(body, f"$.{k}"), F.lit("")) for k in keys))
    inner = F.get_json_object(F.get_json_object(body, "$.musicInfo"), "$.duration").try_cast("double")
    n = F.coalesce(pick("durationSec", "duration").try_cast("double"), inner)
    return payloads.select(
        pick("taskId", "id").alias("id"), pick("musicName", "name", "title").alias("name"), pick("artistName", "artist").alias("artist"), pick("albumName", "album").alias("album"), pick("brType", "quality").alias("brType"),
        pick("status", "state").alias("status"), F.when(n > 600, F.round(n / 1000)).otherwise(F.round(n)).cast("int").alias("durationSec"), pick("startTime", "createdAt").alias("startedAt"), pick("updateTime", "updatedAt").alias("updatedAt"),
    )


def unwrap(payloads: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """One row per record of the array that stands under the first of several keys that has one, or is the body itself."""
    read = lambda j: F.from_json(j, "array<string>", {"mode": "PERMISSIVE"})
    own = F.when(F.trim(body).startswith("["), read(F.col(body)))
    found = F.coalesce(own, *(read(F.get_json_object(body, f"$.{k}")) for k in keys))
    return payloads.select(*(c for c in payloads.columns if c != body), F.explode(found).alias(body))


LABEL_SCHEMA = "array<struct<id:string,genre:string,mood:array<string>,scene:array<string>,lang:string,era:string,energy:string,valence:string,confidence:string>>"


def read_labels(batches: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(labels, rejects) of model replies: a JSON array, perhaps fenced or with other text around it. A reply without one is a reject."""
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    text = F.when(fenced != "", fenced).otherwise(F.col(body))
    array = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    parsed = batches.withColumn("_l", F.when(F.try_parse_json(array).isNotNull() & (array != ""), F.from_json(array, LABEL_SCHEMA)))
    keep = [c for c in batches.columns if c != body]
    labels = parsed.where("_l is not null").select(*keep, F.explode("_l").alias("l")).select(*keep, "l.*")
    return labels, parsed.where("_l is null").drop("_l")


def label_batches(tracks: DataFrame, size: int = 8, with_path: bool = False) -> DataFrame:
    """batch, payload: JSON arrays of ``size`` rows of text columns for an external labeller, batched inside ranges of the id."""
    fields = ["id", "title", "artist", "album", "year"] + (["filePath"] if with_path else [])
    part = F.substring(F.md5(F.col("id").cast("string")), 1, 3)
    rows = tracks.select(part.alias("part"), *fields).withColumn("_r", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    rows = rows.withColumn("batch", F.concat_ws("-", "part", F.floor(F.col("_r") / size).cast("string")))
    return rows.groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("payload"), F.count(F.lit(1)).alias("rows"))


def legacy_ids(lines: DataFrame, line: str = "value") -> DataFrame:
    """legacy_id, file_path of lines: the first comma splits, quotes go, the header is skipped."""
    bare = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    rows = lines.select(bare(F.regexp_extract(line, "^([^,]*),(.*)$", 1)).alias("legacy_id"), bare(F.regexp_extract(line, "^([^,]*),(.*)$", 2)).alias("file_path"))
    return rows.where("legacy_id <> '' and file_path <> '' and lower(legacy_id) not in ('legacyid', 'legacy_id', 'id')")


def read_legacy_ids(spark: SparkSession, path: str) -> DataFrame:
    return legacy_ids(spark.read.text(path))


def sidecar_lyrics(spark: SparkSession, root: str, names: str = "*.[lL][rR][cC]") -> DataFrame:
    """stem (path without extension) and whole text of the files of such names, .lrc ones as a rule."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return found.select(F.regexp_replace(path, r"\.[^.]+$", "").alias("stem"), F.col("value").alias("lyrics"))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_core(path), r"\.[^.]+$", "")
