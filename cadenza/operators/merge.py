"""Field survivorship: candidate values with source and confidence folded into records by priority, with locks.

Candidates are long: (id, field, value, source, confidence, seq). A record's current values are long too: (id, field, value, source,
confidence, locked). The fold runs inside each (id, field) group, over its few candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import PSEUDO_VALUES, blank
from cadenza.functions.values import year_to_era
from cadenza.operators.browse import need_review, overall_confidence, quality_level

# Priorities of the sources; any other source has 15.
PRIORITIES = {
    "manual": 100, "embed": 50, "online:netease": 30, "online:musicbrainz": 29, "online:qq": 28, "online:kugou": 27, "online:caa": 26, "online:douban": 25,
    "llm": 22, "path": 20, "filename": 10,
}
OTHER_PRIORITY = 15
# The closed vocabulary, and what stands in for a missing label.
VOCABULARY = {
    "mood": ("怀旧", "伤感", "治愈", "浪漫", "励志", "欢快", "慵懒", "孤独", "热血", "宁静", "思念", "释然"),
    "genre": ("流行", "民谣", "摇滚", "古风", "电子", "舞曲", "说唱", "R&B", "爵士", "轻音乐", "民族", "乡村", "粤语流行", "DJ串烧", "其他"),
    "scene": ("深夜驾驶", "高速长途", "城市通勤", "周末自驾", "雨天", "黄昏", "海边", "聚会", "专注工作", "睡前", "夜晚独处", "运动健身"),
    "lang": ("国语", "粤语", "闽南语", "英语", "日语", "韩语", "纯音乐", "其他"),
    "era": ("80s及更早", "90s", "2000s", "2010s", "2020s", "未知"),
}
FALLBACKS = {"genre": "其他", "lang": "其他", "era": "未知"}
VOCABULARY_VERSION = "vocab-v2"
# Columns that edits never touch.
DENIED = ("id", "filePath", "fileName", "fileExt", "fileSizeBytes", "fileMtime", "dirDepth")
MOST_LABELS = 3


def priority(source: Column) -> Column:
    out = F.lit(OTHER_PRIORITY)
    for name, value in PRIORITIES.items():
        out = F.when(source == name, F.lit(value)).otherwise(out)
    return out


def rejected(field: Column, value: Column, now: int, vocabulary: dict[str, Sequence[str]] | None = None) -> Column:
    """Values that no merge takes: missing ones, stand-ins, zeros of numbers, years out of range, labels outside the vocabulary.

    Values are strings; several labels of a field are joined by |, and all must be in the vocabulary.
    """
    words = VOCABULARY if vocabulary is None else vocabulary
    s = F.trim(blank(value))
    bad = (s == "") | s.isin(*PSEUDO_VALUES) | (s == "0")
    year = s.try_cast("int")
    bad = bad | ((field == "year") & ~F.coalesce(year.between(1900, now + 1), F.lit(False)))
    for dim, allowed in words.items():
        bad = bad | ((field == dim) & (F.size(F.array_except(F.split(s, "[|]"), F.array(*map(F.lit, allowed)))) > 0))
    return bad


def merge_fields(current: DataFrame, candidates: DataFrame, now: int, vocabulary: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Every (id, field) of either side after the fold: value, source, confidence, accepted (how many candidates were taken), outcomes.

    Candidates come by source priority, ties in the order of ``seq``. One is skipped if the field is locked, the value
    is rejected, or the standing source has a higher priority, unless the standing confidence is below 0.7 and
    the new one is at least 0.2 higher; a path never replaces an embedded value. Equal priority: the later one wins.
    """
    confidence = F.coalesce(F.col("confidence"), F.lit(0.5))
    item = F.struct((-priority(F.col("source"))).alias("p"), F.col("seq").alias("seq"), F.col("value").alias("value"), F.col("source").alias("source"), confidence.alias("confidence"), rejected(F.col("field"), F.col("value"), now, vocabulary).alias("bad"))
    grouped = candidates.groupBy("id", "field").agg(F.array_sort(F.collect_list(item)).alias("items"))
    both = current.join(grouped, ["id", "field"], "full_outer")
    start = F.struct(
        F.col("value").alias("value"), F.col("source").alias("source"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.lit(0).alias("accepted"), F.array().cast("array<string>").alias("outcomes")
    )
    locked = F.coalesce(F.col("locked"), F.lit(False))

    def step(s: Column, c: Column) -> Column:
        lower = s["source"].isNotNull() & (priority(s["source"]) > -c["p"])
        allowed = (s["confidence"] < 0.7) & (c["confidence"] >= s["confidence"] + 0.2)
        path = (c["source"] == "path") & F.coalesce(s["source"] == "embed", F.lit(False))
        outcome = F.when(locked, "locked").when(c["bad"], "rejected").when((lower & ~allowed) | path, "lower-priority").otherwise("accepted")

        def applied(o: Column) -> Column:
            take = o == "accepted"
            return F.struct(
                F.when(take, c["value"]).otherwise(s["value"]).alias("value"), F.when(take, c["source"]).otherwise(s["source"]).alias("source"),
                F.when(take, F.round(c["confidence"], 3)).otherwise(s["confidence"]).alias("confidence"), (s["accepted"] + take.cast("int")).alias("accepted"), F.concat(s["outcomes"], F.array(o)).alias("outcomes"),
            )

        return F.element_at(F.transform(F.array(outcome), applied), 1)

    none = F.filter(F.array(F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("value"), F.lit("").alias("source"), F.lit(0.0).alias("confidence"), F.lit(False).alias("bad"))), lambda _: F.lit(False))
    folded = F.aggregate(F.coalesce("items", none), start, step)
    return both.select("id", "field", folded.alias("m")).select("id", "field", "m.value", "m.source", "m.confidence", "m.accepted", "m.outcomes")


def widen(merged: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Long values as columns, with sourceMap and fieldConfidence."""
    some = merged.where(F.col("value").isNotNull())
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", c))))
    values = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return some.groupBy("id").agg(*values, entries("source").alias("sourceMap"), entries("confidence").alias("fieldConfidence"))


def to_long(df: DataFrame, fields: Sequence[str], source: Column, confidence: Column, seq: Column) -> DataFrame:
    """Wide values as candidates; missing ones drop out."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    rows = df.select("id", pairs.alias("e"), source.alias("source"), confidence.alias("confidence"), seq.cast("long").alias("seq"))
    return rows.select("id", "e.field", "e.value", "source", "confidence", "seq").where("value is not null")


def online_candidates(best: DataFrame) -> DataFrame:
    """Field candidates of the best match (id, title, artist, album, year, source, score): the year at 0.1 less; within 0 to 1."""
    less = F.when(F.col("field") == "year", F.col("confidence") - 0.1).otherwise(F.col("confidence"))
    named = best.withColumnsRenamed({"title": "cleanTitle", "artist": "cleanArtist"})
    long = to_long(named, ("cleanTitle", "cleanArtist", "album", "year"), F.concat(F.lit("online:"), "source"), F.col("score"), F.lit(0))
    return long.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), less)))


def cross_source_check(values: DataFrame) -> DataFrame:
    """(id, field, value, confidence) of two or more sources: agree, and the confidence then, or the conflict mark."""
    kept = values.where(F.trim(blank(F.col("value"))) != "")
    one = kept.groupBy("id", "field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.trim("value")).alias("kinds"), F.max("confidence").alias("c"))
    agree = F.col("kinds") == 1
    return one.where("n >= 2").select("id", "field", agree.alias("agree"), F.when(agree, F.least(F.lit(1.0), F.round(F.coalesce("c", F.lit(0.5)) + 0.15, 3))).otherwise(F.col("c")).alias("confidence"), (~agree).alias("conflict"))


def duration_boost(local: Column, online: Column) -> Column:
    gap = F.abs(local - online)
    none = (F.coalesce(local, F.lit(0)) == 0) | (F.coalesce(online, F.lit(0)) == 0)
    return F.when(none, 0.0).when(gap <= 15, 0.05).when(gap <= 20, 0.0).otherwise(-0.2)


# Labels


def validate_labels(df: DataFrame, vocabulary: dict[str, Sequence[str]] | None = None, other: str = FALLBACKS["genre"]) -> DataFrame:
    """Labels (genre, lang, era, mood[], scene[], energy, valence) with words outside the vocabulary moved to ``dropped``.

    mood and scene keep 3 distinct words, energy and valence lie within 1 to 5, 3 if unreadable. ``ok`` is false, and
    all is null, without a mood and with no genre but ``other``.
    """
    words = VOCABULARY if vocabulary is None else vocabulary
    known = lambda d: F.array(*map(F.lit, words[d]))
    named = lambda d, a: F.transform(a, lambda v: F.concat(F.lit(d + "="), v))
    none = F.array().cast("array<string>")
    single = {d: F.when(F.col(d).isin(*words[d]), F.col(d)) for d in ("genre", "lang", "era")}
    several = {d: F.slice(F.array_intersect(F.coalesce(F.col(d), none), known(d)), 1, MOST_LABELS) for d in ("mood", "scene")}
    gone = [named(d, F.filter(F.array(F.col(d)), lambda v: v.isNotNull() & (v != ""))) for d in ("genre", "lang", "era")]
    gone = [F.when(single[d].isNull(), g).otherwise(none) for d, g in zip(("genre", "lang", "era"), gone, strict=True)]
    gone += [named(d, F.array_except(F.coalesce(F.col(d), none), known(d))) for d in ("mood", "scene")]

    def level(c: str) -> Column:
        number = F.col(c).cast("string").try_cast("double")
        near = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(number + 0.5))).cast("int")
        return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.when(number.isNull(), F.lit(3)).otherwise(near))

    ok = (F.size(several["mood"]) > 0) | (F.coalesce(single["genre"], F.lit(other)) != other)
    out = {**single, **several, "energy": level("energy"), "valence": level("valence")}
    return df.withColumns({"dropped": F.concat(*gone), "ok": ok, **{c: F.when(ok, v) for c, v in out.items()}})


def apply_fallback(df: DataFrame) -> DataFrame:
    return df.withColumns({d: F.coalesce(F.nullif(F.col(d), F.lit("")), F.lit(v)) for d, v in FALLBACKS.items()})


def label_confidence(c: Column) -> Column:
    """A model's confidence within 0 to 1; 0.7 if it gave none that can be read."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("string").try_cast("double"), F.lit(0.7))))


def label_candidates(labels: DataFrame) -> DataFrame:
    """Validated labels as candidates of source llm."""
    flat = labels.where("ok").withColumns({d: F.nullif(F.array_join(d, "|"), F.lit("")) for d in ("mood", "scene")})
    return to_long(flat, ("genre", "lang", "era", "mood", "scene"), F.lit("llm"), label_confidence(F.col("confidence")), F.lit(0))


def turn_on_flags(tracks: DataFrame, labels: DataFrame, flags: Sequence[str], version: str = VOCABULARY_VERSION) -> DataFrame:
    """Flags that a label sets turn on, none turns off; labelled rows get the model version."""
    new = labels.select("id", *(F.col(f).alias("_" + f) for f in flags), F.lit(version).alias("_v"))
    out = tracks.join(new, "id", "left")
    on = {f: F.coalesce(F.col(f), F.lit(False)) | F.coalesce(F.col("_" + f), F.lit(False)) for f in flags}
    return out.withColumns({**on, "modelVersion": F.coalesce("_v", "modelVersion")}).drop("_v", *("_" + f for f in flags))


def stale_labels(tracks: DataFrame, version: str = VOCABULARY_VERSION, limit: int | None = None) -> DataFrame:
    """Rows without labels of this version, unless all five label fields are locked."""
    open_fields = F.array_except(F.array(*map(F.lit, ("genre", "mood", "scene", "lang", "era"))), F.coalesce("lockedFields", F.array().cast("array<string>")))
    df = tracks.where(~F.contains(blank(F.col("modelVersion")), F.lit(version)) & (F.size(open_fields) > 0))
    return df.orderBy("id").limit(limit) if limit is not None else df


def unknown_words(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words (id, dim, value) that aren't in a vocabulary table (dim, value)."""
    return labels.join(vocabulary.select("dim", "value").distinct(), ["dim", "value"], "left_anti")


# Edits


def allowed_edits(patches: DataFrame, known: Sequence[str], denied: Sequence[str] = DENIED) -> DataFrame:
    """patches (id, field, value) of known fields that edits may touch."""
    return patches.where(F.col("field").isin(*known) & ~F.col("field").isin(*denied))


def apply_edits(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Edited values with source manual and confidence 1, locked from then on; an edited year sets the era too, as derived."""
    era = patches.where("field = 'year'").select("id", F.lit("era").alias("field"), year_to_era(F.col("value").try_cast("int")).alias("value"), F.lit(False).alias("lock"))
    new = patches.select("id", "field", "value", F.lit(True).alias("lock")).unionByName(era.join(patches.where("field = 'era'").select("id"), "id", "left_anti"))
    new = new.select("id", "field", F.col("value").alias("_value"), F.col("lock").alias("_lock"), F.lit(True).alias("_new"))
    both = current.join(new, ["id", "field"], "full_outer")
    edited = F.coalesce(F.col("_new"), F.lit(False))
    return both.select(
        "id", "field", F.when(edited, F.col("_value")).otherwise(F.col("value")).alias("value"), F.when(edited, F.lit("manual")).otherwise(F.col("source")).alias("source"),
        F.when(edited, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), (F.coalesce("locked", F.lit(False)) | F.coalesce("_lock", F.lit(False))).alias("locked"),
    )


def unlock(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    gone = F.col("lockedFields") if fields is None else F.array(*map(F.lit, fields))
    return df.withColumn("lockedFields", F.array_except("lockedFields", gone))


def protect_existing(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Candidates for fields that have neither a value nor a source yet."""
    return candidates.join(current.where("value is not null and source is not null").select("id", "field"), ["id", "field"], "left_anti")


def finalize(df: DataFrame, updated_at) -> DataFrame:
    """Confidence, quality, review and time of update, from the fields as they are."""
    df = df.withColumn("confidence", overall_confidence())
    return df.withColumns({"qualityLevel": quality_level(), "needReview": need_review(), "updatedAt": F.lit(updated_at)})


def backfill_era(df: DataFrame) -> DataFrame:
    missing = F.col("era").isNull() | F.col("era").isin("", "未知")
    return df.withColumn("era", F.when(missing & (F.coalesce("year", F.lit(0)) > 0), year_to_era(F.col("year"))).otherwise(F.col("era")))


def dedup_covers(covers: DataFrame, fakes: DataFrame, least: int = 512) -> DataFrame:
    """Cover images (owner, content) by content hash: id, bytes, owners; small and known fake images go."""
    rows = covers.where(F.octet_length("content") >= least).withColumn("hash", F.sha1("content"))
    kept = rows.join(fakes.select("hash").distinct(), "hash", "left_anti")
    return kept.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.max(F.octet_length("content")).alias("bytes")).select(F.concat(F.lit("cv_"), F.substring("hash", 1, 12)).alias("coverId"), "owners", "bytes")


def refresh_text(tracks: DataFrame, fresh: DataFrame, column: str, force: bool = False) -> DataFrame:
    """A column of ``fresh`` where it is missing in ``tracks``, or everywhere it is given if forced."""
    both = tracks.join(fresh.select("id", F.col(column).alias("_new")), "id", "left")
    take = F.col("_new").isNotNull() & (F.lit(force) | (blank(F.col(column)) == ""))
    return both.withColumn(column, F.when(take, F.col("_new")).otherwise(F.col(column))).drop("_new")
