"""Record linkage: the match join, pair scores, best candidates, library matching, change detection and joins of records.

The match join finds all hits: pairs come from similarity joins of titles and of artists within ranges of durations
(see similar.py), so they grow with the rows that could match, not with the square of the tables; nothing is capped.
"""

from __future__ import annotations

import functools
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import artist_parts, artist_similarity, blank, file_core, file_title, loose_name, parts_similarity, squeeze, squeezed_parts, title_similarity
from cadenza.operators.similar import char_mask, contained_pairs, edits_allowed, may_be_near, near_pairs, spread, within
from cadenza.sources.shared import dealt, shuffled, written

# Ranks of the match tiers, and the score thresholds of the two profiles.
TIERS = ("miss", "weak", "likely", "exact")
STRICT, RELAXED = (0.45, 0.65, 0.85), (0.6, 0.8, 0.92)
SOFT_SECONDS, HARD_SECONDS, LONG_FORM_SECONDS = 15, 30, 600


def tier_rank(tier: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), tier) - 1, F.lit(0)).cast("int")


def _tier(score: Column, conflict: Column, bars: tuple[float, float, float]) -> Column:
    return F.when((score >= bars[2]) & ~conflict, "exact").when((score >= bars[1]) & ~conflict, "likely").when(score >= bars[0], "weak").otherwise("miss")


def pair_score(pairs: DataFrame, title: str = "title_key", artist: str = "artist", usable: str = "artist_usable", seconds: str = "seconds", prefix: str = "c_", alike: Column | None = None) -> DataFrame:
    """Adds titleSim, artistSim, durDiff, durFactor, conflict, strict{score,tier}, relaxed{score,tier} to local and candidate columns.

    Titles are compared by the squeezed keys ``title`` and ``prefix + title``. A duration conflict is forgiven for long
    sets of nearly equal titles. Scores are rounded to 3 decimals after the tiers are set. ``alike`` is the artists'
    similarity if a caller has it.
    """
    df = pairs.withColumn("_t", title_similarity(F.col(title), F.col(prefix + title)))
    alike = artist_similarity(F.col(artist), F.col(prefix + artist)) if alike is None else alike
    df = df.withColumn("_a", F.when(F.col(usable), alike).otherwise(F.lit(0.0)))
    mine, other = F.coalesce(F.col(seconds), F.lit(0)), F.coalesce(F.col(prefix + seconds), F.lit(0))
    gap = F.when((mine > 0) & (other > 0), F.abs(mine - other))
    hard, soft = F.coalesce(gap > HARD_SECONDS, F.lit(False)), F.coalesce(gap > SOFT_SECONDS, F.lit(False))
    factor = F.when(hard, 0.5).when(soft, SOFT_FACTOR).otherwise(1.0)
    df = df.withColumns({"durDiff": gap, "durFactor": factor, "_forgiven": hard & (F.greatest(mine, other) >= LONG_FORM_SECONDS) & (F.col("_t") >= 0.95), "_hard": hard})
    df = df.withColumn("conflict", F.col("_hard") & ~F.col("_forgiven"))
    used = F.when(F.col("_forgiven"), 1.0).otherwise(F.col("durFactor"))
    base = F.when(F.col(usable), 0.6 * F.col("_t") + 0.4 * F.col("_a")).otherwise(0.8 * F.col("_t") + F.when(blank(F.col(prefix + artist)) != "", 0.12).otherwise(0.0))
    held = lambda x: F.when(F.col("conflict"), F.least(x, F.lit(0.5))).otherwise(x)
    df = df.withColumns({"_s": held(base * used), "_r": held(F.col("_t") * used)})
    out = lambda x, bars: F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x))), 3).alias("score"), _tier(F.col(x), F.col("conflict"), bars).alias("tier"))
    return df.withColumns({"strict": out("_s", STRICT), "relaxed": out("_r", RELAXED), "titleSim": F.round("_t", 3), "artistSim": F.round("_a", 3)}).drop("_t", "_a", "_s", "_r", "_forgiven", "_hard")


def _order(relaxed_first: bool) -> list[Column]:
    one, two = ("relaxed", "strict") if relaxed_first else ("strict", "relaxed")
    return [tier_rank(F.col(f"{one}.tier")).desc(), F.desc(f"{one}.score"), tier_rank(F.col(f"{two}.tier")).desc(), F.desc(f"{two}.score"), F.asc("seq")]


def best_candidate(scored: DataFrame, *by: str, relaxed_first: bool = False) -> DataFrame:
    """The best scored row of each group: strict tier and score, then relaxed, then the order of arrival ``seq``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*_order(relaxed_first)))
    return scored.withColumn("_n", rank).where("_n = 1").drop("_n")


def top_candidates(scored: DataFrame, k: int, *by: str) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*_order(False)))).where(F.col("rank") <= k)


def early_stop(best_by_query: DataFrame, *by: str) -> DataFrame:
    """Of a track's queries in order, the first whose best is exact or likely, else the first that found anything."""
    hit = F.col("strict.tier").isin("exact", "likely")
    return best_by_query.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(hit.desc(), F.asc("query_no")))).where("_n = 1").drop("_n")


def best_source_tier(scored: DataFrame, track: str) -> DataFrame:
    return scored.groupBy(track).agg(F.element_at(F.array(*map(F.lit, TIERS)), F.max(tier_rank(F.col("strict.tier"))) + 1).alias("tier"))


def block_and_score(local: DataFrame, candidates: DataFrame, keys: str = "keys", track: str = "track_id", cand: str = "cand_id") -> DataFrame:
    """Pairs that share a blocking key, each once, scored. Both sides carry ``keys``; the candidates' columns begin with c_."""
    return pair_score(_keyed_pairs(local, candidates, keys, track, cand).join(shuffled(local.drop(keys)), track).join(shuffled(candidates.drop(keys)), "c_" + cand))


def _keyed_pairs(local: DataFrame, candidates: DataFrame, keys: str, track: str, cand: str) -> DataFrame:
    left = local.select(track, F.explode(F.array_distinct(keys)).alias("_k"))
    right = candidates.select("c_" + cand, F.explode(F.array_distinct(keys)).alias("_k"))
    return left.join(shuffled(right), "_k").select(track, "c_" + cand).distinct()


# The match join

#: Two artists of this similarity or more make a pair by themselves; with less, the titles must be similar. How similar follows
#: from the scores: 0.6 t + 0.4 a, or 0.8 t + 0.12 without a usable artist, must reach the bar of a likely match.
ALIKE_ARTISTS = 0.6
#: The edit distance alone tells nearly equal titles of long sets: a title that holds another is as near as 0.95 with this ratio.
LONG_FORM_TITLE = 0.8
#: What a score is multiplied by if durations are more than SOFT_SECONDS apart.
SOFT_FACTOR = 0.85
_ANY, _MISSING = -1, -2


def _duration_blocks(seconds: Column, candidate: bool) -> Column:
    """Values of which a track and a candidate share exactly one if their durations are at most HARD_SECONDS apart or one is missing."""
    known, at = F.coalesce(seconds, F.lit(0)) > 0, F.floor(seconds / (HARD_SECONDS + 1)).cast("int")
    if candidate:
        return F.when(known, F.array(at, at - 1, at + 1, F.lit(_ANY))).otherwise(F.array(F.lit(_MISSING)))
    return F.when(known, F.array(at, F.lit(_MISSING))).otherwise(F.array(F.lit(_ANY), F.lit(_MISSING)))


def _no_conflict(mine: str, theirs: str) -> Column:
    """Durations that don't conflict by themselves, of two columns whose missing values are 0."""
    return (F.col(mine) == 0) | (F.col(theirs) == 0) | (F.abs(F.col(mine) - F.col(theirs)) <= HARD_SECONDS)


def _bar(mine: str, theirs: str, bar: float) -> Column:
    """The score before durations count that a pair without a conflict reaches ``bar`` with."""
    soft = (F.col(mine) > 0) & (F.col(theirs) > 0) & (F.abs(F.col(mine) - F.col(theirs)) > SOFT_SECONDS)
    return F.when(soft, bar / SOFT_FACTOR).otherwise(bar)


def alike_artists(left: DataFrame, right: DataFrame, least: float = ALIKE_ARTISTS) -> DataFrame:
    """(artist, c_artist, alike): the pairs of distinct names, of columns of these names, whose artist_similarity is ``least`` or more."""
    parts = lambda df, c: df.select(c).distinct().select(c, F.explode(artist_parts(F.col(c))).alias("part")).select(c, squeeze(F.col("part"), False, False).alias("part")).where("part <> ''").distinct()
    one, two = parts(left, "artist"), parts(right, "c_artist")
    texts = lambda df, k, t: df.select(F.col("part").alias(k), F.col("part").alias(t)).distinct()
    a, b = texts(one, "l", "x"), texts(two, "r", "y")
    near = near_pairs(a, b, least).unionByName(contained_pairs(a, b)).distinct()
    pairs = near.join(shuffled(one.withColumnRenamed("part", "l")), "l").join(shuffled(two.withColumnRenamed("part", "r")), "r").select("artist", "c_artist").distinct()
    return pairs.withColumn("alike", artist_similarity(F.col("artist"), F.col("c_artist"))).where(F.col("alike") >= least)


#: Classes of artists, the bits of one number.
ARTIST_CLASSES = 64


def _artist_class(name: Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(ARTIST_CLASSES)).cast("int")


def _class_bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _artist_class(F.col("c_artist")))


def _alike_classes(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """(artist, alike_mask): the classes of candidates' artists of which every one is alike."""
    grouped = lambda df, *by: df.groupBy(*by, _artist_class(F.col("c_artist")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    sizes = grouped(candidates.select("c_artist").where("c_artist <> ''").distinct())
    full = grouped(names, "artist").join(sizes, ["class", "n"])
    return full.groupBy("artist").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("class"))).alias("alike_mask"))


def _by_title(local: DataFrame, candidates: DataFrame, names: DataFrame) -> list[DataFrame]:
    """(l, r) of compatible durations and titles similar enough for a hit, but for those that ``_by_artist`` finds in any case.

    With alike artists a relaxed hit is a strict one, so tracks with a usable artist leave out the classes of artists that
    are all alike, and have nothing to find if these are all classes. With a candidate without artist they have relaxed hits only.
    """
    classes = _alike_classes(candidates, names)
    every = candidates.where("c_artist <> ''").agg(F.coalesce(F.bit_or(_class_bit()), F.lit(0)).cast("bigint").alias("every"))
    known = local.where("usable").join(shuffled(classes), "artist", "left").withColumn("mine", F.coalesce("alike_mask", F.lit(0)).cast("bigint"))
    rest = known.crossJoin(F.broadcast(every)).where(F.col("mine").bitwiseAND(F.col("every")) != F.col("every")).select("l", "x", "b", "s", "mine")  # one row of a number
    one, two = local.select("l", "x", "b", "s", "usable"), candidates.select("r", "y", "b", "s", "c_artist", _class_bit().alias("class"))
    fits, strict, relaxed = _no_conflict("x_s", "y_s"), _bar("x_s", "y_s", STRICT[1]), _bar("x_s", "y_s", RELAXED[1])
    unknown = near_pairs(one.where("not usable"), two, (STRICT[1] - 0.12) / 0.8, fits, F.least(relaxed, (strict - 0.12) / 0.8), (("s",), ("s",)))
    apart = fits & (F.col("x_mine").bitwiseAND(F.col("y_class")) == 0)
    named = near_pairs(rest, two.where("c_artist <> ''"), (STRICT[1] - 0.4 * ALIKE_ARTISTS) / 0.6, apart, F.least(relaxed, (strict - 0.4 * ALIKE_ARTISTS) / 0.6), (("s", "mine"), ("s", "class")))
    return [unknown, named, near_pairs(one.where("usable"), two.where("c_artist = ''"), RELAXED[1], fits, relaxed, (("s",), ("s",)))]


def _by_artist(local: DataFrame, candidates: DataFrame, names: DataFrame) -> DataFrame:
    """(l, r) of alike artists, compatible durations and titles similar enough for a hit with that artist."""
    one = local.where("usable").join(shuffled(names), "artist").select("l", "x", "x_n", "x_mask", F.col("s").alias("x_s"), "c_artist", "alike", F.explode("b").alias("b"))
    two = candidates.select("r", "y", "y_n", "y_mask", F.col("s").alias("y_s"), "c_artist", F.explode("b").alias("b"))
    most = edits_allowed(F.greatest("x_n", "y_n"), (_bar("x_s", "y_s", STRICT[1]) - 0.4 * F.col("alike")) / 0.6)
    held = (F.least("x_n", "y_n") >= 2) & (F.contains("x", "y") | F.contains("y", "x"))
    met = spread(one, "c_artist", "b").join(shuffled(spread(two, "c_artist", "b")), ["c_artist", "b"]).where(_no_conflict("x_s", "y_s"))
    return met.where((may_be_near("x_", "y_", most) & within(F.col("x"), F.col("y"), most)) | held).select("l", "r")


def hit_pairs(local: DataFrame, candidates: DataFrame, title: str = "title_key", artist: str = "artist", usable: str = "artist_usable", seconds: str = "seconds", track: str = "track_id", cand: str = "cand_id") -> DataFrame:
    """(track, c_cand), each once: a superset of the pairs whose strict or relaxed tier is likely or exact, found without all pairs.

    A hit's durations don't conflict, or one is missing, or it is a long set of nearly equal titles. Beyond that, its
    artists are alike (ALIKE_ARTISTS), or its titles are. Each of these is a join of its own: of alike
    artists within ranges of durations; of titles by prefix filter and by containment within ranges of durations; of
    the titles of long sets.
    """

    def side(df: DataFrame, key: str, text: str, artist: str, seconds: str, out: str, x: str, *more: Column) -> DataFrame:
        names = F.coalesce(F.col(artist), F.lit("")).alias("artist" if more else "c_artist")
        known = df.select(F.col(key).alias(out), F.col(text).alias(x), names, F.greatest(F.coalesce(F.col(seconds), F.lit(0)), F.lit(0)).alias("s"), *more).where(F.col(x) != "")
        shaped = known.withColumns({x + "_n": F.char_length(x), x + "_mask": char_mask(F.col(x)), "b": _duration_blocks(F.col("s"), not more)})
        return written(dealt(shaped), "match-side")

    one = side(local, track, title, artist, seconds, "l", "x", F.coalesce(F.col(usable), F.lit(False)).alias("usable"))
    two = side(candidates, "c_" + cand, "c_" + title, "c_" + artist, "c_" + seconds, "r", "y")
    titles = lambda a, b, *more: (a.select("l", "x", *more), b.select("r", "y", *more))
    names = written(alike_artists(one.where("usable"), two), "alike-artists")
    joins = [*_by_title(one, two, names), contained_pairs(*titles(one, two, "b")), _by_artist(one, two, names)]
    long_set = F.col("s") >= LONG_FORM_SECONDS
    joins += [near_pairs(*titles(a, b), LONG_FORM_TITLE) for a, b in ((one.where(long_set), two), (one.where(~long_set), two.where(long_set)))]
    # each join is run by itself: the driver keeps the plan of a whole execution, and describes it again after each stage
    found = functools.reduce(DataFrame.unionByName, (written(df, "match-pairs") for df in joins))
    return found.distinct().select(F.col("l").alias(track), F.col("r").alias("c_" + cand))


def match_and_score(local: DataFrame, candidates: DataFrame, title: str = "title_key", artist: str = "artist", usable: str = "artist_usable", seconds: str = "seconds", track: str = "track_id", cand: str = "cand_id") -> DataFrame:
    """Every hit, scored: the pairs whose strict or relaxed tier is likely or exact. None is missed; weaker pairs aren't given.

    Empty titles match nothing. Repeated ids would repeat pairs; both sides need ids of their own.
    """
    local = written(dealt(local).withColumn("_parts", squeezed_parts(F.col(artist))), "match-local")
    candidates = written(dealt(candidates).withColumn("_c_parts", squeezed_parts(F.col("c_" + artist))), "match-candidates")
    pairs = hit_pairs(local, candidates, title, artist, usable, seconds, track, cand)
    met = spread(spread(pairs, track).join(shuffled(local), track), "c_" + cand).join(shuffled(candidates), "c_" + cand)
    scored = pair_score(met, title, artist, usable, seconds, alike=parts_similarity(F.col("_parts"), F.col("_c_parts"))).drop("_parts", "_c_parts")
    return scored.where(F.col("strict.tier").isin("likely", "exact") | F.col("relaxed.tier").isin("likely", "exact"))


#: Parts of the candidates in the product of all pairs; the tracks have four for each core.
CANDIDATE_PARTS = 4


def best_without_hit(local: DataFrame, candidates: DataFrame, hits: DataFrame, title: str = "title_key", artist: str = "artist", usable: str = "artist_usable", seconds: str = "seconds", track: str = "track_id", cand: str = "cand_id") -> DataFrame:
    """For each track and source without a strict hit among ``hits`` (of ``match_and_score``), the best of all the source's candidates, scored.

    Weak pairs and misses have no least similarity by which a join could find them, so all pairs of these tracks are tried: the work
    is their number times the candidates. Pairs are scored where they are made and only the best of each track and source
    leaves a task, as one number of its ranks, scores and ``seq``; no pair is stored or shuffled.
    """
    source = candidates.select("source").distinct()
    hit = hits.where(F.col("strict.tier").isin("likely", "exact")).select(track, "source").distinct()
    mine = local.select(track, title, artist, usable, seconds, squeezed_parts(F.col(artist)).alias("parts")).crossJoin(source).join(shuffled(hit), [track, "source"], "left_anti")
    mine = written(mine, "without-hit").repartition(4 * local.sparkSession.sparkContext.defaultParallelism)
    theirs = candidates.select(F.col("source").alias("c_source"), "seq", "c_" + title, "c_" + artist, "c_" + seconds, squeezed_parts(F.col("c_" + artist)).alias("c_parts"))
    theirs = written(theirs, "match-candidates").repartition(CANDIDATE_PARTS)
    pairs = mine.join(theirs.hint("shuffle_replicate_nl"), F.col("source") == F.col("c_source"))
    scored = pair_score(pairs, title, artist, usable, seconds, alike=parts_similarity(F.col("parts"), F.col("c_parts")))

    # ranks and thousandths of either profile, then the smallest seq; 10^19 is more than any long
    digits = lambda c: tier_rank(F.col(f"{c}.tier")) * 1001 + F.round(F.col(f"{c}.score") * 1000).cast("int")
    base, middle = F.lit(Decimal(2 * 10**19)), F.lit(Decimal(10**19))
    order = (digits("strict").cast("bigint") * 4004 + digits("relaxed")).cast("decimal(10,0)") * base + (middle - F.col("seq").cast("decimal(20,0)"))
    best = scored.select(track, "source", order.alias("order")).groupBy(track, "source").agg(F.max("order").alias("order"))
    best = best.select(track, "source", (middle - F.col("order") % base).cast("bigint").alias("seq"))
    found = best.join(shuffled(candidates), ["source", "seq"]).join(shuffled(local), track)
    return best_candidate(pair_score(found, title, artist, usable, seconds), track, "source")


# Library matching in three stages


def _compatible(mine: Column, theirs: Column) -> Column:
    a, b = blank(mine), blank(theirs)
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a)


def library_match(items: DataFrame, library: DataFrame) -> DataFrame:
    """items (item, name, artist) with the first library row (id, title, artist, fileName, seq) of the first stage that finds one.

    Stage 1: equal loose titles. 2: one title holds the other. 3: equal file-name keys, or one begins with the other. In
    each the artists must be compatible; in stage 3 the file name may hold the artist instead. Stages 2 and 3 look only at
    items that stage 1 left, and find their pairs by equi-joins, on the rarest 3-gram of the shorter text and on whole
    prefixes.
    """
    want, have = _library_sides(items, library)
    one = _exact_titles(want, have)
    rest = want.join(shuffled(one.select("item").distinct()), "item", "left_anti")
    every = one.unionByName(_contained_titles(rest, have)).unionByName(_file_names(rest, have))
    return every.groupBy("item").agg(F.min(F.struct("stage", "seq", "id")).alias("m")).select("item", "m.stage", "m.id")


def exact_titles(items: DataFrame, library: DataFrame) -> DataFrame:
    """item and id of stage 1 alone."""
    return _exact_titles(*_library_sides(items, library)).groupBy("item").agg(F.min_by("id", F.struct("seq", "id")).alias("id"))


def _library_sides(items: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    want = items.select("item", loose_name(F.col("name")).alias("n"), loose_name(F.col("artist")).alias("a")).where("n <> ''")
    have = library.select("id", "seq", loose_name(F.col("title")).alias("t"), loose_name(F.col("artist")).alias("b"), loose_name(file_title(F.col("fileName"))).alias("f"), loose_name(file_core(F.col("fileName"))).alias("core"))
    return want, have


def _exact_titles(want: DataFrame, have: DataFrame) -> DataFrame:
    return want.join(shuffled(have), F.col("n") == F.col("t")).where(_compatible(F.col("a"), F.col("b"))).select("item", F.lit(1).alias("stage"), "id", "seq")


def _contained_titles(want: DataFrame, have: DataFrame) -> DataFrame:
    two = contained_pairs(want.select(F.col("item").alias("l"), F.col("n").alias("x")), have.select(F.col("id").alias("r"), F.col("t").alias("y")))
    near = two.select(F.col("l").alias("item"), F.col("r").alias("id")).join(shuffled(want), "item").join(shuffled(have), "id")
    return near.where(_compatible(F.col("a"), F.col("b"))).select("item", F.lit(2).alias("stage"), "id", "seq")


def _prefixes(c: str) -> Column:
    """The text itself, and its prefixes of 3 characters or more."""
    return F.transform(F.sequence(F.least(F.lit(3), F.char_length(c)), F.char_length(c)), lambda i: F.substring(F.col(c), F.lit(1), i))


def _file_names(want: DataFrame, have: DataFrame) -> DataFrame:
    """Equal keys, or of 3 characters or more where one begins with the other: each side's prefixes meet the other's whole key."""
    have = have.where("f <> ''")
    one = want.select("*", F.explode(_prefixes("n")).alias("p")).join(shuffled(have), F.col("p") == F.col("f")).drop("p")
    two = have.select("*", F.explode(_prefixes("f")).alias("p")).join(shuffled(want), F.col("p") == F.col("n")).drop("p")
    in_file = _compatible(F.col("a"), F.col("b")) | ((F.col("a") != "") & F.contains("core", "a"))
    return one.unionByName(two.select(*one.columns)).where(in_file).select("item", F.lit(3).alias("stage"), "id", "seq")


def downloaded_report(items: DataFrame, library: DataFrame) -> DataFrame:
    """items with the matched track's id and stage, and whether there is one."""
    return items.join(shuffled(library_match(items, library)), "item", "left").withColumn("inLibrary", F.col("id").isNotNull())


def library_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("inLibrary").agg(F.count(F.lit(1)).alias("n"))


# Change detection


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a listing (filePath, mtime, size) that are new or whose time or size differ, with the reason."""
    old = known.select("filePath", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_k"))
    df = listing.join(old, "filePath", "left")
    reason = F.when(F.col("_k").isNull(), "new").when(~F.col("mtime").eqNullSafe(F.col("_m")) | ~F.col("size").eqNullSafe(F.col("_s")), "changed")
    return df.withColumn("reason", reason).where("reason is not null").drop("_m", "_s", "_k")


def deletions(known: DataFrame, listing: DataFrame, still_there: DataFrame | None = None, *, enabled: bool = True, sample_run: bool = False, most: float = 0.5) -> DataFrame:
    """One row per known path that is gone, with ``verdict``: removed, or the guard that stopped it.

    A path is gone if neither the listing nor the second check ``still_there`` has it. Guards: disabled, sample,
    empty-enumeration, ratio-guard (more than ``most`` of all known paths would go).
    """
    gone = known.select("filePath").join(listing.select("filePath"), "filePath", "left_anti")
    if still_there is not None:
        gone = gone.join(still_there.select("filePath"), "filePath", "left_anti")
    if not enabled or sample_run:
        return gone.withColumn("verdict", F.lit("sample" if enabled else "disabled"))
    facts = known.agg(F.count(F.lit(1)).alias("all_n")).join(gone.agg(F.count(F.lit(1)).alias("gone_n")), F.lit(True)).join(listing.agg(F.count(F.lit(1)).alias("list_n")), F.lit(True))
    verdict = F.when(F.col("list_n") == 0, "empty-enumeration").when(F.col("gone_n") > most * F.col("all_n"), "ratio-guard").otherwise("removed")
    one = facts.select(F.lit(1).alias("_one"), verdict.alias("verdict"))
    return gone.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")  # one row of counts


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and the old ones without a new one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def remove(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


# Further joins


def map_legacy_ids(tracks: DataFrame, mapping: DataFrame) -> DataFrame:
    """tracks (filePath, legacyIds) with the ids of mapping (legacy_id, file_path) for their paths added."""
    extra = mapping.groupBy(F.col("file_path").alias("filePath")).agg(F.array_sort(F.collect_set("legacy_id")).alias("_more"))
    return tracks.join(extra, "filePath", "left").withColumn("legacyIds", F.array_union("legacyIds", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def unmatched_legacy_ids(tracks: DataFrame, mapping: DataFrame, most: int = 200) -> DataFrame:
    return mapping.join(tracks.select(F.col("filePath").alias("file_path")), "file_path", "left_anti").orderBy("legacy_id", "file_path").limit(most)


def lyrics_fallback(tracks: DataFrame, sidecar: DataFrame, online: DataFrame, least: int = 10) -> DataFrame:
    """Lyrics from the sidecar file, else embedded, else online: the first that is longer than ``least`` characters."""
    df = tracks.join(sidecar.select("id", F.col("lyrics").alias("_s")), "id", "left").join(online.select("id", F.col("lyrics").alias("_o")), "id", "left")
    good = lambda c: F.length(F.trim(F.col(c))) > least
    source = F.when(good("_s"), "sidecar").when(good("lyrics"), "embedded").when(good("_o"), "online")
    return df.withColumn("lyricsSource", source).withColumn("lyrics", F.when(good("_s"), F.col("_s")).when(good("lyrics"), F.col("lyrics")).when(good("_o"), F.col("_o"))).drop("_s", "_o")


def by_source(best: DataFrame, track: str, one: str, two: str) -> DataFrame:
    """Best matches of two sources side by side, tracks of either."""
    side = lambda s: best.where(F.col("source") == s).select(track, F.col("tier").alias(f"{s}_tier"), F.col("artist").alias(f"{s}_artist"))
    return side(one).join(shuffled(side(two)), track, "full_outer")


def merge_existing(old: DataFrame, fresh: DataFrame, fields: list[str], physical: list[str], key: str = "id") -> DataFrame:
    """Fresh records under the old ones: locked fields stay, old values stay unless missing or without a source, physical columns refresh."""
    both = old.alias("o").join(fresh.alias("f"), key, "left")
    present = F.col(f"f.{fields[0]}").isNotNull() | F.lit(True)
    out = [F.col(key)]
    for c in fields:
        keep = F.array_contains("o.lockedFields", c) | (F.col(f"o.{c}").isNotNull() & (F.col(f"o.{c}").cast("string") != "") & F.element_at("o.sourceMap", c).isNotNull())
        out.append(F.when(keep, F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"f.{c}"), F.col(f"o.{c}"))).alias(c))
    out += [F.when(present, F.coalesce(F.col(f"f.{c}"), F.col(f"o.{c}"))).alias(c) for c in physical]
    return both.select(*out)


def duplicates(df: DataFrame, artist: str, title: str, seconds: str, gap: int = 15) -> DataFrame:
    """Rows with equal artist and title whose durations chain within ``gap`` seconds: group (smallest id) and size."""
    w = Window.partitionBy(artist, title).orderBy(seconds, "id")
    fresh = F.coalesce((F.col(seconds) - F.lag(seconds).over(w) > gap).cast("int"), F.lit(1))
    runs = df.withColumn("_run", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(artist, title, "_run")
    return runs.withColumns({"group": F.min("id").over(own), "n": F.count(F.lit(1)).over(own)}).where("n > 1").drop("_run")


def reconcile(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """metric, n: rows, distinct keys, and keys only on either side."""
    counts = [("rows_a", one.agg(F.count(F.lit(1)).alias("n"))), ("rows_b", two.agg(F.count(F.lit(1)).alias("n"))), ("keys_a", one.agg(F.count_distinct(key).alias("n"))), ("keys_b", two.agg(F.count_distinct(key).alias("n")))]
    counts += [("only_a", one.select(key).distinct().join(two, key, "left_anti").agg(F.count(F.lit(1)).alias("n"))), ("only_b", two.select(key).distinct().join(one, key, "left_anti").agg(F.count(F.lit(1)).alias("n")))]
    out = None
    for name, df in counts:
        part = df.select(F.lit(name).alias("metric"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def failure_streaks(attempts: DataFrame, order: str = "idx", threshold: int = 3, range_width: int = 100_000) -> DataFrame:
    """Runs of failures of a source (source, ok) in order: start, length, and whether the threshold was reached.

    Successes before a row name its run. They are counted inside ranges of the integer ``order`` and summed up over the
    ranges, so that no task holds a whole source.
    """
    rows = attempts.select("source", order, F.col("ok").cast("int").alias("_ok"), F.floor(F.col(order) / range_width).alias("_range"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "_range").agg(F.sum("_ok").alias("_n")).select("source", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("_sum", F.sum("_ok").over(inside)).join(offsets, ["source", "_range"]).where("_ok = 0")
    runs = numbered.groupBy("source", (F.col("_offset") + F.col("_sum")).alias("_run")).agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.select("source", "start", "length", (F.col("length") >= threshold).alias("rotate"))


# Stored results


def stored_results(asked: DataFrame, results: DataFrame, keys: list[str], ts: str, ttl: int, payload: list[str]) -> DataFrame:
    """``asked`` with the newest earlier result of the same ``keys``: ``stored_at``, its ``payload`` columns and ``ask``, whether to ask again.

    Times are integers, such as seconds; a result, empty ones too, serves for ``ttl`` of them. Both sides fall into
    spans of that length, so what serves lies in the same span or the one before: inside a span a window carries the newest
    result along, and each span's last one is handed to the next. No task holds all times of a key. Results of the
    same time as the question don't count as earlier.
    """
    span = F.floor(F.col(ts) / ttl)
    held = F.struct(F.col(ts).alias("at"), *payload)
    left = asked.select(*asked.columns, span.alias("_span"), F.lit(None).cast(results.select(held.alias("h")).schema["h"].dataType).alias("_held"), F.lit(0).alias("_kind"))
    right = results.select(*keys, F.col(ts), span.alias("_span"), held.alias("_held"), F.lit(1).alias("_kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_span").orderBy(ts).rangeBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("_own", F.max("_held").over(inside)).where("_kind = 0")
    last = right.groupBy(*keys, (F.col("_span") + 1).alias("_span")).agg(F.max("_held").alias("_before"))
    found = rows.join(last, [*keys, "_span"], "left").withColumn("_held", F.coalesce("_own", "_before"))
    fresh = F.coalesce(F.col(ts) - F.col("_held.at") <= ttl, F.lit(False))
    kept = [F.when(fresh, F.col(f"_held.{c}")).alias(f"stored_{c}") for c in payload]
    return found.select(*asked.columns, F.when(fresh, F.col("_held.at")).alias("stored_at"), *kept, (~fresh).alias("ask"))


def first_page_rows(rows: DataFrame, key: str, page: str, order: str) -> DataFrame:
    """Whole rows of the first page that has an id, the first of that page."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(page, order))).where("_n = 1").drop("_n")
