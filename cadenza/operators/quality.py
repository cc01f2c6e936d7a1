"""Quality reports: availability, hit rates, weighted extrapolation, source health, samples and checks.

Reports are long tables (metric, n, of, percent), made by conditional counts in one pass over the rows.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import has_cjk, has_separator, infer_from_path, is_garbled, is_promo, is_unknown, repair_mojibake
from cadenza.functions.values import is_real_cover


def percent(n: Column, of: Column, digits: int = 1) -> Column:
    return F.round(100 * n / F.greatest(F.lit(1), of), digits)


def rate_table(df: DataFrame, flags: Mapping[str, Column], by: Sequence[str] = (), where: Mapping[str, Column] | None = None) -> DataFrame:
    """metric, n, of, percent: rows that a flag holds for, of those that ``where`` admits for it (all if it says nothing)."""
    admitted = lambda k: (where or {}).get(k, F.lit(True))
    names = list(flags)
    counts = [c for i, k in enumerate(names) for c in (F.count_if(admitted(k) & flags[k]).alias(f"n{i}"), F.count_if(admitted(k)).alias(f"d{i}"))]
    one = df.groupBy(*by).agg(*counts) if by else df.agg(*counts)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("of")) for i, k in enumerate(names))))
    return one.select(*by, pairs.alias("p")).select(*by, "p.metric", "p.n", "p.of", percent(F.col("p.n"), F.col("p.of")).alias("percent"))


def rescued(df: DataFrame, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """metric, before, after, rescued: how many rows are usable before and after a repair."""
    names = list(checks)
    counts = [c for i, k in enumerate(names) for c in (F.count_if(checks[k][0]).alias(f"b{i}"), F.count_if(checks[k][1]).alias(f"a{i}"), F.count_if(~checks[k][0] & checks[k][1]).alias(f"r{i}"))]
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after"), F.col(f"r{i}").alias("rescued")) for i, k in enumerate(names))))
    return df.agg(*counts).select(pairs.alias("p")).select("p.*")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in columns)))
    return df.agg(*(F.count_distinct(c).alias(c) for c in columns)).select(pairs.alias("p")).select("p.*")


def depth_report(paths: DataFrame, path: str = "path") -> DataFrame:
    """depth, files, top_dirs, inferred and share of all files, by the number of folders of a path; inferred counts the files whose folders name an artist or album."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    rows = paths.select(path, (F.size(parts) - 1).alias("depth"), F.get(parts, 0).alias("top"))
    guess = infer_from_path(F.col(path), F.col("depth"))
    inferred = F.count_if(guess["artist"].isNotNull() | guess["album"].isNotNull())
    out = rows.groupBy("depth").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("top").alias("top_dirs"), inferred.alias("inferred"))
    return out.withColumn("percent", percent(F.col("files"), F.sum("files").over(Window.partitionBy())))


def status_counts(tasks: DataFrame, states: Sequence[str]) -> DataFrame:
    """One row, one column for each state, zero if it doesn't occur."""
    return tasks.agg(*(F.count_if(F.col("status") == s).alias(s) for s in states))


def tier_histogram(matches: DataFrame, by: Sequence[str], tier: str = "tier") -> DataFrame:
    """Counts by the columns and tier, with the totals over each prefix of the columns (null: all)."""
    return matches.rollup(*by).agg(*(F.count_if(F.col(tier) == t).alias(t) for t in ("exact", "likely", "weak", "miss")), F.count(F.lit(1)).alias("total"))


def is_hit(tier: Column) -> Column:
    return tier.isin("exact", "likely")


def weighted_rate(rates: DataFrame, sizes: DataFrame, layer: str = "layer") -> DataFrame:
    """metric, rate: layer rates weighted by the layers' sizes in the population; layers without rows in the sample don't count."""
    both = rates.join(sizes, layer).where("of > 0")
    return both.groupBy("metric").agg(F.round(F.sum(F.col("size") * F.col("n") / F.col("of")) / F.sum("size") * 100, 1).alias("rate"))


def layer_rates(sample: DataFrame, flags: Mapping[str, Column], layer: str = "layer") -> DataFrame:
    return rate_table(sample, flags, by=[layer]).drop("percent")


def duration_buckets(df: DataFrame, gap: str = "durDiff") -> DataFrame:
    """bucket, n, percent of the rows with a known difference."""
    g = F.col(gap)
    bucket = F.when(g.isNull(), "unknown").when(g <= 5, "0-5").when(g <= 15, "6-15").when(g <= 20, "16-20").when(g <= 30, "21-30").otherwise(">30")
    out = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    known = F.sum(F.when(F.col("bucket") != "unknown", F.col("n"))).over(Window.partitionBy())
    return out.withColumn("percent", F.when(F.col("bucket") != "unknown", percent(F.col("n"), known)))


def first_reason(df: DataFrame, rules: Sequence[tuple[str, Column]], otherwise: str = "other") -> DataFrame:
    """reason, n: rows by the first rule that holds."""
    out = None
    for name, rule in rules:
        out = F.when(rule, F.lit(name)) if out is None else out.when(rule, F.lit(name))
    return df.groupBy(out.otherwise(F.lit(otherwise)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def source_overlap(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """metric, n: rows that both, either or one source hits; what the second adds."""
    a, b = F.coalesce(F.col(one), F.lit(False)), F.coalesce(F.col(two), F.lit(False))
    return rate_table(pairs, {"both": a & b, "only_first": a & ~b, "only_second": b & ~a, "neither": ~a & ~b, "either": a | b})


def pseudo_entities(df: DataFrame, name: str, marker: str, least: int) -> DataFrame:
    """Frequent names, with whether they look made up, and their share of all rows."""
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_of")).withColumn("_one", F.lit(1))
    out = counts.where(F.col("n") >= least).withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
    return out.select("name", "n", F.col("name").rlike(marker).alias("marked"), percent(F.col("n"), F.col("_of"), 3).alias("percent"))


def swapped_suspects(df: DataFrame, title: str, artist: str) -> DataFrame:
    return df.where((F.char_length(title) <= 4) & (F.char_length(artist) >= 5))


def source_health(attempts: DataFrame, dimensions: Sequence[str] = ("code", "status", "transport", "endpoint")) -> DataFrame:
    """source, dimension, value, n, percent of the source: outcomes, and the values of each column of ``dimensions``; nulls as 'null'."""
    outcome = F.when(~F.col("ok"), "not ok").when(F.col("n_found").isNull(), "no count").when(F.col("n_found") == 0, "empty").otherwise("found")
    named = [F.struct(F.lit(d).alias("dimension"), F.coalesce(c.cast("string"), F.lit("null")).alias("value")) for d, c in (("outcome", outcome), *((d, F.col(d)) for d in dimensions))]
    counts = attempts.select("source", F.explode(F.array(*named)).alias("d")).groupBy("source", "d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", percent(F.col("n"), F.sum("n").over(Window.partitionBy("source", "dimension"))))


def dirt_flags(title: Column, artist: Column, album: Column, path: Column, cover: Column, seconds: Column) -> dict[str, Column]:
    """What is wrong with a track's own tags, before any repair."""
    garbled = {f"garbled_{k}": is_garbled(c) for k, c in (("title", title), ("artist", artist), ("album", album), ("path", path))}
    promo = {f"promo_{k}": is_promo(c, False) for k, c in (("title", title), ("artist", artist), ("album", album))}
    any_of = lambda d: functools.reduce(lambda x, y: x | y, d.values())
    return {
        "garbled_any": any_of(garbled), **garbled, "promo_any": any_of(promo), **promo, "title_has_separator": has_separator(title, False), "artist_unknown": is_unknown(artist), "album_unknown": is_unknown(album),
        "cover_placeholder": ~is_real_cover(cover), "no_duration": F.coalesce(seconds, F.lit(0)) <= 0,
    }


def usable(c: Column) -> Column:
    """Whether a tag can be shown as it is."""
    return ~is_garbled(c) & ~is_promo(c, False) & ~is_unknown(c)


def rescued_by_repair(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric, before, after, rescued: tags that are usable as they stand, and after their encodings are repaired."""
    return rescued(df, {c: (usable(F.col(c)), usable(repair_mojibake(F.col(c)))) for c in columns})


def run_report(tracks: DataFrame, covered: Mapping[str, Column], log: DataFrame, population: int | None = None) -> DataFrame:
    """metric, value of a run: how many tracks each field covers (percent), quality levels, time for a row, and an estimate for all.

    log: started_at, finished_at (milliseconds) and done, one row for each part of the run; ``population`` rows are
    estimated for, by default as many as there are tracks.
    """
    n = F.count(F.lit(1))
    shares = {f"coverage_{k}": percent(F.count_if(c), n).cast("double") for k, c in covered.items()}
    levels = {f"quality_{q}": F.count_if(F.col("qualityLevel") == q).cast("double") for q in ("high", "medium", "low")}
    one = tracks.agg(n.alias("rows"), *(c.alias(k) for k, c in {**shares, **levels}.items()))
    ran = log.agg((F.max("finished_at") - F.min("started_at")).alias("elapsed_ms"), F.sum("done").alias("done"))
    # two rows of counts
    both = one.crossJoin(F.broadcast(ran)).withColumn("per_row", F.col("elapsed_ms") / F.nullif(F.col("done"), F.lit(0)))
    every = F.lit(population) if population is not None else F.col("rows")
    numbers = {"population": every, "processed": F.col("done"), **{k: F.col(k) for k in (*shares, *levels)}, "elapsed_ms": F.col("elapsed_ms"), "ms_per_row": F.round("per_row", 3), "estimate_ms": F.round(F.col("per_row") * every)}
    return both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("value")) for k, c in numbers.items()))).alias("m")).select("m.*")


def segments(attempts: DataFrame, width: int = 20, order: str = "idx") -> DataFrame:
    """Telemetry by runs of ``width`` rows: mean, max, share of zeros, rate of success."""
    return attempts.groupBy(F.floor(F.col(order) / width).alias("segment")).agg(
        F.round(F.avg("elapsed"), 6).alias("mean"), F.max("elapsed").alias("max"), percent(F.count_if(F.col("n_found") == 0), F.count(F.lit(1))).alias("zero_percent"), percent(F.count_if("ok"), F.count(F.lit(1))).alias("ok_percent")
    )


def upper_median(df: DataFrame, by: str, value: str, ranges: int = 4096) -> DataFrame:
    """by, upper_median: the middle value of each group, or the upper of two; nulls don't count.

    Values are counted first, then summed up over ranges between a group's least and largest value; only the range that
    holds the middle is put in order, so no task holds all values of a group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ends = counted.groupBy(F.col("_k").alias("_e")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.floor(F.sum("_n") / 2).alias("_before"))
    part = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * ranges)).otherwise(F.lit(0))
    placed = counted.join(ends, F.col("_k").eqNullSafe(F.col("_e"))).select("_k", "_v", "_n", "_before", part.cast("long").alias("_range"))
    sums = placed.groupBy(F.col("_k").alias("_e"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_all"), F.first("_before").alias("_b"))
    w = Window.partitionBy("_e").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("_offset", F.sum("_all").over(w) - F.col("_all"))
    middle = upto.where((F.col("_offset") <= F.col("_b")) & (F.col("_offset") + F.col("_all") > F.col("_b"))).select("_e", "_r", "_offset")
    inside = placed.join(middle, F.col("_k").eqNullSafe(F.col("_e")) & (F.col("_range") == F.col("_r")))
    order = Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("_sum", F.col("_offset") + F.sum("_n").over(order)).where("_sum > _before")
    return reached.groupBy(F.col("_k").alias(by)).agg(F.min("_v").alias("upper_median"))


def latency_summary(attempts: DataFrame, by: str, rows: int, lanes: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Mean, requests for each distinct query ``q``, upper median (the middle value, or the upper of two) and minutes that ``rows`` would take on so many lanes."""
    asked = F.round(F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_distinct("q")), 3)
    means = attempts.groupBy(by).agg(F.round(F.avg("elapsed"), 6).alias("mean"), asked.alias("requests_each"))
    medians = upper_median(attempts, by, "elapsed").withColumnRenamed(by, "_by")
    out = means.join(medians, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    return out.withColumns({f"minutes_{k}": F.round(F.col("mean") * rows / 60000 / k, 6) for k in lanes})


def strategy_comparison(best_by_query: DataFrame, track: str) -> DataFrame:
    """Of each query strategy: how many queries found anything, for how many tracks, and how many of their best candidates are hits."""
    hits, n = F.count_if(is_hit(F.col("strict.tier"))), F.count(F.lit(1))
    return best_by_query.groupBy("strategy").agg(n.alias("issued"), F.count_distinct(track).alias("tracks"), hits.alias("hits"), percent(hits, n).alias("percent"))


def truncation(scored: DataFrame, by: str, most: int) -> DataFrame:
    """How large the candidate pools are, and how many a cap would cut."""
    sizes = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.round(F.avg("n"), 3).alias("mean"), F.max("n").alias("largest"), F.count_if(F.col("n") > most).alias("cut"), F.count(F.lit(1)).alias("pools"))


def prefix_histogram(df: DataFrame, column: str, sep: str = "-") -> DataFrame:
    prefix = F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit("")).otherwise(F.get(F.split(column, sep), 0))
    return df.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def write_safety(df: DataFrame, hit: Column, trusted: Column, ambiguous: Column, filled: Column) -> DataFrame:
    """bucket, n: whether a match may overwrite, fill, fill with review, or nothing."""
    bucket = F.when(~hit, "none").when(trusted & ~ambiguous, "overwrite").when(~filled & ~ambiguous, "fill").when(~filled, "fill-review").otherwise("keep")
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def ambiguous_titles(df: DataFrame, segment: str, name: str, least: int = 4) -> DataFrame:
    """Rows whose title segment is also a frequent name of the library, with how often."""
    frequent = df.groupBy(F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= least)
    return df.join(frequent, F.col(segment) == F.col("_name")).drop("_name")


def run_progress(log: DataFrame, total: int, range_width: int = 100_000) -> DataFrame:
    """log (second, done) with the running percent, the rate so far and the seconds that remain.

    Sums run over seconds inside ranges of ``range_width`` seconds, offset by the ranges before; one task orders the ranges, none the seconds.
    """
    by_second = log.groupBy("second").agg(F.sum("done").alias("n")).withColumn("_range", F.floor(F.col("second") / range_width))
    ranges = by_second.groupBy("_range").agg(F.sum("n").alias("_n"), F.min("second").alias("_first"))
    w = Window.orderBy("_range")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("_range", before.alias("_before"), F.first("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy("second").rowsBetween(Window.unboundedPreceding, 0)
    out = by_second.withColumn("_sum", F.sum("n").over(inside)).join(offsets, "_range").withColumn("done", F.col("_before") + F.col("_sum"))
    out = out.withColumn("rate", F.round(F.col("done") / (F.col("second") - F.col("_start") + 1), 6))
    return out.select("second", "done", percent(F.col("done"), F.lit(total)).alias("percent"), "rate", F.when(F.col("rate") > 0, F.round((total - F.col("done")) / F.col("rate"), 3)).alias("eta"))


# Samples


def assign_layer(df: DataFrame, rules: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    out = None
    for name, rule in rules:
        out = F.when(rule, F.lit(name)) if out is None else out.when(rule, F.lit(name))
    return df.withColumn("layer", out.otherwise(F.lit(otherwise)))


def sampler_rules(title: Column) -> list[tuple[str, Column]]:
    """The layers of a catalog's sample, by title: A in a broken encoding, B promotion, C with a separator, D without CJK
    characters; the first that holds. All others are layer E."""
    repaired = repair_mojibake(title)
    return [("A", is_garbled(title)), ("B", is_promo(repaired, False)), ("C", has_separator(repaired, False)), ("D", ~has_cjk(repaired))]


# Rows of each layer in a sample of 100.
QUOTAS = {"A": 20, "B": 15, "C": 25, "D": 15, "E": 25}


def stratified_sample(df: DataFrame, size: int, seed: int = 0, quotas: Mapping[str, int] = QUOTAS, key: str = "id") -> DataFrame:
    """Exactly ``size`` rows (or all): each layer's quota, scaled, at least 1, in the order of a seeded hash; then the rest by hash.

    Only the rows of a layer with the smallest hashes are ranked: a first pass keeps ``size`` of each layer and partition.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    scaled = {k: max(1, round(v * size / 100)) for k, v in quotas.items()}
    quota = F.lit(0)
    for k, v in scaled.items():
        quota = F.when(F.col("layer") == k, F.lit(v)).otherwise(quota)
    ranked = df.withColumn("_h", digest).withColumn("_r", F.row_number().over(Window.partitionBy("layer").orderBy("_h", key)))
    few = ranked.where(F.col("_r") <= size)  # Spark keeps the first rows of each partition before it shuffles
    picked = few.withColumn("picked", F.when(F.col("_r") <= quota, F.lit("quota")).otherwise(F.lit("fill")))
    order = [(F.col("picked") == "quota").desc(), F.asc("_h"), F.asc(key)]
    return picked.orderBy(*order).limit(size).drop("_h", "_r")


def systematic_sample(df: DataFrame, step: int, key: str = "id") -> DataFrame:
    """Every ``step``-th row in the order of a digest of the key, by ranges of it, so that no task numbers all rows."""
    parts = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_p", F.substring("_h", 1, 2))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # of 256 rows
    numbered = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)))
    return numbered.join(before, "_p").where((F.col("_o") + F.col("_r") - 1) % step == 0).drop("_h", "_p", "_n", "_r", "_o")


def sample_distribution(sample: DataFrame, population: DataFrame) -> DataFrame:
    """layer, pool, picked."""
    pool = population.groupBy("layer").agg(F.count(F.lit(1)).alias("pool"))
    return pool.join(sample.groupBy("layer").agg(F.count(F.lit(1)).alias("picked")), "layer", "left").select("layer", "pool", F.coalesce("picked", F.lit(0)).alias("picked"))


# Checks


def check_expectations(facts: DataFrame, expected: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """expected (name, value) against facts (name, value): name, expected, found, ok; a fact that is missing isn't ok."""
    both = expected.withColumnRenamed("value", "expected").join(facts.withColumnRenamed("value", "found"), "name", "left")
    return both.withColumn("ok", F.coalesce(F.abs(F.col("expected") - F.col("found")) <= tolerance, F.lit(False)))


def parse_claims(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, value) of the rows of Markdown tables: first and second cell, where the second starts with a number."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.trim(line).startswith("|")).select(F.get(cells, 0).alias("name"), F.regexp_extract(F.get(cells, 1), r"^(-?[0-9]+(?:\.[0-9]+)?)", 1).alias("v"))
    return rows.where("v <> ''").select("name", F.col("v").cast("double").alias("value"))


def sensitivity(df: DataFrame, score: str, bars: Sequence[float]) -> DataFrame:
    """bar, n, percent: rows at or above each bar, in one pass."""
    return rate_table(df, {str(b): F.col(score) >= b for b in bars}).select(F.col("metric").alias("bar"), "n", "percent")


def to_metrics(report: str, df: DataFrame, name: str, value: str) -> DataFrame:
    """A report's rows as (report, metric, value), to be written together."""
    return df.select(F.lit(report).alias("report"), F.col(name).cast("string").alias("metric"), F.col(value).cast("double").alias("value"))
