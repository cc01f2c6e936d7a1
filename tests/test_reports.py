"""Stored results, sketches and the fuller reports, against plain loops."""

import random

from pyspark.sql import functions as F

from cadenza.operators import link as L
from cadenza.operators import quality as Q
from cadenza.operators import sketches as K


def test_stored_results_serve_until_they_are_too_old(spark):
    rng = random.Random(1)
    results = [(rng.choice("ab"), rng.randrange(100), rng.choice((0, 5))) for _ in range(60)] + [("hot", t, 1) for t in range(0, 300, 3)]
    results = list({(k, t): (k, t, n) for k, t, n in results}.values())
    asked = [(i, rng.choice(("a", "b", "c", "hot")), rng.randrange(-5, 130)) for i in range(200)]
    for ttl in (1, 7, 50):
        want = set()
        for i, k, t in asked:
            prior = max(((u, n) for q, u, n in results if q == k and u < t), default=None)
            fresh = prior is not None and t - prior[0] <= ttl
            want.add((i, prior[0] if fresh else None, prior[1] if fresh else None, not fresh))
        a, r = spark.createDataFrame(asked, "idx long, q string, ts long"), spark.createDataFrame(results, "q string, ts long, n int")
        got = L.stored_results(a, r, ["q"], "ts", ttl, ["n"])
        assert {(x.idx, x.stored_at, x.stored_n, x.ask) for x in got.collect()} == want
    none = L.stored_results(a, r.limit(0), ["q"], "ts", 5, ["n"])
    assert none.where("ask").count() == len(asked)


def test_first_page_rows_come_back_whole(spark):
    rows = spark.createDataFrame([(1, 2, 0, "b"), (1, 1, 5, "a"), (1, 1, 6, "c"), (2, 3, 0, "d")], "id int, page int, place int, more string")
    assert sorted(map(tuple, L.first_page_rows(rows, "id", "page", "place").collect())) == [(1, 1, 5, "a"), (2, 3, 0, "d")]


def test_merged_sketches_keep_their_bounds(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") * 31 % 20_011).alias("user"), (F.col("id") * 17 % 50_021).alias("value"), (F.col("id") % 2).alias("side"))
    parts = K.build_sketches(rows, F.col("day"), ("user",), ("value",), ("side",))
    assert parts.count() == 14
    for by in ((), ("side",)):
        exact = {tuple(r[c] for c in by): r for r in rows.groupBy(*by).agg(F.count_distinct("user").alias("d"), F.count(F.lit(1)).alias("n"), F.percentile_approx("value", [0.5, 0.9], 100_000).alias("p")).collect()}
        for r in K.merge_sketches(parts, by).collect():
            e = exact[tuple(r[c] for c in by)]
            assert r.rows == e.n and abs(r.distinct_user - e.d) <= K.DISTINCT_ERROR * e.d
            assert all(abs(x - y) <= 2 * K.RANK_ERROR * 50_021 for x, y in zip((r.value_p50, r.value_p90), e.p, strict=True))


def test_source_health_by_every_dimension(spark):
    rows = [("a", True, 3, 200), ("a", True, 0, 200), ("a", False, None, None), ("b", True, None, 429)]
    df = spark.createDataFrame(rows, "source string, ok boolean, n_found int, status int")
    got = {(r.source, r.dimension, r.value): (r.n, r.percent) for r in Q.source_health(df, ("status",)).collect()}
    assert got[("a", "status", "200")] == (2, 66.7) and got[("a", "status", "null")] == (1, 33.3)
    assert {k[2] for k in got if k[1] == "outcome"} == {"found", "empty", "not ok", "no count"}


def test_run_report_estimates_the_whole(spark):
    tracks = spark.createDataFrame([(1, "x", "high"), (2, None, "low")], "id int, artist string, qualityLevel string")
    log = spark.createDataFrame([(1000, 3000, 4), (2000, 6000, 6)], "started_at long, finished_at long, done int")
    got = {r.metric: r.value for r in Q.run_report(tracks, {"artist": F.col("artist").isNotNull()}, log, 100).collect()}
    assert got["coverage_artist"] == 50.0 and got["quality_high"] == 1 and got["ms_per_row"] == 500.0 and got["estimate_ms"] == 50_000
    empty = {r.metric: r.value for r in Q.run_report(tracks, {}, log.limit(0)).collect()}
    assert empty["estimate_ms"] == 0 and empty["population"] == 2


def test_repair_rescues_tags_and_flags_name_what_is_wrong(spark):
    broken = "江智民".encode("gb18030").decode("latin-1")
    df = spark.createDataFrame([(broken, "周杰伦", ""), ("加群", broken, "x"), ("a - b", "未知", "y")], "title string, artist string, album string")
    got = {r.metric: (r.before, r.after, r.rescued) for r in Q.rescued_by_repair(df, ("title", "artist", "album")).collect()}
    assert got == {"title": (1, 2, 1), "artist": (1, 2, 1), "album": (2, 2, 0)}
    flags = Q.dirt_flags(F.col("title"), F.col("artist"), F.col("album"), F.lit("p/q"), F.lit("al-1"), F.lit(0))
    rows = df.select(*(f.alias(k) for k, f in flags.items())).collect()
    assert len(flags) == 14 and all(r.no_duration for r in rows)
    assert [r.garbled_any for r in rows] == [True, True, False] and [r.promo_title for r in rows] == [False, True, False] and rows[2].title_has_separator and rows[0].album_unknown
