import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import browse as B
from cadenza.operators.similar import contained_pairs
from cadenza.operators import link as L
from cadenza.operators import merge as M
from cadenza.operators import quality as Q

CURRENT = "id string, field string, value string, source string, confidence double, locked boolean"
CANDIDATE = "id string, field string, value string, source string, confidence double, seq long"


def merged(spark, current, candidates, field="cleanTitle"):
    now = [("t", field, *current)] if current else []
    rows = [("t", field, v, s, c, i) for i, (v, s, c) in enumerate(candidates)]
    r = M.merge_fields(spark.createDataFrame(now, CURRENT), spark.createDataFrame(rows, CANDIDATE).repartition(3), 2024).first()
    return r.value, r.source, r.confidence, r.outcomes


@pytest.mark.parametrize(
    ("current", "candidates", "want"),
    [
        (("a", "filename", 0.4, False), [("b", "online:netease", 0.75)], ("b", "online:netease", 0.75, ["accepted"])),
        (("a", "filename", 0.4, False), [("b", "llm", 0.7)], ("b", "llm", 0.7, ["accepted"])),
        (("a", "embed", 0.7, False), [("b", "online:netease", 0.95)], ("a", "embed", 0.7, ["lower-priority"])),
        (("a", "embed", 0.3, False), [("b", "online:netease", 0.8), ("c", "llm", 0.99)], ("b", "online:netease", 0.8, ["accepted", "lower-priority"])),
        (("a", "embed", 0.3, False), [("b", "path", 0.99)], ("a", "embed", 0.3, ["lower-priority"])),
        (("a", "embed", 0.3, True), [("b", "manual", 1.0)], ("a", "embed", 0.3, ["locked"])),
        (None, [("-", "manual", 1.0), ("b", "path", 0.6)], ("b", "path", 0.6, ["rejected", "accepted"])),
        (None, [("x", "online:qq", 0.5), ("y", "online:qq", 0.1)], ("y", "online:qq", 0.1, ["accepted", "accepted"])),
        (None, [("x", "strange", None)], ("x", "strange", 0.5, ["accepted"])),
    ],
)
def test_survivorship(spark, current, candidates, want):
    assert merged(spark, current, candidates) == want


def test_order_of_arrival_only_breaks_ties(spark):
    rng = random.Random(1)
    candidates = [("a", "llm", 0.9), ("b", "embed", 0.5), ("c", "online:netease", 0.72), ("d", "path", 0.9)]
    seen = set()
    for _ in range(4):
        rng.shuffle(candidates)
        seen.add(merged(spark, None, candidates)[:3])
    assert seen == {("c", "online:netease", 0.72)}


def test_rejections_and_labels(spark):
    assert merged(spark, None, [("1899", "embed", 0.9), ("2026", "llm", 0.9)], "year")[0] is None
    assert merged(spark, None, [("流行", "embed", 0.9)], "genre")[0] == "流行" and merged(spark, None, [("nope", "embed", 0.9)], "genre")[0] is None
    confidences = spark.createDataFrame([(None,), ("abc",), ("0.9",), ("5",)], "c string").select(M.label_confidence(F.col("c")).alias("c")).collect()
    assert [r.c for r in confidences] == [0.7, 0.7, 0.9, 1.0]
    raw = [("1", "流行", "国语", "bad", ["怀旧", "怀旧", "x", "治愈", "浪漫", "励志"], None, "9", "high"), ("2", "其他", None, None, [], [], None, "")]
    rows = M.validate_labels(spark.createDataFrame(raw, "id string, genre string, lang string, era string, mood array<string>, scene array<string>, energy string, valence string")).collect()
    assert (rows[0].genre, rows[0].era, rows[0].mood, rows[0].energy, rows[0].valence, rows[0].ok) == ("流行", None, ["怀旧", "治愈", "浪漫"], 5, 3, True)
    assert rows[0].dropped == ["era=bad", "mood=x"] and not rows[1].ok and rows[1].genre is None


@pytest.mark.parametrize(("gap", "factor", "conflict"), [(15, 1.0, False), (16, 0.85, False), (30, 0.85, False), (31, 0.5, True)])
def test_duration_factor(spark, gap, factor, conflict):
    row = spark.createDataFrame([("abcd", "x", True, 200, "abcd", "x", 200 + gap)], "title_key string, artist string, artist_usable boolean, seconds int, c_title_key string, c_artist string, c_seconds int")
    r = L.pair_score(row).first()
    assert (r.durFactor, r.conflict) == (factor, conflict) and r.strict.tier == ("weak" if conflict else "exact")


def test_long_sets_forgive_durations(spark):
    row = spark.createDataFrame([("abcd", "x", True, 900, "abcd", "x", 700), ("abcd", "", False, 0, "abcd", "y", 700)], "title_key string, artist string, artist_usable boolean, seconds int, c_title_key string, c_artist string, c_seconds int")
    a, b = L.pair_score(row).collect()
    assert not a.conflict and a.strict.score == 1.0
    assert b.durDiff is None and b.strict.score == 0.92 and b.strict.tier == "exact"


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "filePath string")


def test_deletion_guards(spark):
    known = paths(spark, "a", "b", "c", "d")
    verdicts = lambda df: [(r.filePath, r.verdict) for r in df.orderBy("filePath").collect()]
    assert verdicts(L.deletions(known, paths(spark, "a", "b", "c"))) == [("d", "removed")]
    assert verdicts(L.deletions(known, paths(spark, "a", "b"), paths(spark, "c", "d"))) == []
    assert {v for _, v in verdicts(L.deletions(known, paths(spark)))} == {"empty-enumeration"}
    assert verdicts(L.deletions(known, paths(spark, "a"))) == [(x, "ratio-guard") for x in "bcd"]
    assert {v for _, v in verdicts(L.deletions(known, paths(spark, "a"), sample_run=True))} == {"sample"}
    assert {v for _, v in verdicts(L.deletions(known, paths(spark, "a"), enabled=False))} == {"disabled"}


def test_containment_join_is_complete(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    left, right = [(i, word()) for i in range(60)] + [(99, "")], [(i, word()) for i in range(60)] + [(98, "")]
    got = {(r.l, r.r) for r in contained_pairs(spark.createDataFrame(left, "l int, x string"), spark.createDataFrame(right, "r int, y string")).collect()}
    assert got == {(i, j) for i, x in left for j, y in right if x and y and (x in y or y in x)}


def test_pages(spark):
    assert B.clamp_page(0) == (1, 0) and B.clamp_page(500) == (200, 0) and B.clamp_page(20, 7, 2) == (20, 20) and B.clamp_page(None, -3) == (50, 0)
    df = spark.range(45)
    assert [tuple(B.page_info(df, n, o).first()) for n, o in ((20, 20), (20, 40))] == [(45, 20, 20, True), (45, 20, 40, False)]
    assert B.take_page(df.orderBy("id"), 20, 60).count() == 0


def test_logs_and_sorts(spark):
    logs = spark.createDataFrame([(i, ("debug", "info", "warn", "error")[i % 4], "m", f"x{i}", {"k": "v"}) for i in range(300)], "t long, level string, mod string, msg string, fields map<string,string>")
    assert B.filter_logs(logs, "warn", tail=0).count() == 0 and B.filter_logs(logs, tail=-1).count() == 200
    assert [r.t for r in B.filter_logs(logs, "error", "X29", 5).collect()] == [299, 295, 291]
    names = spark.createDataFrame([("1", "张"), ("2", "阿"), ("3", None)], "id string, cleanTitle string")
    assert [r.id for r in B.sort_tracks(names, "title", collation="zh").collect()] == ["2", "1", "3"]


def test_streaks_and_samples(spark):
    ok = [True, False, False, True, False, False, False, True]
    rows = L.failure_streaks(spark.createDataFrame([(i, "s", v) for i, v in enumerate(ok)], "idx int, source string, ok boolean")).orderBy("start").collect()
    assert [(r.start, r.length, r.rotate) for r in rows] == [(1, 2, False), (4, 3, True)]
    pool = spark.createDataFrame([(i, "ABCDE"[i % 5] if i % 5 else "A" if i < 20 else "E") for i in range(400)], "id int, layer string")
    picked = Q.stratified_sample(pool, 100, 3)
    counts = {r.layer: r.picked for r in Q.sample_distribution(picked, pool).collect()}
    assert sum(counts.values()) == 100 and counts["A"] == 4 and all(counts[k] >= v for k, v in {"B": 15, "C": 25, "D": 15, "E": 25}.items())
    assert Q.stratified_sample(pool, 1000, 3).count() == 400
    rates = spark.createDataFrame([("A", "m", 1, 2), ("B", "m", 1, 1), ("C", "m", 0, 0)], "layer string, metric string, n int, of int")
    sizes = spark.createDataFrame([("A", 562), ("B", 44), ("C", 342)], "layer string, size int")
    assert Q.weighted_rate(rates, sizes).first().rate == pytest.approx(round((562 * 0.5 + 44) / 606 * 100, 1))


def test_entry_points():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150


def test_medians_and_progress_by_ranges(spark):
    values = {"a": [5.0, 1.0, 9.0, 9.0], "b": [2.5], "c": [7.0] * 6, None: [1.0, 1e12, 3.0, -2.0, 3.5], "d": [float(i * i % 89) for i in range(200)]}
    rows = [(k, v) for k, vs in values.items() for v in (*vs, None)] + [("e", None)]
    df = spark.createDataFrame(rows, "source string, elapsed double")
    got = {r[0]: r[1] for r in Q.upper_median(df, "source", "elapsed", ranges=7).collect()}
    assert got == {k: sorted(vs)[len(vs) // 2] for k, vs in values.items()}
    summary = Q.latency_summary(df.withColumn("q", F.expr("case when elapsed > 3 then 'x' end")), "source", 10).collect()
    assert {r.source: r.upper_median for r in summary} == got | {"e": None}
    assert {r.source: r.requests_each for r in summary} == {k: len(vs) + 1 for k, vs in values.items()} | {"e": 1}
    log = spark.createDataFrame([(s, 2) for s in (1, 5, 5, 12, 30, 31)], "second long, done long")
    got = sorted((r.second, r.done, r.rate) for r in Q.run_progress(log, 12, range_width=10).collect())
    assert got == [(1, 2, 2.0), (5, 6, 1.2), (12, 8, round(8 / 12, 6)), (30, 10, round(10 / 30, 6)), (31, 12, round(12 / 31, 6))]
