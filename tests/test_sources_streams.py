import json
import time
import uuid

from pyspark.sql import functions as F

from cadenza.sources import ingest, sinks
from cadenza.streaming import jobs


def bodies(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "n int, body string")


def test_inventory(spark, tmp_path):
    for name in ("a/b/x.mp3", "a/y.FLAC", "a/z.txt", "@eaDir/w.mp3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = ingest.file_inventory(spark, str(tmp_path)).orderBy("filePath").collect()
    assert [(r.filePath, r.fileName, r.fileExt, r.fileSizeBytes, r.dirDepth) for r in got] == [("a/b/x.mp3", "x.mp3", "mp3", 5, 2), ("a/y.FLAC", "y.FLAC", "flac", 5, 1)]


def test_candidates(spark):
    a = ingest.candidates_a(bodies(spark, {"id": 1, "name": "t", "ar": [{"name": "x"}, {"name": "y"}], "al": {"name": "al"}, "dt": 181600, "publishTime": 1000000000000}, {"id": 2, "name": "u", "artists": [{"name": "z"}], "duration": 1000}, "{bad")).orderBy("n").collect()
    assert [(r.cand_id, r.artist_text, r.album, r.year, r.duration_sec) for r in a] == [("1", "x/y", "al", 2001, 182), ("2", "z", None, None, 1)]
    b = ingest.candidates_b(bodies(spark, {"id": "m", "title": "t", "length": 61000, "artist-credit": [{"name": "x"}], "releases": [{"title": "r", "date": "1999-05"}]})).first()
    assert (b.cand_id, b.album, b.year, b.duration_sec, b.artists) == ("m", "r", 1999, 61, ["x"])
    c = ingest.search_results(bodies(spark, {"songId": 5, "songName": "n", "singer": "a、b & c"}, {"id": 1})).collect()
    assert [(r.id, r.name, r.artists) for r in c] == [("5", "n", ["a", "b", "c"])]
    t = ingest.task_records(bodies(spark, {"taskId": "7", "musicName": "n", "duration": 185000, "state": "done"}, {"id": "8", "musicInfo": '{"duration": 99}'})).collect()
    assert [(r.id, r.name, r.durationSec, r.status) for r in t] == [("7", "n", 185, "done"), ("8", None, 99, None)]
    u = ingest.unwrap(bodies(spark, {"data": [{"a": 1}, {"a": 2}]}, [{"a": 3}], {"x": 1}), ["list", "data"]).collect()
    assert sorted(r.body for r in u) == ['{"a":1}', '{"a":2}', '{"a":3}']


def test_labels(spark):
    fence = "Sure:\n```json\n[{\"id\": \"1\", \"mood\": [\"x\"]}]\n``` bye"
    labels, rejects = ingest.read_labels(bodies(spark, fence, '[{"id": "2"}] trailing', "no labels"))
    assert sorted((r.id, r.mood) for r in labels.collect()) == [("1", ["x"]), ("2", None)]
    assert [r.n for r in rejects.collect()] == [2]
    tracks = spark.range(50).selectExpr("'t' || id as id", "'a' as title", "'b' as artist", "'c' as album", "1 as year", "'p' as filePath")
    batches = ingest.label_batches(tracks).collect()
    assert sum(r.rows for r in batches) == 50 and max(r.rows for r in batches) <= 8 and "filePath" not in batches[0].payload


def test_small_files(spark, tmp_path):
    (tmp_path / "ids.csv").write_text('legacyId,path\n"1","a,b.mp3"\n2,c.mp3\nbad\n')
    got = ingest.read_legacy_ids(spark, str(tmp_path / "ids.csv")).orderBy("legacy_id").collect()
    assert [(r.legacy_id, r.file_path) for r in got] == [("1", "a,b.mp3"), ("2", "c.mp3")]
    (tmp_path / "s.LRC").write_text("[0:01]x\ny")
    lyric = ingest.sidecar_lyrics(spark, str(tmp_path)).first()
    assert lyric.stem.endswith("/s") and lyric.lyrics == "[0:01]x\ny"
    (tmp_path / "c.json").write_text(json.dumps({"id": "1", "path": "a/b.mp3", "genres": [{"name": "g"}, {"name": ""}], "artists": [{"name": "x"}], "duration": 61.4}))
    song = ingest.catalog_to_tags(ingest.read_catalog(spark, str(tmp_path / "c.json"))).first()
    assert (song.genre, song.artist, song.year, song.durationSec, song.fileExt, song.dirDepth) == ("g", "x", 0, 61, "mp3", 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"', ["x", "y"], None)], "id string, title string, mood array<string>, year int")
    assert sinks.csv_lines(df, ["id", "title", "mood", "year"]).first().line == '"1","a ""q""","x y",""'
    sinks.export_csv(df.coalesce(1), str(tmp_path / "c"), ["id", "title", "mood", "year"])
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "c").glob("*.csv"))
    assert text == '"id","title","mood","year"\r\n"1","a ""q""","x y",""\r\n'
    assert sinks.export_json(df, str(tmp_path / "j")).first().total == 1
    sinks.write_catalog(df.withColumn("filePath", F.lit("p")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert sinks.markdown_lines(df, ["id", "year"]).first().line == "| 1 |  |"
    sinks.failure_list(spark.createDataFrame([("a", None), ("b", "bad")], "filePath string, why string"), str(tmp_path / "f"), "L1", "why")
    assert "b,L1,bad" in "".join(p.read_text() for p in (tmp_path / "f").glob("*.csv"))


def batches_of(spark, tmp_path, *frames):
    """A file stream that reads one file at a time, in the order given."""
    folder = tmp_path / uuid.uuid4().hex
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").json(str(folder / f"{i}"))
    schema = frames[0].schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", 1).json(str(folder))


def memory(spark, df, mode):
    name = "m" + uuid.uuid4().hex
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_history_and_telemetry(spark, tmp_path):
    plays = [spark.createDataFrame([("a", f"2024-01-0{i} 00:00:00", i), ("b", "2024-01-01 00:00:00", 9)], "track_id string, t string, duration_sec int").selectExpr("track_id", "cast(t as timestamp) as played_at", "duration_sec") for i in (1, 2)]
    got = memory(spark, jobs.play_history(batches_of(spark, tmp_path, *plays)), "complete").collect()
    assert sorted((r.track_id, r.plays, r.duration_sec) for r in got) == [("a", 2, 2), ("b", 2, 9)]
    rows = [spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "s", h != 1, 1.0)], "t string, source string, ok boolean, elapsed double").selectExpr("cast(t as timestamp) as ts", "source", "ok", "elapsed") for h in (1, 2, 5)]
    got = memory(spark, jobs.live_telemetry(batches_of(spark, tmp_path, *rows)), "append").collect()
    assert sorted((str(r.start), r.n, r.failed) for r in got)[:2] == [("2024-01-01 01:00:00", 1, 1), ("2024-01-01 02:00:00", 1, 0)]


def test_completions(spark, tmp_path):
    make = lambda minute, *ids: spark.createDataFrame([("s", i, "success", f"2024-01-01 00:{minute:02d}:00") for i in ids], "source string, id string, status string, t string").selectExpr("source", "id", "status", "cast(t as timestamp) as ts")
    with jobs.keyed_state(spark):
        got = memory(spark, jobs.new_completions(batches_of(spark, tmp_path, make(0, "a", "b"), make(5, "b", "c"), make(5, "d"), make(9, "e", "f", "e"))), "append").collect()
    assert [(r.at % 3_600_000 // 60_000, r.completed) for r in sorted(got)] == [(5, 1), (9, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_completions_are_forgotten_after_a_time(spark, tmp_path):
    make = lambda minute, *ids: spark.createDataFrame([("s", i, "success", f"2024-01-01 00:{minute:02d}:00") for i in ids], "source string, id string, status string, t string").selectExpr("source", "id", "status", "cast(t as timestamp) as ts")
    folder, name = tmp_path / "polls", "m" + uuid.uuid4().hex
    make(0, "a", "b").coalesce(1).write.mode("append").json(str(folder))
    stream = jobs.new_completions(spark.readStream.schema("source string, id string, status string, ts timestamp").json(str(folder)), ttl=1000)
    with jobs.keyed_state(spark):
        run = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="200 milliseconds").start()
    def wait(done):
        deadline = time.time() + 40
        while not done() and time.time() < deadline:
            time.sleep(0.3)

    try:
        wait(lambda: sum(p.numInputRows for p in run.recentProgress) >= 2)
        time.sleep(3)
        make(5, "a", "b").coalesce(1).write.mode("append").json(str(folder))  # the same ids, new since they were forgotten
        wait(lambda: spark.table(name).count())
    finally:
        run.stop()
    assert [r.completed for r in spark.table(name).collect()] == [2]


def test_completions_are_remembered_up_to_a_number(spark, tmp_path):
    def poll(minute, ids, status="success"):
        return spark.createDataFrame([("s", i, status, f"2024-01-01 00:{minute:02d}:00") for i in ids], "source string, id string, status string, t string").selectExpr("source", "id", "status", "cast(t as timestamp) as ts")

    many = [f"x{i}" for i in range(6000)]
    polls = [poll(0, ["a"], "running"), poll(5, many), poll(6, many[3000:]), poll(10, many), poll(20, [None, "b"], None), poll(30, ["b"])]
    with jobs.keyed_state(spark):
        got = memory(spark, jobs.new_completions(batches_of(spark, tmp_path, *polls)), "append").collect()
    # the first poll is the baseline, though nothing had finished; of 6000 ids the oldest 2500 were forgotten, in the order of the rows
    assert [(r.at % 3_600_000 // 60_000, r.completed) for r in sorted(got)][0] == (5, 6000)
    later = {r.at % 3_600_000 // 60_000: r.completed for r in got}
    assert sum(later.get(m, 0) for m in (6, 10)) >= 2500 and 20 not in later and later[30] == 1


def test_refresh(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "filePath string, mtime long, size long")
    stream = batches_of(spark, tmp_path, make(("a", 1, 1), ("b", 1, 1)), make(("a", 2, 5), ("c", 1, 1)))
    jobs.refresh_catalog(stream, spark, str(tmp_path / "catalog"), str(tmp_path / "check")).awaitTermination()
    got = jobs.read_catalog(spark, str(tmp_path / "catalog")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 2, 5), ("b", 1, 1), ("c", 1, 1)]


def test_whole_listings_delete_under_guards(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "filePath string, mtime long, size long")
    stream = batches_of(spark, tmp_path, make(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), make(("a", 2, 5), ("b", 1, 1)), make(("d", 1, 1)))
    jobs.refresh_catalog(stream, spark, str(tmp_path / "catalog"), str(tmp_path / "check"), whole=True).awaitTermination()
    rows = lambda n: sorted(tuple(r) for r in jobs.read_catalog(spark, str(tmp_path / "catalog"), n).collect())
    assert rows(1) == [("a", 2, 5), ("b", 1, 1)]
    assert rows(2) == [("a", 2, 5), ("b", 1, 1), ("d", 1, 1)]  # two of two gone are too many
    assert not (tmp_path / "catalog" / "manifest" / "version=0").exists()


def test_a_batch_writes_only_the_buckets_that_it_changes(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(list(rows), "filePath string, mtime long, size long")
    every = [(f"f{i}", 1, 1) for i in range(600)]
    stream = batches_of(spark, tmp_path, make(every), make([("f5", 2, 1), ("f6", 1, 1), ("new", 1, 1)]), make(every[10:20]))
    folder = tmp_path / "catalog"
    jobs.refresh_catalog(stream, spark, str(folder), str(tmp_path / "check")).awaitTermination()
    written = sorted(p.name for p in (folder / "data" / "version=1").iterdir() if p.is_dir())
    touched = {r.b for r in spark.createDataFrame([("f5",), ("new",)], "p string").select(jobs._bucket(F.col("p")).alias("b")).collect()}
    assert written == sorted(f"bucket={b}" for b in touched)
    assert not (folder / "data" / "version=2").exists()  # nothing changed
    want = [("f5", 2, 1) if r[0] == "f5" else r for r in every] + [("new", 1, 1)]
    assert sorted(map(tuple, jobs.read_catalog(spark, str(folder)).collect())) == sorted(want)


def test_sidecar_files(spark, tmp_path):
    (tmp_path / "s" / "x").mkdir(parents=True)
    (tmp_path / "s" / "x" / "one.LRC").write_text("la\nla")
    (tmp_path / "s" / "two.txt").write_text("no")
    got = ingest.sidecar_lyrics(spark, str(tmp_path / "s")).collect()
    assert [(r.stem.rsplit("/", 2)[1:], r.lyrics) for r in got] == [(["x", "one"], "la\nla")]


def test_one_small_file_is_worked_on_in_many_tasks(spark, tmp_path):
    """A file of a few MB is one split, whatever the rows cost."""
    from cadenza.operators.clean import clean_tracks
    from cadenza.plans import QUERIES

    names = "filePath string, fileName string, dirDepth int, title string, artist string, album string, year int, lyrics string, durationSec int"
    files = spark.createDataFrame([(f"a/b/{i}.mp3", f"{i}.mp3", 2, f"t{i}", "x", "y", 2000, None, 100) for i in range(200)], names).coalesce(1)
    assert clean_tracks(files, "2024-01-01").rdd.getNumPartitions() > 1
    spark.range(200).selectExpr("id as p_partkey", "'red ring' as p_name", "'Brand#1' as p_brand").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert QUERIES["p20_artist_similarity"](spark, str(tmp_path)).rdd.getNumPartitions() > 1
    sinks.write_catalog(spark.range(2000).selectExpr("cast(id as string) as id", "concat('f', id) as filePath").coalesce(1), str(tmp_path / "catalog"))
    kept = spark.read.parquet(str(tmp_path / "catalog")).groupBy(F.input_file_name()).agg(F.min("filePath").alias("a"), F.max("filePath").alias("b")).orderBy("a").collect()
    assert len(kept) > 1 and all(x.b < y.a for x, y in zip(kept, kept[1:]))


def test_completions_in_slots_give_the_same_signals(spark, tmp_path):
    def poll(minute, source, ids, status="success"):
        return spark.createDataFrame([(source, i, status, f"2024-01-01 00:{minute:02d}:00") for i in ids], "source string, id string, status string, t string").selectExpr("source", "id", "status", "cast(t as timestamp) as ts")

    ids = [f"x{i}" for i in range(200)]
    polls = [poll(0, "s", ["a"], "running").unionByName(poll(0, "r", ids)), poll(5, "s", ids).unionByName(poll(5, "r", ids)), poll(5, "s", ["late"]), poll(9, "r", [*ids, "y"]), poll(20, "s", [None, "b"], None), poll(30, "s", ["b", *ids])]
    signals = {}
    with jobs.keyed_state(spark):
        for n in (1, 8):
            stream = jobs.new_completions(batches_of(spark, tmp_path / str(n), *polls), slots=n)
            signals[n] = sorted((r.source, r.at % 3_600_000 // 60_000, r.completed) for r in memory(spark, stream, "append").collect())
    assert signals[8] == signals[1] == [("r", 9, 1), ("s", 5, 200), ("s", 30, 1)]
