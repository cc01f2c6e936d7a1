"""Structured Streaming jobs: catalog refresh, play history, new completions, live telemetry.

State lives in Spark's checkpointed state store; late rows are dropped an hour behind the newest.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cadenza.operators.link import changed_files, deletions, remove, upsert
from cadenza.sources.shared import path_exists

LATE = "1 hour"
COOLDOWN_MS = 60_000
#: Ids of a source that are remembered.
SEEN = 5000


#: Buckets of paths that a catalog is stored in, unless a caller says more; a batch rewrites those that it changes.
BUCKETS = 64


def _bucket(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, catalog: str, version: int) -> dict[int, str]:
    """bucket -> folder of one version of a catalog; at most a row for each bucket."""
    if version < 0:
        return {}
    rows = spark.read.schema("bucket int, path string").parquet(f"{catalog}/manifest/version={version}").collect()
    return {r["bucket"]: r["path"] for r in rows}


def _buckets(spark: SparkSession, manifest: dict[int, str], schema: str, wanted: set[int] | None = None) -> DataFrame:
    paths = [p for k, p in sorted(manifest.items()) if wanted is None or k in wanted]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


CATALOG = "filePath string, mtime long, size long"


def read_catalog(spark: SparkSession, catalog: str, version: int | None = None) -> DataFrame:
    """The files of a version of a catalog, by default the newest."""
    if version is None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{catalog}/manifest")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        version = max((int(x.getPath().getName().split("=")[1]) for x in there if x.isDirectory()), default=-1)
    return _buckets(spark, _manifest(spark, catalog, version), CATALOG)


def refresh_catalog(listing: DataFrame, spark: SparkSession, catalog: str, checkpoint: str, *, whole: bool = False, most: float = 0.5, buckets: int = BUCKETS) -> StreamingQuery:
    """Files of a stream (filePath, mtime, size) into versions of a catalog, changed ones only; ``read_catalog`` gives a version.

    A version is a manifest that names a folder for each bucket of paths. A batch reads the buckets that its paths fall
    into, writes those in which something changed, and a manifest that names the old folders for all others; one that
    changes nothing writes a manifest only. A batch that is run again starts from the same version and writes the same.
    Manifests but the last two, and folders that only they name, are removed. If a batch is a ``whole`` enumeration,
    known files that it lacks go, unless it is empty or lacks more than the share ``most`` of them; it reads all buckets.
    ``buckets`` is fixed for the life of a catalog: the more there are, the less a batch of few paths rewrites.
    """

    def delete(path: str) -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    def apply(batch: DataFrame, number: int) -> None:
        session, base = batch.sparkSession, _manifest(spark, catalog, number - 1)
        kinds = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in CATALOG.split(", "))]
        fresh = batch.groupBy("filePath").agg(F.max_by(F.struct("mtime", "size"), F.struct("mtime", "size")).alias("f")).select("filePath", "f.mtime", "f.size").select(*kinds)
        at = _bucket(F.col("filePath"), buckets).alias("bucket")
        numbers = lambda df: {r["bucket"] for r in df.select(at).distinct().collect()}  # noqa: E731  at most ``buckets``
        known = _buckets(session, base, CATALOG, None if whole else numbers(fresh))
        changed = changed_files(fresh, known).drop("reason")
        gone = deletions(known, fresh, most=most).where("verdict = 'removed'").select("filePath") if whole and number else known.select("filePath").limit(0)
        touched = numbers(changed.select("filePath").unionByName(gone))
        if touched:
            kept = remove(_buckets(session, base, CATALOG, touched), gone, "filePath")
            new = upsert(kept, changed, "filePath").withColumn("bucket", at)
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{catalog}/data/version={number}")
        left = numbers(session.read.schema(CATALOG).parquet(f"{catalog}/data/version={number}")) if touched else set()
        named = {k: p for k, p in base.items() if k not in touched} | {k: f"{catalog}/data/version={number}/bucket={k}" for k in left}
        rows = session.createDataFrame(sorted(named.items()), "bucket int, path string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{catalog}/manifest/version={number}")
        if number > 1:
            before = _manifest(spark, catalog, number - 2) if path_exists(spark, f"{catalog}/manifest/version={number - 2}") else {}
            for path in set(before.values()) - set(base.values()) - set(named.values()):
                delete(path)
            delete(f"{catalog}/manifest/version={number - 2}")

    return listing.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def play_history(plays: DataFrame) -> DataFrame:
    """Running latest play, its duration and number of plays of each track; in update mode a batch holds the tracks that it changed."""
    return plays.groupBy("track_id").agg(F.max("played_at").alias("played_at"), F.max_by("duration_sec", F.struct("played_at", "duration_sec")).alias("duration_sec"), F.count(F.lit(1)).alias("plays"))


def live_telemetry(attempts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Attempts, failures and mean time by source and tumbling window."""
    w = F.window("ts", width)
    return attempts.withWatermark("ts", LATE).groupBy(w.alias("w"), "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.avg("elapsed").alias("mean")).select(F.col("w.start").alias("start"), "source", "n", "failed", "mean")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which map state and times to live need; others are as before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Completions(StatefulProcessor):
    """One source's baseline, seen ids and cool-down.

    The first batch of a source is its baseline. After it, a batch in which ids finished that weren't seen before gives a
    signal with the newest of their times, at least ``cooldown`` ms after the last. Ids are numbered as they come. At the end of a batch, while over
    ``most`` are known, the older half of ``most`` is forgotten; with a ``ttl``, ids that no batch held for so many ms go too.
    """

    def __init__(self, most: int, cooldown: int, ttl: int | None):
        self.most, self.cooldown, self.ttl = most, cooldown, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id string", "number long", self.ttl)
        self.order = handle.getMapState("order", "number long", "id string", self.ttl)
        self.known = handle.getValueState("known", "first long, next long, last long")

    def remember(self, rows: Iterator[pd.DataFrame]) -> tuple[int, int, int, int]:
        """The new ids' number and newest time, and the numbers of the first known id and the next."""
        first, start, _ = self.known.get() if self.known.exists() else (0, 0, 0)
        number, now, fresh = start, 0, 0
        for piece in rows:  # one piece at a time: neither a source's batch nor its ids are held as a whole
            finished = piece[piece["done"] & piece["id"].notna()].groupby("id", sort=False)["at"].max()
            for id_, ended in finished.items():
                old = self.seen.getValue((id_,))
                at = number if old is None else old[0]
                if at >= start:  # new in this batch
                    now = max(now, int(ended))
                    if old is not None:
                        continue
                    number, fresh = number + 1, fresh + 1
                self.seen.updateValue((id_,), (at,))
                self.order.updateValue((at,), (id_,))
        while number - first > self.most:
            cut = min(first + (self.most + 1) // 2, number)
            for n in range(first, cut):
                id_ = self.order.getValue((n,))
                if id_ is not None:
                    self.order.removeKey((n,))
                    if self.seen.getValue(id_) == (n,):
                        self.seen.removeKey(id_)
            first = cut
        return fresh, now, first, number

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        primed = self.known.exists()
        last = self.known.get()[2] if primed else 0
        fresh, now, first, number = self.remember(rows)
        fire = primed and fresh > 0 and now - last >= self.cooldown
        self.known.update((first, number, now if fire else last))
        if fire:
            yield pd.DataFrame({"source": [key[0]], "at": [now], "completed": [fresh]})

    def close(self) -> None:
        pass


class SlotCompletions(Completions):
    """The seen ids of one slot of a source: in every batch their new number and newest time, for ``Signals``."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh, now, first, number = self.remember(rows)
        self.known.update((first, number, 0))
        yield pd.DataFrame({"source": [key[0]], "at": [now], "completed": [fresh]})


class Signals(StatefulProcessor):
    """One source's baseline and cool-down over what its slots found, a row for each slot."""

    def __init__(self, cooldown: int):
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        primed = self.last.exists()
        last, now, fresh = self.last.get()[0] if primed else 0, 0, 0
        for piece in rows:
            now, fresh = max(now, int(piece["at"].max())), fresh + int(piece["completed"].sum())
        fire = primed and fresh > 0 and now - last >= self.cooldown
        self.last.update((now if fire else last,))
        if fire:
            yield pd.DataFrame({"source": [key[0]], "at": [now], "completed": [fresh]})

    def close(self) -> None:
        pass


def new_completions(tasks: DataFrame, most: int = SEEN, cooldown: int = COOLDOWN_MS, ttl: int | None = None, slots: int = 1) -> DataFrame:
    """Refresh signals (source, at, completed) of a stream of tasks (source, id, status, ts): ids that finished since the batch before.

    One stateful operator (``Completions``); start the stream inside ``keyed_state``. Polls that repeat all finished tasks
    are the expected input: ids are forgotten by number and by age only, never while ``most`` of them are fewer. Within
    one batch the order of ids is that of its rows after the shuffle. Rows of a null id or status only make the baseline;
    those of a null ts count as old. A ``ttl`` is in ms of the machine's time; Spark then runs batches without data as well, so
    that a stream with the trigger ``availableNow`` wouldn't end: give such a stream a trigger by time.

    With ``slots`` the ids of a source are spread by hash over so many states and tasks, and a second operator has its baseline and
    cool-down. Each slot then forgets by itself, while over ``most`` / ``slots`` of its ids are known.
    """
    at = F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(0).cast("bigint"))
    rows = tasks.select("source", F.col("id").cast("string").alias("id"), at.alias("at"), F.coalesce(F.col("status") == "success", F.lit(False)).alias("done"))
    found, mode = "source string, at long, completed long", "none" if ttl is None else "processingTime"
    if slots == 1:
        return rows.groupBy("source").transformWithStateInPandas(Completions(most, cooldown, ttl), found, "append", mode)
    each = rows.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots))).groupBy("source", "slot").transformWithStateInPandas(SlotCompletions(-(-most // slots), cooldown, ttl), found, "append", mode)
    return each.groupBy("source").transformWithStateInPandas(Signals(cooldown), found, "append", mode)
