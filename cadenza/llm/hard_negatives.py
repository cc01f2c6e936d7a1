"""Hard negatives by rotated one-bit codes whose deterministic intervals spare exact scores.

A vector is rotated at random and kept as the signs of its components: a unit code vector x. Its alignment, the inner
product of the normalised vector with x, is stored too. For an anchor q the vector's component along x gives
alignment * <x, q>; the rest of it, of length sqrt(1 - alignment^2), meets at most the part of q that is orthogonal to x, so
by Cauchy and Schwarz the score lies in an interval about the estimate (after RaBitQ, Gao and Long 2024, but with this
certain bound in place of the probable one). <x, q> comes from popcounts of the code with the bit planes of q, rounded
to PLANES bits; what rounding loses is bounded by the same inequality. Rows whose interval can't reach what is asked are
left out, all others are scored in integers.

Rows and anchors are dealt into blocks, and every block of rows meets every block of anchors in a task of its own. No
block is ever larger than a parameter says, and a task gives a bounded number of rows for each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, named

#: Bits to which an anchor's rotated components are rounded.
PLANES = 8
#: Rows and anchors of a block at most (about); rows of one where there are few, so that all cores have work.
BLOCK_ROWS, BLOCK_ANCHORS, FEW_ROWS = 65_536, 16_384, 4_096
#: Rows of the highest estimates, for each one asked for, that are scored first to find what the others must reach.
SEEDS = 4
#: What rounding of doubles may do to an interval, as a share of the norms' product.
SLACK = 1e-9

CODES = "uid bigint, vec_id bigint, label bigint, ints binary, code binary, norm double, alignment double, asked boolean"


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0] if dims else np.zeros((0, 0))


def most_component(dims: int) -> int:
    """The largest component with which no inner product leaves 62 bits, nor a component 31."""
    return min(2**31 - 1, math.isqrt(2**62 // max(dims, 1)))


def _encode(turned, dims: int, scale: int):
    """vec_id, label, vec, asked -> CODES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, task, read, most = np.frombuffer(turned.value).reshape(dims, dims), TaskContext.get().partitionId(), 0, most_component(dims)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                values = np.zeros((part.num_rows, dims))
                lists = part.column("vec")
                sizes = np.diff(lists.offsets.to_numpy())
                values[np.arange(dims)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    ints = np.clip(np.floor(scale * values), -most, most)
                norm = np.sqrt((ints * ints).sum(1))
                rotated = (ints @ turn) / np.where(norm > 0, norm, 1)[:, None]
                codes = np.packbits(rotated > 0, axis=1, bitorder="little")
                codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8)))
                alignment = np.abs(rotated).sum(1) / math.sqrt(max(dims, 1))
                uid = (np.int64(task) << np.int64(36)) + np.arange(read, read + part.num_rows)
                read += part.num_rows
                blobs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (ints.astype("<i4"), codes)]
                columns = [pa.array(uid), part.column("vec_id"), part.column("label"), *blobs, pa.array(norm), pa.array(alignment), part.column("asked")]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "vec_id", "label", "ints", "code", "norm", "alignment", "asked"])

    return run


class Block:
    """The rows of a table of CODES as arrays."""

    def __init__(self, table: pa.Table, dims: int):
        table = table.combine_chunks()
        self.n = table.num_rows
        self.vec_id, self.label, self.norm, self.alignment = (table.column(c).to_numpy() for c in ("vec_id", "label", "norm", "alignment"))
        self.ints = np.frombuffer(b"".join(table.column("ints").to_pylist()), "<i4").reshape(self.n, dims)
        self.codes = np.frombuffer(b"".join(table.column("code").to_pylist()), "<u8").reshape(self.n, -(-dims // 64))
        self.ones = np.bitwise_count(self.codes).sum(1, dtype=np.int64)
        self.rest = np.sqrt(np.maximum(0, 1 - self.alignment**2)) + SLACK

    def intervals(self, anchor: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above the integer score of each row with the integer vector ``anchor``."""
        dims = len(anchor)
        if not dims:
            return np.zeros(self.n), np.zeros(self.n)
        q = anchor @ turn
        norm, low, step = np.sqrt(anchor @ anchor), q.min(), max((q.max() - q.min()) / (2**PLANES - 1), 1e-300)
        rounded = np.clip(np.rint((q - low) / step), 0, 2**PLANES - 1).astype(np.int64)
        off = np.sqrt(((low + step * rounded - q) ** 2).sum()) + SLACK * norm
        bits = ((rounded[None, :] >> np.arange(PLANES)[:, None]) & 1).astype(np.uint8)
        planes = np.packbits(bits, axis=1, bitorder="little")
        planes = np.ascontiguousarray(np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8)))).view("<u8")
        met = np.zeros(self.n, np.int64)
        for j, plane in enumerate(planes):
            met += np.bitwise_count(self.codes & plane).sum(1, dtype=np.int64) << j
        along = (2 * (step * met + low * self.ones) - (step * rounded.sum() + dims * low)) / math.sqrt(dims)
        across = np.sqrt(np.maximum(0, norm**2 - np.maximum(0, np.abs(along) - off) ** 2))
        wide = self.alignment * off + self.rest * across + SLACK * norm
        return self.norm * (self.alignment * along - wide), self.norm * (self.alignment * along + wide)

    def score(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.ints[rows].astype(np.int64) @ anchor


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k`` by score descending, then id."""
    return np.lexsort((ids, -scores))[:k]


def _sure(block: Block, rows: np.ndarray, middle: np.ndarray, anchor: np.ndarray, k: int, a: float = -np.inf, b: float = np.inf) -> float:
    """A score that ``k`` of ``rows`` have or exceed within a and b, for certain: the k-th of those that are scored because
    their estimates ``middle`` are the highest there. Rows whose intervals end below it can't be among the first k."""
    near = np.flatnonzero((middle >= a) & (middle <= b))
    if len(near) > SEEDS * k:
        near = near[np.argpartition(middle[near], -SEEDS * k)[-SEEDS * k :]]
    score = block.score(rows[near], anchor)
    score = score[(score >= a) & (score <= b)]
    return float(np.partition(score, -k)[-k]) if len(score) >= k else -np.inf


def _positives(turned, dims: int, k: int):
    """Blocks of rows and anchors -> the first ``k`` positives of each anchor among these rows."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        turn, out = np.frombuffer(turned.value).reshape(dims, dims), []
        if rows.num_rows and anchors.num_rows:
            block, asked = Block(rows, dims), Block(anchors, dims)
            by_label = {y: np.flatnonzero(block.label == y) for y in np.unique(block.label)}
            for i, uid in enumerate(anchors.column("uid").to_pylist()):
                anchor = asked.ints[i].astype(np.int64)
                same = by_label.get(asked.label[i], np.zeros(0, np.int64))
                same = same[block.vec_id[same] != asked.vec_id[i]]
                low, high = block.intervals(anchor, turn)
                same = same[high[same] >= _sure(block, same, (low[same] + high[same]) / 2, anchor, k)]
                score = block.score(same, anchor)
                out += [(uid, int(block.vec_id[same[j]]), int(score[j])) for j in _first(score, block.vec_id[same], k)]
        return pa.table({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("uid", "positive_id", "positive_score"))})

    return run


def _negatives(turned, dims: int, k: int, least: int, most: int):
    """Blocks of rows and anchors with their positives -> for each positive the first ``k`` negatives among these rows."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        turn, out = np.frombuffer(turned.value).reshape(dims, dims), []
        if rows.num_rows and anchors.num_rows:
            block, asked = Block(rows, dims), Block(anchors, dims)
            others = {y: np.flatnonzero(block.label != y) for y in np.unique(asked.label)}
            for i, (uid, found) in enumerate(zip(anchors.column("uid").to_pylist(), anchors.column("positives").to_pylist(), strict=True)):
                anchor, other = asked.ints[i].astype(np.int64), others[asked.label[i]]
                low, high = block.intervals(anchor, turn)
                low, high = low[other], high[other]
                middle = (low + high) / 2
                bounds = [(-(-least * p["positive_score"] // 100), most * p["positive_score"] // 100) for p in found]
                open_ = np.zeros(len(other), bool)
                for a, b in set(bounds):
                    open_ |= (high >= max(a, _sure(block, other, middle, anchor, k, a, b))) & (low <= b)
                near = other[open_]
                score = block.score(near, anchor)
                for p, (a, b) in zip(found, bounds, strict=True):
                    inside = np.flatnonzero((score >= a) & (score <= b))
                    best = inside[_first(score[inside], block.vec_id[near[inside]], k)]
                    out += [(uid, p["place"], int(block.vec_id[near[j]]), int(score[j])) for j in best]
        return pa.table({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("uid", "place", "negative_id", "negative_score"))})

    return run


def _dealt(uid: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(uid), F.lit(blocks)).cast("int")


def _first_of(df: DataFrame, k: int, by: list[str], score: str, then: str, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(then))
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, key: str = "vec_id", vec: str = "embedding", label: str | Column = "label"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). A score is the integer inner product of a row with the anchor. The anchors are the
    rows of the condition ``anchors``; an anchor's positives are its first ``positives`` other rows of its label; for each of
    them the first ``negatives`` rows of other labels come back whose score is from ``least`` to ``most`` percent of the
    positive's. First means by score descending, ties by the smaller key.

    Rows with a null key, label or vector, or a null or non-finite component, take no part. Shorter vectors count as if
    zeros followed. Components beyond 31 bits, or with which a score could leave 62 bits, count as the largest that
    can't. Rows that repeat a key are rows of their own, but none is a positive of an anchor of its key; an anchor that
    repeats has results for each time. Anchors without positives, or positives without such negatives, have no
    rows. An empty table gives an empty one. Other columns aren't read.
    """
    spark = vectors.sparkSession
    given = label if isinstance(label, Column) else named(label)
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(named(key).cast("bigint").alias("vec_id"), given.cast("bigint").alias("label"), named(vec).cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    rows = rows.where("vec_id is not null and label is not null and vec is not null").where(fine)
    dims, n, n_anchors = rows.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)), F.count(F.lit(1)), F.count_if("asked")).first()
    turned = spark.sparkContext.broadcast(rotation(dims).tobytes())  # dims^2 numbers
    codes = materialize(rows.mapInArrow(_encode(turned, dims, scale), CODES), "codes")
    shards = max(1, -(-n // BLOCK_ROWS), min(-(-n // FEW_ROWS), 2 * spark.sparkContext.defaultParallelism))
    groups = max(1, -(-n_anchors // BLOCK_ANCHORS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    blocks = codes.drop("asked").withColumn("shard", _dealt(F.col("uid"), shards)).withColumn("part", every(groups)).groupBy("shard", "part")
    asked = materialize(codes.where("asked").drop("asked").withColumn("part", _dealt(F.col("uid"), groups)), "anchors")
    meet = lambda df, f, out: blocks.cogroup(df.withColumn("shard", every(shards)).groupBy("shard", "part")).applyInArrow(f, out)

    found = meet(asked, _positives(turned, dims, positives), "uid bigint, positive_id bigint, positive_score bigint")
    found = materialize(_first_of(found, positives, ["uid"], "positive_score", "positive_id", "place"), "positives")
    own = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), "positive_score"))).alias("positives"))
    near = meet(materialize(asked.join(own, "uid"), "asked"), _negatives(turned, dims, negatives, least, most), "uid bigint, place bigint, negative_id bigint, negative_score bigint")
    near = _first_of(near, negatives, ["uid", "place"], "negative_score", "negative_id", "rank")
    out = near.join(found, ["uid", "place"]).join(asked.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
