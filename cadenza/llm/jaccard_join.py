"""Near duplicates by an exact Jaccard join over word shingles, with parity sketches.

A document's sketch XORs the hash of each distinct shingle into one of S blocks. Two sketches differ in no
more blocks than the documents' shingle sets differ in shingles, so sets within a symmetric difference of d
agree on at least S - d blocks: the pigeonhole. Documents whose Jaccard similarity can reach 4/5 differ in at
most (m + 5m/4) / 9 shingles, m being the smaller size, so S follows from a band of sizes. A document at
the edge of two bands is sketched for both.

With S of about twice the bound, a document may leave out its blocks that other documents most likely share
by chance, those of the fewest shingles, and still share a kept block with every partner: both sides rank
blocks by the same rule, at least S - d blocks agree, and fewer than that are left out. Kept blocks are
joined on their values. Sets of few shingles meet on shingles instead. A second, dense sketch of PARITY_BITS bits bounds the difference of such a pair from
below by its Hamming distance and drops pairs that can't link; the others are verified on the shingle sets. Sets
are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import TokenHashes, materialize, space_tokens
from cadenza.llm.components import connected_components

WIDTH = 5
#: Sizes up to SMALLEST_BAND * 2^k share a band.
SMALLEST_BAND = 4
#: Sets of up to so many shingles meet on shingles instead of blocks: so few leave most blocks of a sketch empty, and empty
#: blocks are equal whatever the texts. Two such sets of similarity 4/5 or more share one of the first shingles of each, in hash order.
SMALL = 12
#: Bits of the filter, sent to the tasks, on ids of documents whose shingles are needed: 2 MiB at any input size.
FILTER_BITS = 24
#: Bits of the dense sketch, held as longs.
PARITY_BITS = 1024
PARITY = [f"p{i}" for i in range(PARITY_BITS // 64)]

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[2]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(tokens: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` token hashes; of the whole sequence if it is shorter; none of an empty one."""
    n = len(tokens)
    if n == 0:
        return tokens
    run, count = min(n, width), max(1, n - width + 1)
    out = np.full(count, run, np.uint64)
    for k in range(run):
        out = _mix(out * _ODD[0] + tokens[k : k + count])
    return out


def _distinct(hashes: TokenHashes, text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(hashes.array(space_tokens(text))))


def most_apart(smaller: int) -> int:
    """The largest symmetric difference of two sets of Jaccard similarity 4/5 or more, the smaller one of this size."""
    return (smaller + smaller * 5 // 4) // 9


def band(size: int) -> int:
    return max(0, -(-size // SMALLEST_BAND) - 1).bit_length()


def bands(size: int) -> list[int]:
    """Bands of ``size`` and of the smallest size that it can link with; none if only an equal set can link with it."""
    if most_apart(size) == 0:
        return []
    return sorted({band(size), band(-(-size * 4 // 5))})


def block_keys(sets: np.ndarray, level: int) -> np.ndarray:
    """Keys of the kept blocks of a sorted set of hashes, at a band."""
    top = SMALLEST_BAND << level
    blocks = 2 * (most_apart(top) + 1)
    keep = most_apart(min(len(sets), top)) + 1
    at = ((sets >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # sorted as the hashes are
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    counts = np.diff(np.r_[first, len(sets)])
    place = _mix(at[first] + np.uint64((level + 1) << 40))
    keys = _mix(np.bitwise_xor.reduceat(sets, first) ^ place)
    if len(first) > keep:  # the same order for every document: more shingles first, then by key
        keys = keys[np.lexsort((keys, -counts))[:keep]]
    elif len(first) < keep:
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at[first], assume_unique=True)
        keys = np.r_[keys, np.sort(_mix(_mix(empty + np.uint64((level + 1) << 40))))[: keep - len(first)]]
    return keys


def prefix_keys(sets: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set of hashes, as many as a linked set can't all lack."""
    return _mix(sets[: len(sets) - -(-len(sets) * 4 // 5) + 1] ^ _ODD[1])


def set_keys(sets: np.ndarray) -> np.ndarray:
    """The keys of a set, of which two sets that link share one: prefixes of small sets, and of those that can link with a
    small one; blocks of the others."""
    found = [block_keys(sets, level) for level in bands(len(sets))] if len(sets) > SMALL else []
    if -(-len(sets) * 4 // 5) <= SMALL:
        found.append(prefix_keys(sets))
    return np.unique(np.concatenate(found))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, size, class (hash of the whole set), check (a second one), block keys."""
    hashes, seen = TokenHashes(), set()
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            sizes, classes, checks, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                sets = _distinct(hashes, text)
                sizes.append(len(sets))
                if not len(sets):
                    classes.append(None), checks.append(None), keys.append([])
                    continue
                digest = xxhash.xxh3_128(sets.tobytes()).intdigest()
                name = (digest & (2**64 - 1)) - 2**63
                classes.append(name), checks.append((digest >> 64) - 2**63)
                if name in seen:  # the task has given this set's keys
                    keys.append([])
                    continue
                if len(seen) < 200_000:
                    seen.add(name)
                keys.append(set_keys(sets).view(np.int64) if most_apart(len(sets)) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "class", "check", "keys"],
            )


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, class, sorted -> the rows, each once, of the keys with more than one class. Holds one batch."""
    last = None  # key, class, and whether it was given, of the last row so far
    for batch in batches:
        key, cls = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "class"))
        if not len(key):
            continue
        if last is not None:
            key, cls = np.r_[last[0], key], np.r_[last[1], cls]
        new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]
        key, cls = key[new], cls[new]
        same = key[1:] == key[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        given = bool(shared[-1])
        if last is not None:
            shared[0] &= not last[2]
            given |= len(key) == 1 and last[2]
        last = (key[-1], cls[-1], given)
        out = np.flatnonzero(shared)
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, cls)], ["key", "class"])


def parity_sketch(sets: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as int64: each hash flips one. Two sketches differ in no more bits than the sets in hashes."""
    odd = np.bincount((sets & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _needed(bits_shared):
    """slot, text -> class, shingles, dense sketch, for the ids that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hashes = np.unpackbits(np.frombuffer(bits_shared.value, np.uint8)), TokenHashes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                slot = batch.column("slot").to_numpy(zero_copy_only=False)
                few = batch.take(pa.array(np.flatnonzero(bits[slot])))
                sets = [_distinct(hashes, t) for t in few.column("text").to_pylist()]
                classes = [(xxhash.xxh3_128(s.tobytes()).intdigest() & (2**64 - 1)) - 2**63 if len(s) else None for s in sets]
                dense = np.array([parity_sketch(s) for s in sets], np.int64).reshape(-1, len(PARITY))
                columns = [pa.array(classes, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *(pa.array(dense[:, i]) for i in range(len(PARITY)))]
                yield pa.RecordBatch.from_arrays(columns, ["class", "shingles", *PARITY])

    return run


def _shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(class, shingles, dense sketch) of the documents of ``ids``, a column ``doc_id``; a fixed-size filter keeps the others' texts out."""
    slot = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 64 - FILTER_BITS).cast("int")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[[r["slot"] for r in ids.select(slot.alias("slot")).distinct().collect()]] = True  # at most 2^FILTER_BITS numbers
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
    return docs.select(slot.alias("slot"), "text").mapInArrow(_needed(shared), "class bigint, shingles array<bigint>, " + ", ".join(f"{p} bigint" for p in PARITY)).where("class is not null")


def _may_link(one: str, two: str) -> Column:
    """Whether sizes and dense sketches, in columns of these prefixes, allow a link."""
    x, y = F.col(f"{one}size"), F.col(f"{two}size")
    apart = sum((F.bit_count(F.col(one + p).bitwiseXOR(F.col(two + p))) for p in PARITY), F.lit(0))
    return (5 * F.least(x, y) >= 4 * F.greatest(x, y)) & (9 * apart <= x + y)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c == "key" else prefix + c) for c in df.columns))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: 100 * intersection >= 80 * union."""
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u"))
    return found.where("100 * i >= 80 * u").select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b), the smaller class first, each pair once, of columns x_class and y_class."""
    return pairs.select(F.least("x_class", "y_class").alias("a"), F.greatest("x_class", "y_class").alias("b")).distinct()


def _star_pairs(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """A pair for each class: with the head that it shares most keys with.

    The head of a key is its class whose keys are, together, the most shared: of a text and its changed copies, the text.
    """
    sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key-sizes")
    weight = materialize(members.join(sizes, "key").groupBy("class").agg(F.sum("n").alias("weight")), "weights")
    heads = materialize(members.join(weight, "class").groupBy("key").agg(F.max_by("class", F.struct("weight", "class")).alias("head")), "heads")
    shared = members.join(heads, "key").where("class <> head").groupBy("class", "head").agg(F.count(F.lit(1)).alias("n"))
    best = materialize(shared.groupBy("class").agg(F.max_by("head", F.struct("n", "head")).alias("head")).select("class", "head"), "stars")
    own, other = _prefixed(sketches, "x_"), _prefixed(sketches, "y_")
    return _ordered(best.join(own, F.col("class") == F.col("x_class")).join(other, (F.col("head") == F.col("y_class")) & _may_link("x_", "y_")))


def _open_pairs(members: DataFrame, sketches: DataFrame, comps: DataFrame) -> DataFrame:
    """All pairs of classes that share a key, lie in different components and may link.

    Of each key's rows, those outside its commonest component meet the others; keys within one component drop out.
    """
    now = members.join(comps.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("comp", "class").alias("comp"))
    now = materialize(now, "grouped")
    counts = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("n", "comp")).alias("major"))
    several = materialize(counts.where("comps > 1").select("key", "major"), "open")
    rows = materialize(now.join(several, "key").join(sketches, "class").select("key", "class", "comp", "major", "size", *PARITY), "residual")
    minor, every = _prefixed(rows.where("comp <> major").drop("major"), "x_"), _prefixed(rows.drop("major"), "y_")
    return _ordered(minor.join(every.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("x_comp") != F.col("y_comp")) & _may_link("x_", "y_")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, n_shingles, component_id (smallest key that links reach, its own included).

    Shingles are runs of 5 words; words are cut at ASCII white space and A-Z lower-cased; a text of 1 to 4 words is one
    shingle. Two texts link if 100 * |A and B| >= 80 * |A or B|. Null and empty texts have no shingles and link with
    nothing. Equal shingle sets are one class from the start, so exact copies are never paired. Repeated rows keep
    their rows. Null keys are passed over when the smallest is taken, unless a component has no other. Other columns
    of ``docs`` aren't read.

    Links: each class is first compared with one class it shares many keys with; then the keys whose classes lie in
    different components give the pairs that remain, all of them, so no link between components is lost.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    sketches = materialize(rows.mapInArrow(_sketches, f"doc_id {id_type}, n_shingles bigint, class bigint, check bigint, keys array<bigint>"), "sketches")
    named = sketches.where("class is not null").groupBy("class")
    named = named.agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"), F.count(F.lit(1)).alias("rows"), F.min("check").alias("c0"), F.max("check").alias("c1"))
    named = materialize(named, "classes")
    if named.where("c0 <> c1").limit(1).count():
        raise RuntimeError("two different shingle sets have the same 64-bit hash")
    flat = sketches.select("class", F.explode("keys").alias("key")).select("key", "class").repartition("key").sortWithinPartitions("key", "class")
    members = materialize(flat.mapInArrow(_shared_keys, "key bigint, class bigint"), "members")
    ids = materialize(members.select("class").distinct().join(named.select("class", "doc_id"), "class").select("doc_id"), "needed")
    firsts = [F.first(c).alias(c) for c in ("shingles", *PARITY)]
    sets = materialize(_shingle_sets(rows, ids).groupBy("class").agg(*firsts).withColumn("size", F.size("shingles")), "sets")
    dense = sets.select("class", "size", *PARITY)
    tried = materialize(_star_pairs(members, dense), "pairs")
    stars = materialize(_linked(tried, sets), "links")
    fresh = _open_pairs(members, dense, connected_components(stars))
    fresh = materialize(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
    comps = connected_components(stars.union(materialize(_linked(fresh, sets), "links")))
    placed = named.join(comps.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    placed = materialize(placed.select("class", "comp", "doc_id", "rows"), "placed")
    smallest = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.sum("rows").alias("n")).where("n > 1").select("comp", "component_id")
    groups_of = materialize(placed.select("class", "comp").join(materialize(smallest, "smallest"), "comp").select("class", "component_id"), "groups_of")
    return sketches.select("doc_id", "n_shingles", "class").join(groups_of, "class", "left").select(
        F.col("doc_id").alias(key), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
