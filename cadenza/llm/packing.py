"""Packing tokenised documents into sequences of a fixed length by linear grouping.

Documents are tokenised where they lie; what is longer than a sequence is cut into pieces. How pieces are packed depends on
their lengths alone, of which there are no more than a sequence has tokens: the driver gets the count of each length,
makes a plan for counts, and each piece looks its place up by its length and its number among the pieces of that length.

The plan: lengths above ``small`` form groups of equal cardinality and are rounded up to the largest of their group (linear
grouping, de la Vega and Lueker 1981). For the few rounded sizes the configurations of a sequence are found by column
generation (Gilmore and Gomory 1961) and each is used as often as the solution's whole part says. The real documents
take the places of the rounded ones; the rest, and all small ones, are packed best-fit by decreasing length into what space
the sequences have, then into new ones. Equal sequences are handled as one range of numbers, so the plan's size depends
on the numbers of lengths and configurations, not on the documents.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, named

SEQUENCE = 2048
#: Groups of rounded sizes; rounds of column generation. Both bound the driver's work at any input size.
GROUPS, ROUNDS = 256, 3000
#: Shares of a sequence above which a length is rounded; the plan of the fewest sequences is taken, of equal ones the first.
LARGE_SHARES = (0.34, 0.45, 0.5)
#: Texts of more characters go to the tokeniser that never recurses.
LONG_TEXT = 200_000
#: Documents tokenised at a time.
AT_ONCE = 64


# Tokens


class Encoder:
    """Texts to ids by a byte-level BPE vocabulary file of ``tokenizers``; strings of special tokens in a text are ordinary text.

    With ``ranks``, the same vocabulary as a file of ranks, texts that aren't very long go through ``tiktoken``, which gives
    the same ids several times as fast.
    """

    def __init__(self, vocabulary: bytes, ranks: bytes | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(vocabulary.decode())
        self.whole.encode_special_tokens = True
        self.fast = None
        if ranks and pattern:
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def _pieces(files, end: int, length: int, keep_ids: bool):
    """key, text -> pieces with their numbers among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder(*files.value), TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(start, AT_ONCE)
                of, rows, ids = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    tokens = np.array([*encoder.ids(text or ""), end], "<u4")
                    first = (len(tokens) - 1) % length + 1  # the first piece takes what doesn't fill a sequence
                    for piece, at in enumerate([0, *range(first, len(tokens), length)]):
                        part = tokens[at : first + piece * length]
                        of.append(i)
                        rows.append((piece, at, len(part), zlib.crc32(part.tobytes()), seen[len(part)]))
                        seen[len(part)] += 1
                        ids.append(part if keep_ids else None)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                extra = [pa.array(ids, pa.list_(pa.int64()))] if keep_ids else []
                names = ["key", "piece", "start", "length", "ids_crc32", "nth", "task", *(["ids"] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), *columns, pa.array([task] * len(of), pa.int64()), *extra], names)

    return run


# The plan


def configurations(sizes: list[int], counts: list[int], length: int, rounds: int = ROUNDS) -> list[tuple[float, dict[int, int]]]:
    """How often to use which configuration {index of size: times} to cover the counts of the sizes: the linear relaxation."""
    k = len(sizes)
    if not k:
        return []
    size, need = np.array(sizes), np.array(counts, float)
    columns = np.diag((length // size).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    cost, used = np.ones(k), inverse @ need
    room = np.arange(length + 1)[:, None] - size[None, :]
    fits, room = room >= 0, np.maximum(room, 0)
    for _ in range(rounds):
        worth = cost @ inverse
        if worth.min() < -1e-9:  # more of a size than needed
            column, price = np.zeros(k), 0.0
            column[int(worth.argmin())] = -1
        else:
            # the configuration of most worth: best[c] with one more item at each step
            best, took = np.zeros(length + 1), []
            for _ in range(length // int(size.min())):
                value = np.where(fits, worth[None, :] + best[room], -1)
                pick = value.argmax(1)
                better = value[np.arange(length + 1), pick] > best + 1e-12
                took.append(np.where(better, pick, -1))
                best = np.where(better, value[np.arange(length + 1), pick], best)
            if best[length] <= 1 + 1e-7:
                break
            column, price, c = np.zeros(k), 1.0, length
            for step in reversed(took):
                if step[c] >= 0:
                    column[step[c]] += 1
                    c -= sizes[step[c]]
        way = inverse @ column
        ratio = np.where(way > 1e-9, used / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        used = np.maximum(used - ratio[out] * way, 0)
        used[out] = ratio[out]
        columns[:, out], cost[out] = column, price
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
    return [(float(u), {int(g): int(columns[g, j]) for g in np.flatnonzero(columns[:, j])}) for j, u in enumerate(used) if u > 1e-9 and cost[j]]


def groups_of(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count), lengths falling, as runs of equal cardinality."""
    each, out, left = -(-sum(n for _, n in lengths) // groups), [], 0
    for size, n in lengths:
        while n:
            if not left:
                out.append([])
                left = each
            part = min(n, left)
            out[-1].append((size, part))
            n, left = n - part, left - part
    return out


def plan(counts: dict[int, int], length: int = SEQUENCE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """The shortest of the plans for LARGE_SHARES."""
    plans = [plan_above(counts, length, int(share * length), groups) for share in LARGE_SHARES]
    return min(plans, key=lambda rows: max((sequence - (-n // per) for _, _, n, sequence, per, _ in rows), default=0))


def plan_above(counts: dict[int, int], length: int, small: int, groups: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, n, sequence, per, offset): the ``first``-th and later pieces of a length, ``n`` of them, go ``per`` to a
    sequence into the sequences from ``sequence`` on, the first of each at ``offset``. Lengths above ``small`` are grouped."""
    left = {s: n for s, n in counts.items() if n}
    rows, taken, number = [], Counter(), 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (sequence, how many) of equal sequences

    def place(size: int, n: int, sequence: int, per: int, offset: int) -> None:
        rows.append((size, taken[size], n, sequence, per, offset))
        taken[size] += n
        left[size] -= n

    if left.get(length):
        n = left[length]
        place(length, n, number, 1, 0)
        number += n

    large = sorted(((s, n) for s, n in left.items() if small < s < length), reverse=True)
    grouped = groups_of(large, groups) if large else []
    chosen = configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], length)
    waiting = [list(g) for g in grouped]
    for often, config in sorted(chosen, key=lambda c: sorted(c[1].items())):
        many = int(often + 1e-6)
        if not many:
            continue
        # the real pieces of each place: runs of equal lengths over the sequences of this configuration
        places = []
        for g in sorted(config):
            for _ in range(config[g]):
                runs, want = [], many
                while want and waiting[g]:
                    size, n = waiting[g][0]
                    part = min(n, want)
                    runs.append((size, part))
                    want -= part
                    waiting[g][0:1] = [(size, n - part)] if n > part else []
                places.append(runs + [(0, want)] * (want > 0))
        cuts = sorted({0, many, *(sum(n for _, n in runs[: i + 1]) for runs in places for i in range(len(runs)))})
        at = [0] * len(places)
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for i, runs in enumerate(places):
                while sum(n for _, n in runs[: at[i] + 1]) <= a:
                    at[i] += 1
                size = runs[at[i]][0]
                if size:
                    place(size, b - a, number + a, 1, offset)
                    offset += size
            if offset:
                free[length - offset].append((number + a, b - a))
        number += many
    for size in sorted(left, reverse=True):
        room = size
        while left[size]:
            while room <= length and not free[room]:
                room += 1
            if room > length:  # none has room: new sequences
                per = length // size
                sequence, many = number, -(-left[size] // per)
                number += many
                room = length
            else:
                sequence, many = free[room].pop()
                per = room // size
            whole, rest = divmod(min(left[size], many * per), per)
            if whole:
                place(size, whole * per, sequence, per, length - room)
                free[room - per * size].append((sequence, whole))
            if rest:
                place(size, rest, sequence + whole, rest, length - room)
                free[room - rest * size].append((sequence + whole, 1))
            if whole + (rest > 0) < many:
                free[room].append((sequence + whole + (rest > 0), many - whole - (rest > 0)))
    return rows


# The operator


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, length: int = SEQUENCE, end: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece: ``key``, piece, start, length, ids_crc32, sequence_id and offset, and with ``keep_ids`` its ids.

    A document's tokens are its ids and then the id ``end``. Longer ones than ``length`` are cut into pieces of that
    length, the first of which may be shorter. Sequences have no gaps between pieces. ``vocabulary`` is the path of a
    vocabulary of ``tokenizers`` on the driver; ``ranks`` and ``pattern`` state the same one for ``tiktoken`` (see Encoder).

    A null or empty text is the id ``end`` alone. Rows that repeat, or share a key, are packed each for itself; null
    keys too. An empty table gives an empty one. Other columns of ``docs`` aren't read. Which sequence holds which
    of the pieces of a length follows from the partitions read; the number of sequences doesn't.
    """
    spark = docs.sparkSession

    def content(path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    files = spark.sparkContext.broadcast((content(vocabulary), content(ranks) if ranks else None, pattern))
    rows = docs.select(named(key).alias("key"), named(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece bigint, start bigint, length bigint, ids_crc32 bigint, nth bigint, task bigint" + (", ids array<bigint>" if keep_ids else "")
    pieces = materialize(rows.mapInArrow(_pieces(files, end, length, keep_ids), schema), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "length-counts")
    found = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``length`` rows
    table = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*(plan(found, length) or [(0,) * 6]), strict=True)], ["length", "first", "n", "sequence", "per", "offset0"])
    placed = F.broadcast(spark.createDataFrame(table))  # as many rows as configurations and lengths give, whatever the documents
    numbered = pieces.join(counts.drop("n"), ["length", "task"]).withColumn("number", F.col("before") + F.col("nth"))
    put = numbered.join(placed, (numbered["length"] == placed["length"]) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n")))
    at = F.col("number") - F.col("first")
    sequence = F.col("sequence") + F.floor(at / F.col("per"))
    offset = F.col("offset0") + (at % F.col("per")) * numbered["length"]
    extra = ["ids"] if keep_ids else []
    return put.select(F.col("key").alias(key), F.col("piece").cast("int").alias("piece"), "start", numbered["length"], "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), *extra)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, of the result of ``pack`` with ``keep_ids``. A group is one sequence, so it is bounded."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def vocabulary_files() -> dict[str, str]:
    """The arguments of ``pack`` for the byte-level vocabulary of the installed package of public tokenizers."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
