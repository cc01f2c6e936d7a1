"""Benchmark decontamination with a distributed positional inverted index.

Every training document's postings (term, positions) for the terms of the benchmark are stored once as a
table. A query window is looked up by its rarest term; each posting of that term gives a start, and the
other terms' position lists, adjusted by their offsets in the window, are intersected with it. A phrase
match has every term in its place; a proximity match has every term within ``slop`` places of it.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import TokenHashes, alnum_tokens, materialize, slices

#: Bits of the filter on benchmark terms that goes to the tasks: 512 KiB, however large the benchmark is.
FILTER_BITS = 22
#: Up to so many windows (about 100 bytes each) their lookup terms are broadcast; beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000
#: Up to so many distinct terms (16 bytes each) their counts are broadcast, so that windows with a common word don't meet in one task.
BROADCAST_TERMS = 1_000_000


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, text -> item_id, tokens."""
    hashes = TokenHashes()
    for batch in batches:
        tokens = [hashes.array(alnum_tokens(t)).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(tokens, pa.list_(pa.int64()))], ["item_id", "tokens"])


class _Known(TokenHashes):
    """Hashes of terms that the filter lets through, 0 for the others."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def of(self, token: bytes) -> int:
        h = super().of(token)
        return h if self.bits[h >> (64 - FILTER_BITS)] else 0


def _postings(wanted):
    """doc_id, text -> doc_id, n_words, and the document's terms with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(np.unpackbits(np.frombuffer(wanted.value, np.uint8)))
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [known.array(alnum_tokens(t)) for t in batch.column("text").to_pylist()]
                n_words = np.array([len(r) for r in rows], np.int64)
                terms = np.concatenate(rows)
                doc = np.repeat(np.arange(len(rows)), n_words)
                place = np.arange(len(terms)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
                hit = np.flatnonzero(terms)
                hit = hit[np.lexsort((terms[hit], doc[hit]))]  # stable: positions stay in order
                terms, doc, place = terms[hit], doc[hit], place[hit].astype(np.int32)
                first = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])]) if len(hit) else np.zeros(0, int)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(hit)].astype(np.int32)), pa.array(place))
                cuts = np.searchsorted(doc[first], np.arange(len(rows) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(n_words),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(terms[first].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(cuts), lists),
                    ],
                    ["doc_id", "n_words", "terms", "positions"],
                )

    return run


def benchmark_windows(benchmark: DataFrame, width: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row (item_id, terms) for each run of ``width`` words of an item; a shorter item, unless empty, is one window."""
    id_type = benchmark.schema[item].dataType.simpleString()
    rows = benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    tokens = rows.mapInArrow(_tokens, f"item_id {id_type}, tokens array<bigint>").where(F.size("tokens") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("tokens") - (width - 1), F.lit(1)))
    return tokens.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("tokens", i, width))).alias("terms"))


def build_index(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Stores the documents' postings and the benchmark's windows; gives (index, windows).

    index: row (unique), doc_id, n_words, terms, positions. A fixed-size bit filter keeps out most terms that no
    benchmark item has; what it lets through besides does no harm.
    """
    windows = materialize(benchmark_windows(benchmark, width, item, item_text).withColumn("win", F.monotonically_increasing_id()), "windows")
    slots = windows.select(F.explode("terms").alias("t")).select(F.shiftrightunsigned("t", 64 - FILTER_BITS).cast("int").alias("slot")).distinct()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[[r["slot"] for r in slots.collect()]] = True  # at most 2^FILTER_BITS numbers
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    index = rows.mapInArrow(_postings(wanted), f"doc_id {id_type}, n_words bigint, terms array<bigint>, positions array<array<int>>")
    return materialize(index.withColumn("row", F.monotonically_increasing_id()), "postings"), windows


def find_matches(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """All matches: row, item_id, start, width, exact (false: a proximity match).

    A window lies near a start if each of its terms stands within ``slop`` places of where it would stand there. Starts
    that follow one another are one proximity match, unless one of them is exact. Which term is the rarest (that with
    the fewest postings in the whole index, then the smallest offset) only decides where matches are looked for.
    """
    counts = index.select(F.explode(F.arrays_zip("terms", "positions")).alias("p")).groupBy(F.col("p.terms").alias("t")).agg(F.sum(F.size("p.positions")).alias("n"))
    counts = materialize(counts, "term-counts")
    if counts.count() <= BROADCAST_TERMS:
        counts = F.broadcast(counts)
    terms = windows.select("win", F.posexplode("terms").alias("at", "t"))
    rarest = terms.join(counts, "t", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "t")).alias("r")).where("r.n > 0")
    plans = materialize(windows.join(rarest, "win").select("win", "item_id", "terms", F.col("r.t").alias("t"), F.col("r.at").alias("at")), "lookups")
    lookup = plans.select("win", "t")
    if plans.count() <= BROADCAST_WINDOWS:
        lookup = F.broadcast(lookup)
    found = materialize(index.select("row", F.explode("terms").alias("t")).join(lookup, "t").select("row", "win"), "candidates")
    detail = plans.select("win", "item_id", F.col("terms").alias("want"), "t", "at")
    # of a document's lists those of the window's terms go on; where it lacks one of them, none
    places = F.transform("want", lambda t: F.element_at("positions", F.array_position("terms", t).cast("int")))
    placed = (
        found.join(detail, "win")
        .join(index.select("row", "terms", "positions"), "row")
        .where(F.forall("want", lambda t: F.array_contains("terms", t)))
        .select("row", "win", "item_id", "want", "at", places.alias("places"))
        .select("row", "win", "item_id", "want", "places", F.explode(F.transform(F.element_at("places", F.col("at") + 1), lambda p: p - F.col("at"))).alias("start"))
        .where(F.col("start") >= -2 * slop)
    )

    def term_near(reach: int):
        def at(i):
            places = F.element_at("places", i + 1)
            here = F.array_contains(places, (F.col("start") + i).cast("int")) if reach == 0 else F.exists(places, lambda p: F.abs(p - F.col("start") - i) <= reach)
            return F.coalesce(here, F.lit(False))

        return F.forall(F.sequence(F.lit(0), F.size("want") - 1), at)  # ends at the first term that isn't there

    placed = placed.withColumn("width", F.size("want"))
    if slop == 0:
        return placed.where(term_near(0)).select("row", "item_id", "start", "width", F.lit(True).alias("exact"))
    # the rarest term may itself be displaced: around a start where all terms are within twice the slop, try all starts
    close = materialize(placed.where(term_near(2 * slop)).withColumn("exact", term_near(0)), "close")
    tried = close.withColumn("exact_start", F.when(F.col("exact"), F.col("start")))
    tried = tried.withColumn("start", F.explode(F.transform(F.sequence(F.lit(-slop), F.lit(slop)), lambda d: F.col("start") + d))).where(term_near(slop))
    starts = tried.groupBy("row", "win", "item_id", "width").agg(F.array_sort(F.collect_set("start")).alias("near"), F.collect_set("exact_start").alias("exact"))
    heads = F.filter("near", lambda s: ~F.array_contains("near", s - 1))
    own = lambda f: F.exists("exact", lambda e: (e >= f) & ~F.exists("heads", lambda g: (g > f) & (g <= e)))
    runs = starts.withColumn("heads", heads).select("row", "item_id", F.explode(F.filter("heads", lambda f: ~own(f))).alias("start"), "width")
    exact_rows = close.where("exact").select("row", "item_id", "start", "width", "exact")
    return exact_rows.unionByName(runs.withColumn("exact", F.lit(False)).select(*exact_rows.columns))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_hit counts the document's words inside an exact occurrence of a window; items_sha256 is of the items with such
    windows, sorted as strings and comma-joined; n_near counts the proximity matches that aren't exact (0 unless
    ``slop`` > 0). Texts that are null or have no words have none. Repeated rows each keep their row. An empty
    benchmark hits nothing. Other columns of ``docs`` aren't read.
    """
    index, windows = build_index(docs, benchmark, key, text, item, item_text, width)
    hits = find_matches(index, windows, slop)
    near = F.count_if(~F.col("exact"))
    by_row = (
        hits.groupBy("row")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("exact"), F.struct("start", "width")))).alias("spans"),
            F.array_sort(F.collect_set(F.when(F.col("exact"), F.coalesce(F.col("item_id").cast("string"), F.lit("null"))))).alias("items"),
            near.alias("n_near"),
        )
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    # spans are sorted by start: count what each adds beyond the end so far
    covered = F.aggregate(
        "spans", none,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["start"] + x["width"] - F.greatest(s["end"], x["start"]))).alias("n"),
            F.greatest(s["end"], x["start"] + x["width"]).alias("end"),
        ),
    )["n"]
    hit_rows = by_row.select("row", covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("_items"), "n_near")
    return index.select("row", "doc_id", "n_words").join(hit_rows, "row", "left").select(
        F.col("doc_id").alias(key), "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("_items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
    )
