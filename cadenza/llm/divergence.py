"""Source divergence audit: how far the term distributions of the sources of a language lie apart, by a frequent-pattern tree.

Each kept term of a language is a row of source-ordered nonzero counts. For two sources the value is a sum over all
kept terms of f(p, q), p and q depending on one count each. Where both counts are zero f is the same for all terms, so a
pair's value is that constant times the number of terms, plus corrections for terms of one source, plus corrections for
terms of both. Rows are inserted into a tree: equal rows once with their multiplicity, equal prefixes as one node. A
correction for two sources is then computed once for each node and ancestor, times the node's multiplicity, however
many terms share the path. All numbers are integers; sums are decimals of 38 digits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import ASCII_LOWER, materialize

#: Lower-cases A-Z and turns every other ASCII byte but a letter into a space; bytes beyond ASCII stay.
LETTERS = bytes(32 if ASCII_LOWER[b] < 97 or 122 < ASCII_LOWER[b] < 128 else ASCII_LOWER[b] for b in range(256))
#: A probability of 1 as an integer.
UNIT = 1_000_000_000
#: Entries that a task's counters hold before they are given on.
MOST_HELD = 800_000
#: Parts into which the rows of one source are split before the last ranking.
SALTS = 32


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, term, count, docs, summed up for what the task has read; a null term for each group."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    holders: dict[tuple, Counter] = defaultdict(Counter)
    names = ["lang", "source", "term", "count", "docs"]

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            held = holders[lang, source]
            columns = [None, *own], [0, *own.values()], [0, *map(held.__getitem__, own)]
            for start in range(0, len(own) + 1, 50_000):
                terms, times, docs = (c[start : start + 50_000] for c in columns)
                group = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*group, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()), pa.array(docs, pa.int64())], names)
        counts.clear(), holders.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms = text.translate(LETTERS).split() if text else []
            counts[lang, source].update(terms)
            holders[lang, source].update(set(terms))
        if sum(map(len, counts.values())) > MOST_HELD:
            yield from given()
    yield from given()


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count and docs (rows with the term); with a null term, one row or more for each group that occurs."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(known(lang).alias("lang"), known(source).alias("source"), F.col(text).cast("binary").alias("text"))
    partial = rows.mapInArrow(_count_terms, "lang string, source string, term string, count bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)); no partial result leaves its type."""
    wide = lambda c: c.cast("decimal(20,0)")
    scaled = (F.lit(UNIT).cast("decimal(10,0)") * wide(count + 1)).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", scaled, F.nullif(wide(total + terms), F.lit(0).cast("decimal(20,0)")).cast("decimal(38,0)"))


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): its parts are below 2^63, both being at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def term_rows(cells: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total and path, the source-ordered (source, count) of the terms in ``least_docs`` rows or more of a language."""
    kept = cells.where("term is not null").groupBy("lang", "term")
    kept = kept.agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("path"))
    return kept.where(F.col("docs") >= least_docs).select("lang", "term", "total", "path")


def pattern_tree(rows: DataFrame) -> DataFrame:
    """lang, prefix and n: the nodes of the tree, each as its path from the root, and the number of rows through it."""
    paths = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("n"))
    prefixes = paths.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", 1, i))).alias("prefix"))
    return prefixes.groupBy("lang", "prefix").agg(F.sum("n").alias("n"))


def _pair_values(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """lang, source, item, value for all ordered pairs of a language's sources. groups: lang, source, total, terms, p0."""
    one = groups.select("lang", "source", F.col("terms").alias("v"), F.col("total").alias("n_a"), F.col("p0").alias("a0"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("n_b"), F.col("p0").alias("b0"))
    pairs = one.join(two, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, _wide(F.col("v")) * _wide(_apart(F.col("a0"), F.col("b0")))).otherwise(F.lit(0)).cast("decimal(38,0)").alias("value"))

    last = F.element_at("prefix", -1)
    own = nodes.groupBy("lang", last["source"].alias("source"), last["count"].alias("c")).agg(F.sum("n").alias("n"))
    single = own.join(one, ["lang", "source"]).join(two, "lang").where("source <> item").withColumn("a", _share(F.col("c"), F.col("n_a"), F.col("v")))
    both_ways = lambda here, there: F.explode(F.array(F.struct("source", "item", here.alias("x")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), there.alias("x"))))
    more = _wide(F.col("n")) * _wide(_apart(F.col("a"), F.col("b0")) - _apart(F.col("a0"), F.col("b0")))
    back = _wide(F.col("n")) * _wide(_apart(F.col("b0"), F.col("a")) - _apart(F.col("b0"), F.col("a0")))
    singles = single.select("lang", both_ways(more, back).alias("s")).select("lang", "s.source", "s.item", F.col("s.x").cast("decimal(38,0)").alias("value"))

    # an ancestor's source comes before its node's, so each unordered pair of sources has one form
    above = F.transform(F.slice("prefix", 1, F.size("prefix") - 1), lambda x: F.struct(x["source"].alias("source"), x["count"].alias("ca")))
    met = nodes.select("lang", "n", last.alias("node"), F.explode(above).alias("up"))
    met = met.groupBy("lang", F.col("up.source").alias("source"), F.col("node.source").alias("item"), F.col("up.ca").alias("ca"), F.col("node.count").alias("cb")).agg(F.sum("n").alias("n"))
    full = met.join(one, ["lang", "source"]).join(two, ["lang", "item"])
    full = full.withColumn("a", _share(F.col("ca"), F.col("n_a"), F.col("v"))).withColumn("b", _share(F.col("cb"), F.col("n_b"), F.col("v")))

    def corrected(a: str, b: str, a0: str, b0: str) -> Column:
        a, b, a0, b0 = map(F.col, (a, b, a0, b0))
        return _wide(F.col("n")) * (_wide(_apart(a, b)) - _wide(_apart(a, b0)) - _wide(_apart(a0, b)) + _wide(_apart(a0, b0)))

    doubles = full.select("lang", both_ways(corrected("a", "b", "a0", "b0"), corrected("b", "a", "b0", "a0")).alias("s")).select("lang", "s.source", "s.item", F.col("s.x").cast("decimal(38,0)").alias("value"))
    summed = base.unionByName(singles).unionByName(doubles).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.select("lang", "source", "item", F.col("value").cast("long").alias("value"))


def audit(docs: DataFrame, least_docs: int = 3, term_ranks: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language with the divergence of this source from it, all ranks. Part
    ``term``: the terms that this source has more often than the language as a whole, the first ``term_ranks`` of them by
    value. Terms are runs of letters and characters beyond ASCII, A-Z lower-cased. Ranks go by value descending, then
    by item in UTF-8 order.

    Null text, lang and source count as empty strings. Repeated rows count as often as they stand there. A group
    without terms has rows of part ``pair``; a language of one source has none. An empty table gives an empty one.
    Other columns of ``docs`` aren't read.
    """
    cells = materialize(count_terms(docs, text, lang, source), "cells")
    rows = materialize(term_rows(cells, least_docs), "term-rows")
    nodes = materialize(pattern_tree(rows), "tree")
    flat = rows.select("lang", "term", "total", F.explode("path").alias("x")).select("lang", "term", "total", "x.source", "x.count")
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    totals = flat.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = cells.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("terms"), zero("lang_total"))
    groups = materialize(groups.withColumn("p0", _share(F.lit(0), F.col("total"), F.col("terms"))), "groups")

    place = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(F.desc("value"), F.asc("item")))
    pairs = _pair_values(groups, nodes).withColumn("rank", place()).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    shares = flat.join(groups, ["lang", "source"], "inner").select(
        flat["lang"], flat["source"], F.col("term").alias("item"), _share(flat["count"], groups["total"], F.col("terms")).alias("p"), _share(flat["total"], F.col("lang_total"), F.col("terms")).alias("q")
    )
    terms = shares.where("p > q").select("lang", "source", "item", _apart(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("rank", place("salt")).where(F.col("rank") <= term_ranks)
    terms = terms.withColumn("rank", place()).where(F.col("rank") <= term_ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
