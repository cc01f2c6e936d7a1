"""Quality rules: counted text rules, then a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed uni- and bigrams are counted: one over all documents labelled as good, one over the whole
raw corpus. A document's score is the sum of its n-grams' log ratios divided by their number, and a document
is kept if it passes the counted rules and its score reaches a fixed threshold. Each document's verdict
follows from its own text and the two tables alone; nothing is drawn at random.

Texts are tokenised once: the rules' counts and each document's n-gram buckets are written to the shared folder, and both
multinomials and all scores are computed from that table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, packed

#: Parts of a text that n-grams are made of: runs of letters, digits and _, and runs of other signs.
PARTS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Up to so many ids of trusted documents (8 MB) are broadcast; beyond, the join shuffles ids and n-grams.
BROADCAST_IDS = 1_000_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "base_failed", "llr", "kept")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _all_but(hashes: Column, n: int) -> Column:
    """The array without its last ``n`` elements."""
    return F.slice(hashes, 1, F.greatest(F.size(hashes) - n, F.lit(0)))


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more, from the words' 64-bit hashes."""

    def counted(windows: Column) -> Column:
        def slow(ordered: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                same = lambda j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
                return F.when(i > 0, same(i - 1)).otherwise(F.lit(False)) | same(i + 1)

            at = F.transform(F.filter(ordered, again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(at)))

        tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(tagged, slow))

    windows = F.transform(_all_but(hashes, 2), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return _let(windows, counted)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _buckets(hashes: Column, buckets: int) -> Column:
    """The bucket numbers of the uni- and bigrams of a text's parts, with repeats, from the parts' hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(_all_but(hashes, 1), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def count_texts(docs: DataFrame, buckets: int = 4096, key: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Per row of ``docs``, written to the shared folder: row (the columns ``keep``, all by default), id, the counts, base_failed, grams."""
    rows = packed(docs, F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), keep=keep)
    hashes = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    parts = F.regexp_extract_all(F.lower("text"), F.lit(f"({PARTS})"), F.lit(1))
    # split and array_remove work on whole arrays in generated code; a call for each word is several times slower
    words = rows.withColumns({"words": F.array_remove(F.split("text", SPACE), ""), "parts": hashes(parts)})
    words = words.withColumn("hashes", hashes(F.col("words")))
    counted = words.select(
        "row", "id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("hashes")).cast("long").alias("n_repeat_words"),
        _buckets(F.col("parts"), buckets).alias("grams"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return materialize(counted.withColumn("base_failed", failed), "counted")


def _totals(counted: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for r in counted.select(F.explode("grams").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(counted: DataFrame, trusted: DataFrame, buckets: int = 4096, smoothing: float = 1.0) -> list[float]:
    """Log of trusted over raw share of each bucket, with additive smoothing. counted: as count_texts gives it.

    The raw counts are over every document, the trusted ones over every row whose id is in the one column of ``trusted``.
    Only ``buckets`` numbers come back each time. Without trusted n-grams all are 0.
    """
    ids = materialize(trusted.toDF("id").where("id is not null").distinct(), "trusted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    t, r = _totals(counted.select("id", "grams").join(ids, "id", "left_semi"), buckets), _totals(counted, buckets)
    if not sum(t):
        return [0.0] * buckets
    whole_t, whole_r = math.log(sum(t) + smoothing * buckets), math.log(sum(r) + smoothing * buckets)
    return [math.log(a + smoothing) - whole_t - math.log(b + smoothing) + whole_r for a, b in zip(t, r, strict=True)]


def score_counted(counted: DataFrame, ratios: list[float], threshold: float) -> DataFrame:
    """The columns of ``row`` with the counts, base_failed, ``llr`` and ``kept``."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda s, x: s + F.get(table, x))
    llr = F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(total / F.size("grams"))
    return counted.withColumn("llr", llr).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select("row.*", *ADDED)


def apply_rules(
    docs: DataFrame, trusted: DataFrame, threshold: float, buckets: int = 4096, smoothing: float = 1.0, key: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the counted rules, ``llr`` (mean log ratio of the n-grams, 0
    without any) and ``kept``: true if a document doesn't fail the counted rules and its ``llr`` is at least ``threshold``.

    ``trusted`` has one column, the ids of documents taken as good; null ids there are left out, an id that several
    rows have names all of them. Columns of ``docs`` named as those added are replaced. Null and empty texts have no words,
    fail the counted rules and aren't kept. Repeated rows keep their rows. An empty table gives an empty one. Texts are
    read whole, however long.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    counted = count_texts(docs, buckets, key, text, kept)
    return score_counted(counted, log_ratios(counted, trusted, buckets, smoothing), threshold)
