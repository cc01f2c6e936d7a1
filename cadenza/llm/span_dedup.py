"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and those at their commas, semicolons and colons, so that a passage pasted into the middle
of a sentence shares most of its pieces with its source. Whether a sentence ends somewhere follows from a few words around
the place alone. From every piece starts a span: the shortest run of at least ``sentences`` pieces that has at least ``words``
words. Spans are hashed, equal hashes are joined over the whole corpus, and each piece that lies in a span which an
earlier document (by doc_id, then text hash) has too is removed. A passage that documents share stays where it comes first.

Repeats inside one document are left alone unless ``within`` asks for them: a refrain or a list is that text's own, and quality
rules count it; here a passage is one that documents share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import ASCII_LOWER, materialize, packed

SENTENCES, WORDS = 2, 24
#: Pieces of more words are cut further, after words chosen by their hashes, one in STRIDE.
LONGEST, STRIDE = 16, 8
_CUT = re.compile(r"[.!?,;:][\"'”’)\]]*\s+|[。！？，；：]\s*|\n\s*")
_WORD = re.compile(r"\S+\s*")
#: Letters of scripts that are written without spaces between words: each is a word. Thai to Lao, Tibetan,
#: Burmese, Khmer, kana, and the blocks of Han characters.
_SPACELESS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_SPACELESS = re.compile(f"[{_SPACELESS}]")
_MIXED_WORD = re.compile(rf"(?:[{_SPACELESS}]|[^\s{_SPACELESS}]+)\s*")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD))
ADDED = {"n_sentences": T.LongType(), "n_removed": T.LongType(), "removed": T.StringType(), "clean_text": T.StringType()}


def _lower(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "surrogatepass").translate(ASCII_LOWER)


def _cut_long(text: str, start: int, end: int, word: re.Pattern[str]) -> Iterator[tuple[int, list[str]]]:
    words: list[str] = []
    for m in word.finditer(text, start, end):
        words.append(m[0].rstrip())
        if xxhash.xxh32_intdigest(_lower(words[-1:])) % STRIDE == 0:
            yield m.end(), words
            words = []
    if words:
        yield end, words


def cut_text(text: str | None) -> tuple[list[int], list[list[str]]]:
    """Where the pieces of a text end, the last one at its end, and their words.

    A mark ends a piece if two or more words stand between it and the mark before: ``Ha!! Ha!! Ha!!`` is no row of sentences.
    """
    ends: list[int] = []
    each: list[list[str]] = []
    if not text:
        return ends, each
    start = last = 0
    words: list[str] = []
    mixed = not text.isascii() and _HAS_SPACELESS.search(text) is not None
    word = _MIXED_WORD if mixed else _WORD
    marks = [m.end() for m in _CUT.finditer(text)]
    if not marks or marks[-1] < len(text):
        marks.append(len(text))
    for mark in marks:
        between = [w.rstrip() for w in word.findall(text, last, mark)] if mixed else text[last:mark].split()
        words += between
        last = mark
        if len(between) < 2 and mark < len(text):
            continue
        if len(words) > LONGEST:
            found = list(_cut_long(text, start, mark, word))
            found[-1] = (mark, found[-1][1])
            ends += [e for e, _ in found]
            each += [w for _, w in found]
        else:
            ends.append(mark)
            each.append(words)
        start, words = mark, []
    return ends, each


def split_sentences(text: str | None) -> list[str]:
    """The pieces of a text; joined they give the text."""
    ends, _ = cut_text(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def span_rows(each: list[list[str]], sentences: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, the first piece and the number of pieces of each span, from the pieces' words. Pieces without a word don't count."""
    full = np.array([i for i, w in enumerate(each) if w], np.int64)
    if not len(full):
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    both = [xxhash.xxh3_128_intdigest(_lower(each[i])) for i in full]
    one, two = (np.array([(h >> s) & (2**64 - 1) for h in both], np.uint64) for s in (0, 64))
    total = np.cumsum([0, *(len(each[i]) for i in full)])
    ends = np.maximum(np.searchsorted(total, total[:-1] + words), np.arange(len(full)) + sentences)
    start = np.flatnonzero(ends <= len(full))
    length = ends[start] - start
    out = [np.full(len(start), _MIX[0]), np.full(len(start), _MIX[1])]
    for k in range(int(length.max()) if len(start) else 0):
        here = np.flatnonzero(length > k)
        for o, h, m in zip(out, (one, two), _MIX, strict=True):
            x = (o[here] ^ h[start[here] + k]) * m
            o[here] = x ^ (x >> np.uint64(31))
    first = full[start]
    return out[0], out[1], first.astype(np.int32), (full[start + length - 1] - first + 1).astype(np.int32)


def _spans(sentences: int, words: int):
    names = ["doc_id", "th", "h1", "h2", "pos", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 300):
                batch = whole.slice(start, 300)
                each = [span_rows(cut_text(t)[1], sentences, words) for t in batch.column("text").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(each)), [len(e[0]) for e in each]))
                flat = [np.concatenate([e[i] for e in each]) for i in range(4)]
                columns = [batch.column("doc_id").take(at), batch.column("th").take(at), *(pa.array(c.view(np.int64)) for c in flat[:2]), *map(pa.array, flat[2:])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, within: bool = False) -> DataFrame:
    """doc_id, th, pos, n of every span that an earlier document has too. docs: doc_id, th (hash of the text), text.

    Rows that repeat doc_id and text are one document. ``within``: and of every later occurrence in the document that has
    the span first. A 64-bit hash, counted over the whole corpus, finds the spans that may repeat; a second one tells them apart.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = materialize(docs.mapInArrow(_spans(sentences, words), f"doc_id {id_type}, th bigint, h1 bigint, h2 bigint, pos int, n int"), "spans")
    twice = materialize(spans.groupBy("h1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1"), "twice")
    again = materialize(spans.join(twice, "h1"), "again")
    place = ("doc_id", "th", "pos") if within else ("doc_id", "th")
    firsts = again.groupBy("h1", "h2").agg(F.min(F.struct(*place)).alias("first"))
    later = again.join(materialize(firsts, "firsts"), ["h1", "h2"]).where(~F.struct(*place).eqNullSafe(F.col("first")))
    return later.select("doc_id", "th", "pos", "n")


def _remove(schema: T.StructType, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 300):
                batch = whole.slice(start, 300)
                row = batch.column("row")
                kept, counts, removed, runs = [], [], [], []
                for value, spans in zip(row.field(text).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    ends, _ = cut_text(value)
                    drop = np.zeros(len(ends) + 1, bool)
                    for span in spans or ():
                        drop[span["pos"] : span["pos"] + span["n"]] = True
                    edges = np.flatnonzero(np.diff(np.r_[False, drop])).tolist()
                    kept.append(value if not spans else "".join(value[a:b] for a, b, d in zip([0, *ends], ends, drop, strict=False) if not d))
                    counts.append(len(ends)), removed.append(int(drop.sum()))
                    runs.append(",".join(f"{a}-{b - 1}" for a, b in zip(edges[::2], edges[1::2], strict=True)))
                new = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.string()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*(row.field(i) for i in range(row.type.num_fields)), *new], schema.names)

    return run


def remove_repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, key: str = "doc_id", text: str = "text", within: bool = False) -> DataFrame:
    """Rows of ``docs`` with n_sentences (pieces), n_removed, removed (ranges of pieces, from 0) and clean_text added.

    Words are cut at white space, and each letter of a script without spaces is one; they are compared with A-Z lower-cased. Null texts stay null and empty ones empty, with no
    sentences. Rows that repeat key and text are one document, and all keep or lose the same pieces; rows of a null key
    are told apart by their texts and come before all others, so that a passage they hold stays with them. Columns named as those added are replaced; all others come back as they were. An empty
    table gives an empty one. Texts are read whole, however long.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    found = repeated_spans(rows, sentences, words, within).groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))
    found = materialize(found.select(F.col("doc_id").alias("other_id"), F.col("th").alias("other_th"), "spans"), "removals")
    own = packed(docs, F.col(key).alias("own_id"), F.xxhash64(text).alias("own_th"))
    marked = own.join(found, F.col("own_id").eqNullSafe(F.col("other_id")) & (F.col("own_th") == F.col("other_th")), "left").select("row", "spans")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in ADDED.items())])
    return marked.mapInArrow(_remove(schema, text), schema)
