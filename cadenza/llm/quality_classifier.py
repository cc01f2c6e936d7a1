"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing gives every word a sparse ternary index vector drawn from its hash and adds up, for each
word, its own index vector and those of its neighbours in all documents. The sums are integers, so they don't depend on how rows are
partitioned. A document is the mean of its words' context vectors; a small numpy network scores it, and
one temperature of 1 or more, fitted on rows that the network didn't see, calibrates its probabilities. The vectors need no
labels and come from the whole corpus; only the network learns from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import column_at, is_held_out, materialize

DIMS = 32
#: Places of an index vector that aren't 0: one in each such part of it, so that none hits another.
MARKS = 4
#: Labelled rows that the network learns from, at most: those of the smallest id hashes.
SAMPLE_ROWS = 20_000
#: Words with a vector of their own: the most frequent of the corpus, at most so many, each found so often at least. All others
#: share vectors with others of their shape (see shape_of) and hash, of SPREAD hashes, in so many buckets; so every word of every
#: text has a vector, and two unlike words next to each other hardly ever the same.
VOCABULARY, LEAST_COUNT, SHAPES, SPREAD = 8192, 4, 4096, 16
#: Words whose vectors are looked up at a time, however long the texts are, and words whose numbers a task remembers.
CHUNK, REMEMBERED = 1 << 15, 300_000
_CLASS = bytes(97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def shape_of(word: bytes) -> bytes:
    """A word with a for each run of small letters and signs beyond ASCII, A for one of capitals, 0 for one of digits; runs of a sign become one."""
    return _RUN.sub(rb"\1", word.translate(_CLASS))


def index_vector(name: bytes) -> np.ndarray:
    """Four places of +1 or -1, one in each quarter."""
    h, out, wide = xxhash.xxh64_intdigest(name), np.zeros(DIMS, np.int32), DIMS // MARKS
    for k in range(MARKS):
        out[k * wide + (h >> 16 * k) % wide] = 1 if (h >> (16 * k + 15)) & 1 else -1
    return out


class Numbers(dict):
    """Words' numbers: their place in the vocabulary, or behind it the bucket of their shape and hash."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.words = words

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words) + xxhash.xxh32_intdigest(shape_of(word), xxhash.xxh32_intdigest(word) % SPREAD) % SHAPES
        return n

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def trim(self) -> None:
        if len(self) >= REMEMBERED:
            self.clear()
            self.update(zip(self.words, range(len(self.words)), strict=True))


def index_table(words: list[bytes]) -> np.ndarray:
    """The index vectors of all numbers."""
    return np.array([index_vector(w) for w in [*words, *(b"\0shape %d" % i for i in range(SHAPES))]], np.int32)


def _pieces(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> word, n: how often words occur, for each 200,000 distinct words or so."""
    words: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
        words.clear()
        return out

    for whole in batches:
        for batch in _pieces(whole):
            for text in batch.column("text").to_pylist():
                if text:
                    words.update(text.encode("utf-8", "surrogatepass").split())
            if len(words) >= 200_000:
                yield flush()
    yield flush()


def add_contexts(table: np.ndarray, ids: np.ndarray, ends: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total[i]`` the vectors of the words before, at and after each word i of ``ids``; texts end at ``ends``."""
    linked = np.ones(len(ids), np.int32)  # to the next word; not across documents
    linked[ends - 1] = 0
    for a in range(0, len(ids), CHUNK):
        b, low = min(a + CHUNK, len(ids)), max(a - 1, 0)
        own = table[ids[low : b + 1]]
        near = own[a - low : b - low].copy()
        near[low + 1 - a :] += own[: b - 1 - low] * linked[low : b - 1, None]
        behind = own[a - low + 1 :]
        near[: len(behind)] += behind * linked[a : a + len(behind), None]
        order = np.argsort(ids[a:b], kind="stable")
        there, first = np.unique(ids[a:b][order], return_index=True)
        total[there] += np.add.reduceat(near[order], first, axis=0)


def _contexts(shared):
    """text -> number, v0..: the sums of the contexts of a task's words."""
    names = ["number", *(f"v{i}" for i in range(DIMS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, table = Numbers(shared.value), index_table(shared.value)
        total = np.zeros(table.shape, np.int64)
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            each = [i for t in batch.column("text").to_pylist() if len(i := numbers.of(t))]
            if each:
                add_contexts(table, np.concatenate(each), np.cumsum([len(i) for i in each]), total)
            numbers.trim()
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, i]) for i in range(DIMS))], names)

    return run


def vocabulary_of(docs: DataFrame, size: int = VOCABULARY, least: int = LEAST_COUNT, text: str = "text") -> list[bytes]:
    """The ``size`` most frequent words of all documents. They are written before they are read, so that no more rows come to the driver."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_word_counts, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = materialize(counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size), "vocabulary")
    return [w for _, w in sorted((-r["n"], bytes(r["word"])) for r in top.collect())]


def context_sums(docs: DataFrame, words: list[bytes], text: str = "text") -> np.ndarray:
    """The sums of the contexts of all numbers over all documents; so many rows come to the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    columns = [f"v{i}" for i in range(DIMS)]
    found = docs.select(F.col(text).alias("text")).mapInArrow(_contexts(shared), "number bigint, " + ", ".join(f"{c} bigint" for c in columns))
    out = np.zeros((len(words) + SHAPES, DIMS), np.int64)
    for r in materialize(found.groupBy("number").agg(*(F.sum(c).alias(c) for c in columns)), "contexts").collect():
        out[r[0]] = r[1:]
    return out


@dataclass
class WordVectors:
    words: list[bytes]
    table: np.ndarray


def fit_vectors(docs: DataFrame, text: str = "text", size: int = VOCABULARY) -> WordVectors:
    """Context vectors of the corpus's words, of length 1, about their mean. What no document has keeps its index vector."""
    words = vocabulary_of(docs, size, text=text)
    sums = context_sums(docs, words, text)
    table = np.where(sums.any(axis=1, keepdims=True), sums, index_table(words)).astype(np.float64)
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    return WordVectors(words, (table - table[: len(words) or None].mean(axis=0)).astype(np.float32))


class Pooler:
    """Documents' features, from their words' vectors alone: the mean, and the mean product of vectors that stand side by
    side, by dimension, which tells running text from repetition. All 0 for a text without words."""

    width = 2 * DIMS

    def __init__(self, vectors: WordVectors):
        self.numbers, self.table = Numbers(vectors.words), vectors.table

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        self.numbers.trim()
        each = [self.numbers.of(t) for t in texts]
        lengths = np.array([len(i) for i in each], np.int64)
        out = np.zeros((len(texts), self.width), np.float32)
        full = np.flatnonzero(lengths)
        if len(full):
            ids = np.concatenate([each[i] for i in full])
            starts = np.cumsum(lengths[full]) - lengths[full]
            linked = np.ones(len(ids), np.float32)  # to the next word; not across documents
            linked[starts[1:] - 1] = linked[-1] = 0
            total = np.zeros((len(full), self.width))
            for a in range(0, len(ids), CHUNK):
                own = self.table[ids[a : a + CHUNK + 1]]
                n = min(CHUNK, len(ids) - a)
                one, last = np.searchsorted(starts, (a, a + n - 1), "right") - 1
                cuts = np.maximum(starts[one : last + 1] - a, 0)
                here, behind = own[:n], own[1 : n + 1]
                beside = here.copy()
                beside[: len(behind)] *= behind * linked[a : a + len(behind), None]
                beside[len(behind) :] = 0
                for i, part in enumerate((here, beside)):
                    total[one : last + 1, i * DIMS : (i + 1) * DIMS] += np.add.reduceat(part, cuts, axis=0)
            out[full] = total / lengths[full, None]
        return out


@dataclass
class Network:
    """tanh layer and logistic output; ``scale`` standardises the inputs; the logit is divided by ``temperature``."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return (np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on minibatches of the first six in seven rows; the temperature on the rest.

    Without rows the score is 0.5 everywhere; with one class only, the smoothed share of it.
    """
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return net
    rng, rest = np.random.default_rng(seed), np.arange(len(y)) % 7 == 6
    if len(set(y[~rest].tolist())) < 2:
        rest[:] = False
    fx, fy = x[~rest].astype(np.float64), y[~rest]
    net.mean, net.scale = fx.mean(axis=0), fx.std(axis=0) + 1e-6
    net.w1, net.w2 = rng.normal(0, width**-0.5, (width, hidden)), rng.normal(0, hidden**-0.5, hidden)
    z = np.clip((fx - net.mean) / net.scale, -5, 5)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(fy)), max(1, len(fy) // 128)):
            a = np.tanh(z[part] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -30, 30))) - fy[part]) / len(part)
            back = np.outer(d, params[2]) * (1 - a * a)
            step += 1
            for i, g in enumerate((z[part].T @ back + 1e-3 * params[0], back.sum(axis=0), a.T @ d + 1e-3 * params[2], np.array([d.sum()]))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                params[i] -= 0.004 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if rest.any():
        logit = net.logit(x[rest].astype(np.float64))
        net.temperature = float(min(np.exp(np.linspace(0, 2.5, 51)), key=lambda t: _loss(logit / t, y[rest])))
    return net


@dataclass
class QualityModel:
    vectors: WordVectors
    network: Network


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality", vocabulary: int = VOCABULARY
) -> QualityModel:
    """Vectors of all documents; a network of at most ``sample_rows`` labelled documents that aren't held out.

    The labelled rows are those of the smallest id hashes. Rows whose label or id is null are left out, and so are ids that
    rows with different texts share, since their label doesn't say which text it is of. Only fixed-size numbers come to the driver: the vocabulary and its vectors, and the sample's features.
    """
    vectors = fit_vectors(docs, text, vocabulary)
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    found = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")  # at most sample_rows ids
    # one text for each id, however often rows repeat it; a label doesn't say which of several texts it is of
    whole = F.coalesce("text", F.lit(""))
    each = found.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"), (F.min(whole) == F.max(whole)).alias("one"))
    sample = materialize(each.where("one").drop("one"), "labelled")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pooler(shared.value)
        for whole in batches:
            for batch in _pieces(whole):
                x = pool(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(list(x), pa.list_(pa.float32()))], ["h", "y", "x"])

    rows = sample.select(F.xxhash64("id", "text").alias("h"), "y", "text").mapInArrow(features, "h bigint, y double, x array<float>").toPandas()
    rows = rows.sort_values("h", kind="stable")
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, Pooler.width)
    return QualityModel(vectors, fit_network(x, (rows["y"].to_numpy() > 0.5).astype(np.float64)))


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Adds ``quality_score``, 0 to 1, to every row of ``docs`` (a column of this name is replaced).

    Texts are read whole; null ones count as empty, and all texts without a word have one score. ``text`` may be a field of a struct (``row.text``).
    """
    docs = docs.drop("quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pooler(shared.value.vectors)
        for whole in batches:
            for batch in _pieces(whole):
                p = shared.value.network.probability(pool(column_at(batch, text).to_pylist()).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, "quality_score"])

    return docs.mapInArrow(run, schema)
