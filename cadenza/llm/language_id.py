"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is lower-cased, encoded in UTF-8 and cut into windows of fixed length, all of it; the last window is filled
with spaces. Bytes are embedded, filters of several widths run over each window, each filter's maximum is kept, and a softmax
over the languages follows. A text's prediction is the mean of its windows' log probabilities, by their bytes.
Applied, the filters are sums of table entries for bytes and pairs of bytes, which equals the convolution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import is_held_out, materialize

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDED = 8, 8
#: Documents of each language, at most, that are learned from, and windows of each; documents of all languages together.
DOCS_EACH, WINDOWS_EACH, DOCS_IN_ALL = 1500, 3, 60_000
UNKNOWN = "und"


def windows_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(windows of LENGTH bytes, bytes of the text in each)."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8) if text else np.zeros(0, np.uint8)
    n = -(-len(data) // LENGTH)
    out = np.full(n * LENGTH, 32, np.uint8)
    out[: len(data)] = data
    sizes = np.full(n, LENGTH, np.float64)
    if n:
        sizes[-1] = len(data) - (n - 1) * LENGTH
    return out.reshape(n, LENGTH), sizes


@dataclass
class ByteNetwork:
    languages: list[str]
    embedding: np.ndarray = field(default=None)
    filters: list[np.ndarray] = field(default=None)
    bias: np.ndarray = field(default=None)
    dense: np.ndarray = field(default=None)
    offset: np.ndarray = field(default=None)

    def start(self, seed: int) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        wide = len(WIDTHS) * FILTERS
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.filters = [rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias, self.offset = np.zeros(wide, np.float32), np.zeros(len(self.languages), np.float32)
        self.dense = rng.normal(0, wide**-0.5, (wide, len(self.languages))).astype(np.float32)
        return self

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.bias, self.dense, self.offset]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width, entries by pair of bytes, and by the last byte if the width is odd."""
        out = []
        for w, kernel in zip(WIDTHS, self.filters, strict=True):
            single = [self.embedding @ kernel[k * EMBEDDED : (k + 1) * EMBEDDED] for k in range(w)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
            out.append([np.ascontiguousarray(p, np.float32) for p in pairs + single[w - w % 2 :]])
        return out


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def log_probabilities(net: ByteNetwork, tables: list[list[np.ndarray]], windows: np.ndarray, chunk: int = 128) -> np.ndarray:
    out = np.zeros((len(windows), len(net.languages)), np.float64)
    for start in range(0, len(windows), chunk):
        single = windows[start : start + chunk].astype(np.intp)
        pair = single[:, :-1] * 256 + single[:, 1:]
        pooled = []
        for w, parts in zip(WIDTHS, tables, strict=True):
            n = LENGTH - w + 1
            total = np.take(parts[0], pair[:, :n], axis=0)
            for k, part in enumerate(parts[1:], 1):
                total += np.take(part, pair[:, 2 * k : 2 * k + n] if len(part) > 256 else single[:, w - 1 :], axis=0)
            pooled.append(total.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0)
        out[start : start + chunk] = _log_softmax((z @ net.dense + net.offset).astype(np.float64))
    return out


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = 5, seed: int = 5, batch: int = 64) -> ByteNetwork:
    """Adam on cross-entropy, languages weighted alike. Gradients reach the bytes where a filter has its maximum."""
    net = ByteNetwork(languages).start(seed)
    rng, share = np.random.default_rng(seed), np.bincount(target, minlength=len(languages))
    weight = (len(target) / (len(languages) * np.maximum(share, 1)))[target].astype(np.float32)
    params = net.parameters()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(target)), max(1, len(target) // batch)):
            raw, rows = windows[part], np.arange(len(part))
            x = net.embedding[raw]
            pooled, where = [], []
            for w, kernel in zip(WIDTHS, net.filters, strict=True):
                n = LENGTH - w + 1
                view = np.lib.stride_tricks.as_strided(x, (len(part), n, w * EMBEDDED), (x.strides[0], x.strides[1], x.strides[2]))
                y = view.reshape(-1, w * EMBEDDED) @ kernel
                y = y.reshape(len(part), n, FILTERS)
                best = y.argmax(axis=1)
                where.append(best)
                pooled.append(np.take_along_axis(y, best[:, None], axis=1)[:, 0])
            z = np.concatenate(pooled, axis=1) + net.bias
            a = np.maximum(z, 0)
            d = np.exp(_log_softmax(a @ net.dense + net.offset))
            d[rows, target[part]] -= 1
            d *= weight[part][:, None] / len(part)
            back = (d @ net.dense.T) * (z > 0)
            grads_e, grads_f = np.zeros_like(net.embedding), []
            for i, (w, kernel, best) in enumerate(zip(WIDTHS, net.filters, where, strict=True)):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                at = best[:, :, None] + np.arange(w)  # window, filter, offset
                taken = raw[rows[:, None, None], at]
                patch = net.embedding[taken].reshape(len(part), FILTERS, w * EMBEDDED)
                grads_f.append(np.einsum("nf,nfk->kf", g, patch))
                into = (g[:, :, None] * kernel.T[None]).reshape(-1, EMBEDDED)
                np.add.at(grads_e, taken.reshape(-1), into)
            step += 1
            for p, mm, vv, g in zip(params, m, v, [grads_e, *grads_f, back.sum(axis=0), a.T @ d, d.sum(axis=0)], strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= 0.01 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return net


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, lang, text -> h, lang, window: the first, the last and the middle one of a text, those it has."""
    for batch in batches:
        hs, langs, out = [], [], []
        for h, lang, text in zip(*(batch.column(c).to_pylist() for c in ("h", "lang", "text")), strict=True):
            found, _ = windows_of(text)
            for i in sorted({0, len(found) - 1, len(found) // 2})[:WINDOWS_EACH] if len(found) else ():
                hs.append(h), langs.append(lang), out.append(found[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["h", "lang", "window"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_each: int = DOCS_EACH, docs_in_all: int = DOCS_IN_ALL) -> ByteNetwork | None:
    """Learns from at most ``docs_each`` documents of each language, and fewer if all languages together would give more than
    ``docs_in_all`` (then each has an equal share, one document at least): those of the smallest id hashes. Every language
    of the labelled documents can be predicted.

    Rows with a null language, id or text and held-out rows are left out. None if nothing is left. Only the sample's windows,
    three of a fixed size for each document, come to the driver.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("k").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("k")))
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = max(1, min(docs_each, docs_in_all // max(1, counts.count())))
    h = F.xxhash64("k")
    part = F.least(F.lit(1.0), F.lit(2.0 * each + 20) / F.col("n"))  # more than twice as many as needed, so that hardly a language falls short
    some = rows.join(counts, "lang").where(F.pmod(h, F.lit(1 << 20)) < part * (1 << 20))
    some = materialize(some.select(h.alias("h"), "lang", "text"), "language-sample")
    first = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= each)
    held = first.select("h", "lang", "text").mapInArrow(_sample_windows, "h bigint, lang string, window binary").toPandas()
    if not len(held):
        return None
    held = held.sort_values(["h", "window"], kind="stable")
    languages = sorted(held["lang"].unique())
    target = held["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    windows = np.frombuffer(b"".join(held["window"]), np.uint8).reshape(-1, LENGTH)
    return train(windows, target, languages)


def predict(docs: DataFrame, net: ByteNetwork | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and lang_score (0 to 1) to every row of ``docs``; columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned.
    """
    docs = docs.drop("lang_pred", "lang_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                texts = batch.column(text).to_pylist()
                known = [i for i, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    each = [windows_of(texts[i]) for i in known]
                    sizes = np.concatenate([s for _, s in each])
                    logs = log_probabilities(net, tables, np.concatenate([w for w, _ in each])) * sizes[:, None]
                    first = np.cumsum([0, *(len(s) for _, s in each)])[:-1]
                    mean = np.add.reduceat(logs, first, axis=0) / np.add.reduceat(sizes, first)[:, None]
                    p = np.exp(_log_softmax(mean))
                    for i, j, q in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
                        names[i], scores[i] = net.languages[j], float(min(q, 1.0))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)
