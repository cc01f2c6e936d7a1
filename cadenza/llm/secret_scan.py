"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

The patterns find the base spans. Their matches in a bounded sample of documents are the labelled credentials
of each kind; ordinary long tokens of the sample are the contrast. For every kind, and for the contrast, a prefix tree of
character classes is turned into a small probabilistic automaton by merging states whose futures are
statistically compatible (ALERGIA with Hoeffding bounds). Every candidate of every text is then scored by the
automata, the patterns' matches too: its likelihood is that of the best kind's automaton over that of ordinary tokens. Candidates
outside the base spans that fit a credential format far better than ordinary tokens become further spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.common import materialize

KINDS = ("assign", "access", "hex")
ADDED = "format"
#: Documents, at most about, of the sample; credentials of a kind and ordinary tokens, at most, that are learned from.
SAMPLE_DOCS, SAMPLE_VALUES = 20_000, 400
#: A candidate must beat the ordinary tokens' automaton by this much per character (natural log), and its own kind's
#: automaton must give it at least the score that this share of the labelled credentials reach.
MARGIN, REACHED = 0.25, 0.98

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

#: Character classes: a-f, g-z, A-F, G-Z, digits, and each sign by itself; the end comes last.
CLASSES = [*"ahAHd", *"+/_.=-"]
END = len(CLASSES)
_CLASS_OF = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS_OF[_i] = 0 if _c in "abcdef" else 1 if "a" <= _c <= "z" else 2 if _c in "ABCDEF" else 3 if "A" <= _c <= "Z" else 4 if "0" <= _c <= "9" else CLASSES.index(_c) if _c in "+/_.=-" else 0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind number, end, credential) of the patterns' matches, in code points.

    Runs that are too short are no matches: for the two run patterns, asking for the least length finds the same spans;
    an assignment with a short value is dropped only after it matched, since what it took isn't searched again.
    """
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


@dataclass
class Automaton:
    """Dense tables: step[state, class] and logs[state, class or end]; state 0 starts, the last state takes what is unseen."""

    step: np.ndarray
    logs: np.ndarray
    least: float = -math.inf

    def mean_logs(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log likelihood per symbol, the end included, of the strings at ``starts`` of ``data`` (classes)."""
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        order = np.argsort(-lengths, kind="stable")
        shorter = lengths[order]
        for k in range(int(lengths.max()) if len(lengths) else 0):
            here = order[: np.searchsorted(-shorter, -k, "left")]  # those longer than k
            sign = data[starts[here] + k]
            total[here] += self.logs[state[here], sign]
            state[here] = self.step[state[here], sign]
        return (total + self.logs[state, END]) / (lengths + 1)


def infer(words: list[bytes], alpha: float = 0.05, smoothing: float = 0.05) -> Automaton:
    """Merges compatible states of the prefix tree of ``words``, red-blue order; words repeat as often as given."""
    n, ends, kids = [0], [0], [{}]
    for word in words:
        at = 0
        n[0] += 1
        for c in _CLASS_OF[np.frombuffer(word, np.uint8)].tolist():
            if c not in kids[at]:
                kids[at][c] = len(n)
                n.append(0), ends.append(0), kids.append({})
            at = kids[at][c]
            n[at] += 1
        ends[at] += 1
    flow = [{c: n[t] for c, t in k.items()} for k in kids]
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (n1**-0.5 + n2**-0.5)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ends[a], n[a], ends[b], n[b]) or any(differ(flow[a].get(c, 0), n[a], flow[b].get(c, 0), n[b]) for c in flow[a].keys() | flow[b].keys()):
                return False
            todo += [(kids[a][c], kids[b][c]) for c in kids[a].keys() & kids[b].keys()]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n[a], ends[a] = n[a] + n[b], ends[a] + ends[b]
            for c, t in kids[b].items():
                flow[a][c] = flow[a].get(c, 0) + flow[b][c]
                if c in kids[a]:
                    todo.append((kids[a][c], t))
                else:
                    kids[a][c] = t

    red = [0]
    while True:
        blue = [(n[t], -t, r, c) for r in red for c, t in kids[r].items() if t not in red]
        if not blue:
            break
        _, minus, r, c = max(blue)
        state = -minus
        for other in red:
            if compatible(other, state):
                kids[r][c] = other
                fold(other, state)
                break
        else:
            red.append(state)
    names = {s: i for i, s in enumerate(red)}
    rest = len(red)
    step = np.full((rest + 1, END), rest, np.int64)
    counts = np.full((rest + 1, END + 1), smoothing)
    for s, i in names.items():
        counts[i, END] += ends[s]
        for c, t in kids[s].items():
            step[i, c] = names[t]
            counts[i, c] += flow[s][c]
    return Automaton(step, np.log(counts / counts.sum(axis=1, keepdims=True)))


def _pack(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], np.int64)
    return _CLASS_OF[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(lengths) - lengths, lengths


@dataclass
class FormatModel:
    """Automata of the kinds, and of ordinary tokens."""

    kinds: list[Automaton]
    ordinary: Automaton | None

    def judge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How much likelier the best kind's automaton makes each word than ordinary tokens' does (natural log per symbol), and
        whether it fits that format. NaN and False before anything was learned."""
        gain, fits = np.full(len(words), np.nan), np.zeros(len(words), bool)
        if self.ordinary is None or not words or not self.kinds:
            return gain, fits
        packed = _pack(words)
        plain = self.ordinary.mean_logs(*packed)
        for automaton in self.kinds:
            score = automaton.mean_logs(*packed)
            gain = np.fmax(gain, score - plain)
            fits |= (score >= automaton.least) & (score - plain >= MARGIN)
        return gain, fits


def other_candidates(text: str, base: list[tuple[int, int, str, str]]) -> Iterator[re.Match]:
    """Candidates that overlap no base span. Both are in order of their starts, so one pass over each does it."""
    at = reach = 0  # the end of all base spans that begin before a candidate's end
    for m in _CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            yield m


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> kind, value: credentials, and as kind 3 the candidates outside base spans."""
    for batch in batches:
        kinds, values = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            for _, kind, _, value in base:
                kinds.append(kind), values.append(value)
            for m in other_candidates(text, base):
                kinds.append(3), values.append(m[0])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string())], ["kind", "value"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> FormatModel:
    """Learns from at most SAMPLE_VALUES distinct credentials of each kind, and as many ordinary tokens, of a sample of about
    SAMPLE_DOCS documents; both those of the smallest hashes. A kind without credentials has no automaton."""
    whole = docs.select(F.lit(1)).count()
    share = min(1.0, SAMPLE_DOCS / max(1, whole))
    # by id and text: rows that share an id, or have none, are drawn one by one
    some = docs.where(F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(1 << 20)) <= int(share * (1 << 20)))
    found = materialize(some.select(F.col(text).alias("text")).mapInArrow(_labelled, "kind int, value string").distinct(), "credentials")
    words: list[list[bytes]] = []
    for kind in range(4):
        rows = found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE_VALUES).collect()
        words.append([r["value"].encode() for r in rows])
    automata = []
    for learned in words[:3]:
        if learned:
            automaton = infer(learned)
            scores = np.sort(automaton.mean_logs(*_pack(learned)))
            automaton.least = float(scores[int((1 - REACHED) * (len(scores) - 1))])
            automata.append(automaton)
    return FormatModel(automata, infer(words[3]) if words[3] else None)


def _join(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, ADDED)
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(docs: DataFrame, model: FormatModel, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with n_assign, n_access, n_hex, base_sha256, spans, n_format, n_candidates, best_likelihood and
    likelihoods added (such columns are replaced).

    Spans are kind:start:end in code points, the end exclusive, by start, then by kind as listed (format last), then by
    end, comma-joined. Format spans don't overlap base spans. n_candidates counts what was scored: the base spans'
    credentials and all other candidates; best_likelihood is their highest likelihood (null without any), and
    likelihoods those of the spans, to 3 digits, in the spans' order. Null texts count as empty; empty ones have no spans.
    """
    added = {
        "n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base_sha256": T.StringType(), "spans": T.StringType(), "n_format": T.LongType(),
        "n_candidates": T.LongType(), "best_likelihood": T.DoubleType(), "likelihoods": T.StringType(),
    }
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in added.items())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                places, words, first = [], [], [0]  # of all candidates: (start, kind, end) and credential; where texts begin
                for value in batch.column(text).to_pylist():
                    found = base_spans(value or "")
                    for s, k, e, credential in found:
                        places.append((s, k, e)), words.append(credential.encode())
                    for m in other_candidates(value or "", found):
                        places.append((m.start(), 3, m.end())), words.append(m[0].encode())
                    first.append(len(places))
                gain, fits = shared.value.judge(words)
                rows: list[list] = [[] for _ in added]
                for a, b in zip(first, first[1:], strict=False):
                    base = [p for p in places[a:b] if p[1] < 3]
                    spans = sorted((places[j], gain[j]) for j in range(a, b) if places[j][1] < 3 or fits[j])
                    best = float(np.max(gain[a:b])) if b > a else None
                    one = [
                        *(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(_join(base).encode()).hexdigest(), _join([p for p, _ in spans]), len(spans) - len(base),
                        b - a, None if best is None or math.isnan(best) else best, ",".join("" if math.isnan(g) else f"{g:.3f}" for _, g in spans),
                    ]
                    for held, x in zip(rows, one, strict=True):
                        held.append(x)
                kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, kinds[t]) for x, t in zip(rows, added.values(), strict=True))], schema.names)

    return docs.mapInArrow(run, schema)
