"""Hard negatives, the divergence audit and packing, against plain loops, with odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import divergence, hard_negatives, packing

# Hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    live = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in live), default=0)
    live = [(i, y, v + [0] * (width - len(v))) for i, y, v in live]
    out = []
    for i, y, v in live:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in live if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fits = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string").repartition(3)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect()))


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_negatives_equal_all_scores(spark, monkeypatch, dims):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 2)
    rng = np.random.default_rng(dims)
    centre = rng.standard_normal((4, dims))
    rows = [(i * 10, (centre[i % 4] * 0.4 + rng.standard_normal(dims) * 0.3).astype("f4").tolist(), int(rng.integers(3))) for i in range(200)]
    rows += [(5, rows[0][1], 1), (6, rows[0][1], 2), (7, rows[0][1], 2)]  # ties
    found = mined(spark, rows)
    assert found == brute_negatives(rows) and len(found) > 50


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.0], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [0.5, 0.0], None), (None, [0.5, 0.0], 2)]
    rows += [(8, [0.5], 2), (9, [], 2), (100, [0.0, 0.0], 1), (200, [], 3)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []
    # components that are too large are held to the largest that can't overflow
    assert mined(spark, [(0, [1e300, 0.0], 1), (1, [1e300, 0.0], 1), (2, [1e6, 1.0], 2)]) == []
    again = rows[:3] + [rows[0]]
    assert mined(spark, again) == [(0, 1, 1, 2, 65536, 32768)] * 2


def test_intervals_hold_the_scores_and_spare_some():
    rng = np.random.default_rng(3)
    dims, n = 64, 400
    values = rng.standard_normal((n, dims)) * 0.2
    values[:40] = values[0] + rng.standard_normal((40, dims)) * 0.02
    turn = hard_negatives.rotation(dims)
    ints = np.floor(256 * values)
    norm = np.sqrt((ints * ints).sum(1))
    rotated = ints @ turn / norm[:, None]
    block = hard_negatives.Block.__new__(hard_negatives.Block)
    block.n, block.norm, block.alignment, block.ints = n, norm, np.abs(rotated).sum(1) / 8, ints.astype("<i4")
    block.codes = np.packbits(rotated > 0, axis=1, bitorder="little").view("<u8")
    block.ones = np.bitwise_count(block.codes).sum(1, dtype=np.int64)
    block.rest = np.sqrt(1 - block.alignment**2) + hard_negatives.SLACK
    anchor = ints[0].astype(np.int64)
    low, high = block.intervals(anchor, turn)
    score = block.score(np.arange(n), anchor)
    assert (low <= score).all() and (score <= high).all()
    every = np.arange(n)
    sure = hard_negatives._sure(block, every, (low + high) / 2, anchor, 5)
    assert sure <= np.sort(score)[-5] and (high < sure).sum() > n / 2  # of the rows, these needn't be scored


# Divergence


def brute_audit(rows, least_docs=3, ranks=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(words(text)))
        counts[lang, source].update(words(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(Counter({t: counts[lang, s][t] for t in kept})) for s in sources}
        q = shares(Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept}))
        apart = lambda x, y: (x - y) ** 2 // y
        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, r) for r, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", o, -v, r) for r, (v, _, o) in enumerate(sorted(terms)[:ranks], 1)]
    return sorted(out)


def audited(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, n int").repartition(3)
    return sorted(map(tuple, divergence.audit(df, **more).collect()))


def test_audit_equals_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha Beta gamma délta été e1f 中文 x y z".split())
    rows = [(" ".join(word() for _ in range(rng.randrange(30))), rng.choice(("en", "de")), f"s{min(rng.randrange(9), rng.randrange(9))}") for _ in range(120)]
    rows += [(None, "en", "s1"), ("", "fr", None), ("alpha", None, "s2"), (None, None, "s3"), ("123 !", "en", "only")] + [rows[0]] * 5
    rows.append(("longword" * 5000 + " alpha" * 20_000, "en", "s1"))
    assert audited(spark, rows) == brute_audit(rows)
    few = audited(spark, rows, least_docs=1, term_ranks=2)
    assert few == brute_audit(rows, 1, 2) and max(r[5] for r in few if r[2] == "term") == 2
    assert audited(spark, []) == []


def test_audit_spares_tasks_memory(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_HELD", 3)
    rows = [("a b c d", "en", "x"), ("a b", "en", "y"), ("a c", "en", "z")] * 3
    assert audited(spark, rows) == brute_audit(rows)


def test_tree_shares_paths(spark):
    rows = [("t%s" % i, 3, [("a", 1), ("b", 2)] if i % 2 else [("a", 1)]) for i in range(10)]
    df = spark.createDataFrame([("en", t, n, p) for t, n, p in rows], "lang string, term string, total long, path array<struct<source: string, count: long>>")
    nodes = {tuple(map(tuple, r.prefix)): r.n for r in divergence.pattern_tree(df).collect()}
    assert nodes == {(("a", 1),): 10, (("a", 1), ("b", 2)): 5}


# Packing


@pytest.fixture(scope="module")
def files():
    pytest.importorskip("public_tokenizers")
    return packing.vocabulary_files()


def checked(rows, docs, length, encode, end=0):
    """Every piece as the rules say, sequences without gaps; how many there are."""
    own, where = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        where[r.sequence_id].append((r.offset, r.length))
    assert set(own) == {d for d, _ in docs}
    for doc, text in docs:
        ids = np.array([*encode(text or ""), end], "<u4")
        first = (len(ids) - 1) % length + 1
        starts = [0, *range(first, len(ids), length)]
        want = [(i, a, len(p := ids[a : first + i * length]), zlib.crc32(p.tobytes())) for i, a in enumerate(starts)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own[doc]) == want
    for places in where.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(where)


def test_packed_pieces(spark, files):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(("alpha", "beta", "ünïcode", "中文", "x1")) for _ in range(int(rng.expovariate(0.02))))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "x<|endoftext|>y"), (903, "word " * 5000), (904, " " * 400_000 + "x"), (905, "ab" * 150_000)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(files["vocabulary"])
    whole.encode_special_tokens = True
    encode = lambda t: whole.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(4)
    got = packing.pack(df, **files, length=256, keep_ids=True)
    rows = got.collect()
    n = checked(rows, docs, 256, encode)
    total = sum(r.length for r in rows)
    assert -(-total // 256) <= n <= -(-total // 256) * 1.01 + 1
    joined = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert sum(map(len, joined.values())) == total and len(joined) == n
    slow = packing.pack(df, files["vocabulary"], length=256).collect()
    assert checked(slow, docs, 256, encode) == n


def test_packing_of_odd_tables(spark, files):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, **files).collect() == []
    same = spark.createDataFrame([("k", "one two")] * 50 + [(None, "three")] * 2, "doc_id string, text string").repartition(3)
    rows = packing.pack(same, **files, length=8).collect()
    places = Counter((r.sequence_id, r.offset) for r in rows)
    assert len(rows) == 52 and max(places.values()) == 1 and len({r.sequence_id for r in rows}) == 25


def test_plans_place_every_piece_once():
    rng = random.Random(4)
    for case in range(12):
        length = rng.choice((16, 100, 2048))
        counts = Counter(min(length, 1 + int(rng.expovariate(3 / length))) for _ in range(rng.choice((1, 30, 5000))))
        if case == 0:
            counts = Counter({length // 3: 7000, length // 2: 20_000})
        rows, seen, filled = packing.plan(dict(counts), length), Counter(), defaultdict(list)
        for size, first, n, sequence, per, offset in rows:
            assert first == seen[size] and n > 0
            seen[size] += n
            for i in range(n):
                filled[sequence + i // per].append((offset + i % per * size, size))
        assert seen == counts
        for places in filled.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= length
        assert len(filled) <= max(-(-sum(s * n for s, n in counts.items()) // length) * 1.03 + 1, sum(n for s, n in counts.items() if 2 * s > length) + 1)


def test_configurations_cover_the_counts():
    sizes, counts = [70, 45, 30, 12], [40, 100, 80, 33]
    chosen = packing.configurations(sizes, counts, 100)
    made = [sum(u * c.get(g, 0) for u, c in chosen) for g in range(4)]
    assert all(m >= n - 1e-6 for m, n in zip(made, counts, strict=True))
    assert all(sum(sizes[g] * k for g, k in c.items()) <= 100 for _, c in chosen)
    # at least what the tokens need, at most a packing found by hand: 40 of 70+30, 50 of 45+45, 14 of 30s and 5 of 12s
    used = sum(u for u, _ in chosen)
    assert sum(s * n for s, n in zip(sizes, counts, strict=True)) / 100 - 1e-6 <= used <= 109
