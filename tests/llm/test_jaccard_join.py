import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm.components import connected_components
from cadenza.llm.jaccard_join import SMALL, _shared_keys, band, bands, most_apart, near_duplicates, set_keys


def brute(texts):
    """component by brute force over (id, text)."""
    sets = {}
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_links_match_brute_force(spark):
    rng, texts = random.Random(3), []
    shared = [f"s{i}" for i in range(60)]
    for i in range(260):
        words = [f"v{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 60, 200, 700]))]
        if i % 4 == 0:
            words = words + shared
        for times in [0, *(rng.choice([0, 1, 1, 2, 4, 8]) for _ in range(rng.choice([0, 0, 1, 3])))]:
            texts.append((len(texts), " ".join(edited(rng, words, times) + words[: rng.choice([0, 0, 1, 5])])))
    hub = [f"h{i}" for i in range(90)]
    texts += [(len(texts) + i, " ".join(edited(rng, hub, rng.choice([0, 1, 2, 3])))) for i in range(120)]
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One two", "x"), (5, "one  TWO", "x"), (None, "one two", "x"), (6, "a b c d e f", "x"), (6, "a b c d e f", "x"), (7, "É a", "x"), (8, "é a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, 4), (6, 2, 6), (6, 2, 6), (7, 1, 7), (8, 1, 8)]
    assert got == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 50])
def test_shared_keys_across_batches(cut):
    rng = np.random.default_rng(cut)
    rows = sorted((int(k), int(c)) for k, c in zip(rng.integers(0, 12, 60), rng.integers(0, 6, 60), strict=True))
    table = pa.table({"key": [k for k, _ in rows], "class": [c for _, c in rows]})
    got = [r for b in _shared_keys(iter(table.to_batches(max_chunksize=cut))) for r in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True)]
    by_key = {}
    for k, c in rows:
        by_key.setdefault(k, set()).add(c)
    assert sorted(got) == sorted((k, c) for k, cs in by_key.items() if len(cs) > 1 for c in cs)


def test_bound_on_the_difference():
    for small in range(1, 400):
        for large in range(small, small * 5 // 4 + 1):
            least = -(-4 * (small + large) // 9)  # intersections that link
            least = next(i for i in range(max(0, least - 1), small + 2) if 100 * i >= 80 * (small + large - i))
            if least <= small:
                assert small + large - 2 * least <= most_apart(small)
                assert band(small) in bands(large) or most_apart(large) == 0


def test_chain_of_near_copies(spark):
    """Each text has the words of the one before but for the first; ids are shuffled, so labels must travel far."""
    rng, n = random.Random(11), 2000
    ids = rng.sample(range(10**6), n)
    texts = [(ids[i], " ".join(f"w{k}" for k in range(4 * i, 4 * i + 60))) for i in range(n)]
    out = near_duplicates(spark.createDataFrame(rng.sample(texts, n), "doc_id long, text string").repartition(4)).collect()
    assert len(out) == n and {r.component_id for r in out} == {min(ids)}


@pytest.mark.parametrize("kind", ["chain", "sorted", "mixed", "none"])
def test_components_match_brute_force(spark, kind):
    rng, n = random.Random(12), 3000
    ids = [rng.getrandbits(63) - 2**62 for _ in range(n)]
    ids = sorted(ids) if kind == "sorted" else ids
    pairs = [(ids[i], ids[i + 1]) for i in range(n - 1)] if kind in ("chain", "sorted") else []
    if kind == "mixed":
        pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(n // 2)] + [(ids[0], x) for x in ids[-200:]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert len(got) == len(want) and {r.node: r.comp for r in got} == want


def test_linked_sets_share_a_key_and_small_unlike_ones_hardly_do():
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, np.uint64))
    for n in [*range(4, SMALL + 8), 40, 300]:
        for _ in range(60):
            a = draw(n)
            keep = rng.permutation(a)[: len(a) - rng.integers(0, len(a) // 5 + 1)]
            b = np.unique(np.r_[keep, draw(rng.integers(0, 4))])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(np.intersect1d(set_keys(a), set_keys(b))) or most_apart(len(a)) == 0
    # 4,000 sets of 4 to 12 unlike shingles: no key brings even three of them together
    keys = np.concatenate([set_keys(draw(rng.integers(4, SMALL + 1))) for _ in range(4000)])
    assert np.unique(keys, return_counts=True)[1].max() <= 2
