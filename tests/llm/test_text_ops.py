"""Brute-force checks of the operators that score or search texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import decontamination, language_id, quality_classifier, quality_rules, queries, secret_scan, sharding
from cadenza.llm.common import TokenHashes, is_held_out
from cadenza.llm.decontamination import build_index, contamination, find_matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


# Decontamination


def brute_hits(docs, items):
    wins = defaultdict(set)
    for key, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - 9)):
            if w:
                wins[tuple(w[i : i + 10])].add(key)
    out = []
    for key, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        ids = ",".join(sorted(map(str, found)))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([3, 9, 10, 12, 30])))) for i in range(25)] + [(90, None), (91, " - "), (92, "One"), (93, "É été"), (7, "again the same id here")]
    docs = []
    for i in range(150):
        w = words(rng.randrange(60))
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = (rng.choice(items)[1] or "").split()
            cut = rng.randrange(3)
            w[len(w) // 2 : len(w) // 2] = part[cut:]
        docs.append((i, ", ".join(w).upper() if i % 3 else " ".join(w)))
    docs += [(900, None), (901, ""), (902, "one"), (903, "é ÉTÉ été"), (5, docs[5][1]), (None, items[3][1]), (904, items[3][1] + " " + "x " * 30_000)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, win string, row int").repartition(4)
    bench = spark.createDataFrame([(*b, "x") for b in items], "item_id long, text string, doc_id string")
    got = [tuple(r)[:6] for r in contamination(frame, bench).collect()]
    assert sorted(got, key=str) == sorted(brute_hits(docs, items), key=str)
    assert not any(r.contaminated for r in contamination(frame, bench.limit(0)).collect())
    assert contamination(frame.limit(0), bench).collect() == []


def test_proximity(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliett"
    texts = [(1, item), (2, item.replace("charlie delta", "delta charlie")), (3, item.replace("echo", "echo very")), (4, item.replace("echo", "never"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index, windows = build_index(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = index.select("row", "doc_id")
    found = find_matches(index, windows, slop=1).join(rows, "row").groupBy("doc_id").agg(F.bool_or("exact").alias("exact")).collect()
    assert {r.doc_id: r.exact for r in found} == {1: True, 2: False, 3: False}


def brute_near(docs, items, slop):
    """Proximity matches by document: runs of starts at which each word of a window stands within slop of its place, none of them exact."""
    out = Counter()
    for key, text in docs:
        w = WORD.findall(lower(text))
        for _, item in items:
            words = WORD.findall(lower(item))
            for i in range(max(1, len(words) - 9) if words else 0):
                want = words[i : i + 10]
                near = [s for s in range(-slop, len(w) + slop) if all(x in w[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k, x in enumerate(want))]
                runs = []
                for s in near:
                    if not runs or runs[-1][-1] != s - 1:
                        runs.append([])
                    runs[-1].append(s)
                out[key] += sum(all(s < 0 or w[s : s + len(want)] != want for s in run) for run in runs)
    return out


def test_proximity_matches_do_not_depend_on_other_documents(spark):
    words = [f"w{i}" for i in range(10)]
    swapped = words[:1] + [words[2], words[1]] + words[3:]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = [(1, " ".join(swapped)), (2, " ".join(words)), (3, " ".join(["x", *words[:4], "very", *words[4:]]))]
    more = [(10 + i, " ".join(w for w in words if w != rare)) for i, rare in enumerate(words[1:4])]  # each makes another word the rarest
    for others in ([], *([m] * 5 for m in more)):
        others = [(100 + i, t) for i, (_, t) in enumerate(others)]
        found = contamination(spark.createDataFrame(docs + others, "doc_id long, text string"), items, 10, 1)
        assert {r.doc_id: r.n_near for r in found.collect() if r.doc_id < 100} == {1: 1, 2: 0, 3: 1}


def test_op2_counts_proximity_matches(spark, tmp_path):
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 10, 14])))) for i in range(20)]
    docs = []
    for i in range(120):
        part = rng.choice(items)[1].split()
        k = rng.randrange(len(part) - 1)
        if i % 3 == 1:
            part[k : k + 2] = part[k + 1], part[k]
        elif i % 3 == 2:
            part.insert(k + 1, "very")
        docs.append((i, " ".join([f"w{rng.randrange(60)}" for _ in range(rng.randrange(9))] + part + ["end"] * rng.randrange(3))))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op2_positional_index_decontamination(spark, str(tmp_path)).collect()
    want = brute_near(docs, items, queries.SLOP)
    assert {r.doc_id: r.n_near for r in got} == {k: want[k] for k, _ in docs} and sum(r.n_near > 0 for r in got) > 40
    assert sorted(tuple(r)[:6] for r in got) == sorted(brute_hits(docs, items))
    duck = pytest.importorskip("duckdb").connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    found = duck.execute(queries.ORACLE_SQL["op2_positional_index_decontamination"])
    assert [c[0] for c in found.description] == got[0].__fields__ and sorted(found.fetchall()) == sorted(map(tuple, got))


# Quality rules


def test_rules_match_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "c#", "d", "é", "|"]) + rng.choice(["", "\n", "\n\n", "\t"]) for _ in range(rng.randrange(80))) for _ in range(120)]
    texts += [None, "", " \n ", "x\ny\nx\nx\r\nx", "a b c a b c", "a a a a", "a b", "x " * 20_000]
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, id string, words int").repartition(3)
    found = quality_rules.apply_rules(rows, rows.select("doc_id").limit(0), -0.3)
    assert found.columns == ["doc_id", "text", "id", "words", *quality_rules.ADDED]
    for r in found.collect():
        t = texts[r.doc_id] or ""
        w = SPACE.findall(t)
        windows, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert (r.id, r.words, r.llr, r.kept) == ("x", 1, 0.0, not r.base_failed)


def test_log_ratio_matches_brute_force(spark):
    """With so many buckets that n-grams hardly share one, ratios are those of the n-grams themselves."""
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(12)] + ["!!", "x_1", "é", "$$"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(30, 110))).upper() for _ in range(60)] + [None, "", "Ab,ab. AB!"]
    ids = [*range(60), None, 3, 61]  # a null id, and one that two rows have
    good, buckets = {i for i in range(60) if i % 4 == 3}, 1 << 16
    grams = []
    for t in texts:
        parts = re.findall(r"\w+|[^\w\s]+", (t or "").lower())
        grams.append([(p,) for p in parts] + list(zip(parts, parts[1:], strict=False)))
    raw, trusted = Counter(g for x in grams for g in x), Counter(g for i, x in zip(ids, grams, strict=True) if i in good for g in x)
    whole_r, whole_t = sum(raw.values()) + buckets, sum(trusted.values()) + buckets
    ratio = {g: math.log((trusted[g] + 1) / whole_t) - math.log((n + 1) / whole_r) for g, n in raw.items()}
    want = {(i, t): sum(ratio[g] for g in x) / len(x) if x else 0.0 for i, t, x in zip(ids, texts, grams, strict=True)}
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i,) for i in (*good, None)], "n long")
    bar = sorted(want.values())[len(want) // 2] + 1e-6
    got = {(r.doc_id, r.text): r for r in quality_rules.apply_rules(docs, labels, bar, buckets).collect()}
    off = [k for k in want if abs(got[k].llr - want[k]) > 1e-9]
    assert len(off) <= 2  # two of about 250 n-grams may fall into one bucket
    assert all(got[k].kept == (not got[k].base_failed and got[k].llr >= bar) for k in want)
    assert {got[k].kept for k in want} == {True, False}


def test_log_ratio_verdict(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["red", "blue", "green", "tree", "lake"]) + str(rng.randrange(30)) for _ in range(80))
    bad = lambda: " ".join("buy" + str(rng.randrange(9)) + "!!" for _ in range(80))
    texts = [good() if i % 3 else bad() for i in range(90)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i,) for i in range(90) if i % 3 == 1], "doc_id long")
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels, -0.3, 512).collect()}
    assert kept == {i: bool(i % 3) for i in range(90)}
    assert quality_rules.apply_rules(docs.limit(0), labels, 0.0).collect() == []


# Classifiers


def test_quality_classifier(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice("the of and to a in is it on as".split()) if rng.random() < 0.4 else f"word{rng.randrange(400)}" for _ in range(60))
    bad = lambda: " ".join(f"WORD{rng.randrange(400)}!!" if rng.random() < 0.9 else "THE!!" for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x" * 200_000), (None, good()), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality_score", F.lit("old")).repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score(docs, model).withColumn("held", is_held_out(F.col("doc_id"))).collect()
    assert len(out) == 405 and all(0 <= r.quality_score <= 1 for r in out)
    held = [r for r in out if r.held and (r.doc_id or 999) < 400]
    assert len(held) > 40 and sum((r.quality_score >= 0.3) == r.doc_id % 2 for r in held) >= 0.97 * len(held)
    assert all(r.held == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    same = quality_classifier.score(docs.repartition(5), quality_classifier.fit(docs.repartition(5), labels)).collect()
    assert {(r.doc_id, r.text): round(r.quality_score, 6) for r in same} == {(r.doc_id, r.text): round(r.quality_score, 6) for r in out}
    for few in (labels.limit(0), labels.where("quality = 1")):
        scores = {r.quality_score for r in quality_classifier.score(docs, quality_classifier.fit(docs, few)).collect()}
        assert len(scores) == 1


def test_random_indexing_matches_naive_loops(spark, monkeypatch):
    import numpy as np

    rng = random.Random(21)
    texts = [" ".join(rng.choice(["ab", "ab", "Cd,", "EF!!", "g-h", "it's", "x_1", "é", "FF!", "cd,"]) for _ in range(rng.randrange(30))) for _ in range(40)] + [None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = Counter(w for t in texts for w in (t or "").encode().split())
    words = quality_classifier.vocabulary_of(docs, 4, 2)
    assert words == [w for w, n in sorted(counts.items(), key=lambda r: (-r[1], r[0])) if n >= 2][:4]
    numbers, table = quality_classifier.Numbers(words), quality_classifier.index_table(words)
    want = np.zeros(table.shape, np.int64)
    for text in texts:
        w = (text or "").encode().split()
        for i, word in enumerate(w):
            for j in (i - 1, i, i + 1):
                if 0 <= j < len(w):
                    want[numbers[word]] += table[numbers[w[j]]]
    assert (quality_classifier.context_sums(docs, words) == want).all()
    import pyarrow as pa

    monkeypatch.setattr(quality_classifier, "CHUNK", 7)  # pieces of long texts, and words forgotten on the way
    monkeypatch.setattr(quality_classifier, "REMEMBERED", 6)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    (out,) = quality_classifier._contexts(type("B", (), {"value": words}))(iter([batch, batch]))
    assert {r["number"]: [r[f"v{i}"] for i in range(quality_classifier.DIMS)] for r in out.to_pylist()} == {i: (2 * v).tolist() for i, v in enumerate(want) if v.any()}


def test_index_vectors_and_shapes():
    for i in range(200):
        assert sorted(abs(quality_classifier.index_vector(b"w%d" % i)).tolist())[-5:] == [0, 1, 1, 1, 1]
    shapes = {b"word": b"a", "Été,".encode(): b"a,", b"Word.": b"Aa.", b"WORD!!": b"A!", b"x_123***": b"a_0*", b"": b""}
    assert {w: quality_classifier.shape_of(w) for w in shapes} == shapes


@pytest.mark.parametrize("chunk", [3, 1 << 15])
def test_pooling_matches_naive_loops(monkeypatch, chunk):
    import numpy as np

    monkeypatch.setattr(quality_classifier, "CHUNK", chunk)
    rng = random.Random(22)
    words = [b"ab", b"Cd,"]
    table = np.random.default_rng(1).normal(size=(2 + quality_classifier.SHAPES, quality_classifier.DIMS)).astype(np.float32)
    texts = [" ".join(rng.choice(["ab", "Cd,", "new", "ab", "X!"]) for _ in range(rng.randrange(20))) for _ in range(30)] + [None, "", "ab"]
    numbers = quality_classifier.Numbers(words)
    for text, x in zip(texts, quality_classifier.Pooler(quality_classifier.WordVectors(words, table))(texts), strict=True):
        each = [table[numbers[w]].astype(float) for w in (text or "").encode().split()]
        want = np.zeros(2 * quality_classifier.DIMS)
        if each:
            want = np.r_[np.mean(each, axis=0), np.sum([a * b for a, b in zip(each, each[1:], strict=False)] or [0 * each[0]], axis=0) / len(each)]
        assert np.allclose(x, want, atol=1e-4)


def test_temperature_softens(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 4)).astype(np.float32)
    y = ((x[:, 0] + rng.normal(size=700)) > 0).astype(float)
    net = quality_classifier.fit_network(x, y, epochs=200)
    assert net.temperature > 1.0 and abs(net.probability(x.astype(float)).mean() - y.mean()) < 0.1


def test_language_id(spark):
    rng = random.Random(8)
    sounds = {"aa": "ka ta ma ra na".split(), "bb": "schu ber gen lich".split(), "cc": "ción ñe osa".split()}
    text = lambda k: " ".join("".join(rng.choice(sounds[k]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120)))
    rows = [(i, text(k), k) for i, k in enumerate(rng.choice(list(sounds)) for _ in range(300))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 --", "bb"), (1003, "ka", None), (1004, "ka ta " * 50_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).repartition(3)
    out = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert len(out) == 305 and all(0 <= r.lang_score <= 1 for r in out.values())
    held = [i for i, _, _ in rows[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].lang_pred == out[i].lang for i in held) >= 0.95 * len(held)
    assert [out[i].lang_pred for i in (1000, 1001, 1002, 1004)] == ["und", "und", "und", "aa"]
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_table_lookup_equals_convolution():
    import numpy as np

    net = language_id.ByteNetwork(["a", "b"]).start(1)
    windows = np.random.default_rng(1).integers(0, 256, (3, language_id.LENGTH)).astype(np.uint8)
    x = net.embedding[windows]
    pooled = [np.max([x[:, i : i + w].reshape(3, -1) @ k for i in range(language_id.LENGTH - w + 1)], axis=0) for w, k in zip(language_id.WIDTHS, net.filters, strict=True)]
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.dense + net.offset
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(language_id.log_probabilities(net, net.tables(), windows), want, atol=1e-4)


# Secrets


def base(text):
    kinds = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), lambda m: len(m[2]) >= 12),
        (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m))


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(9)
    bits = ["password", "SECRET", "token", "api_key", "apikey", ":", "=", " ", '"', "'", "AKIA", "AKIA1234567890ABCD", "deadbeef", "0123456789abcdef", "é", "x", "\n", "short", "abcdefghijkl", "ſecret", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "password: token: abcdefghijklmnop", "a" * 100_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
    model = secret_scan.fit(docs)
    for r in secret_scan.scan(docs, model).collect():
        want = base(texts[r.doc_id])
        joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("format")] == joined.split(",") * bool(joined) and len(spans) == len(want) + r.n_format
    assert secret_scan.scan(docs.limit(0), secret_scan.fit(docs.limit(0))).collect() == []


def test_inferred_formats_find_look_alikes(spark):
    rng = random.Random(10)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(12, 18)))
    rows = [(i, f"{word()} {word()} {key() if i % 2 else ''} {word()}") for i in range(200)]
    look = [(500 + i, f"{word()} {key().replace('AKIA', 'ASIA')} {word()}") for i in range(20)]
    docs = spark.createDataFrame(rows + look, "doc_id long, text string")
    out = {r.doc_id: r for r in secret_scan.scan(docs, secret_scan.fit(docs)).collect()}
    assert sum(out[i].n_format == 1 for i, _ in look) >= 18 and sum(out[i].n_format for i, _ in rows) <= 2


def test_every_candidate_is_scored(spark):
    """Likelihoods against a plain walk through the automata, for base spans and all other candidates."""
    rng = random.Random(11)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [f"{word(14)} {key()} token: {word(13)}9 {word(3)} {'%032x' % rng.getrandbits(128)} {word(20)}" for _ in range(60)] + [None, "", "short words only", word(50_000)]
    docs = spark.createDataFrame([(i if i < 60 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    model = secret_scan.fit(docs)

    def log_likelihood(automaton, value):
        state, total = 0, 0.0
        for c in value.encode():
            k = secret_scan._CLASS_OF[c]
            total, state = total + automaton.logs[state, k], automaton.step[state, k]
        return (total + automaton.logs[state, secret_scan.END]) / (len(value) + 1)

    gain = lambda v: max(log_likelihood(a, v) for a in model.kinds) - log_likelihood(model.ordinary, v)
    for r in secret_scan.scan(docs, model).collect():
        text = r.text or ""
        found = secret_scan.base_spans(text)
        inside = lambda m: any(s < m.end() and m.start() < e for s, _, e, _ in found)  # noqa: B023, E731
        others = [m for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", text) if not inside(m)]
        assert r.n_candidates == len(found) + len(others)
        gains = [gain(v) for *_, v in found] + [gain(m[0]) for m in others]
        assert r.best_likelihood is None if not gains else abs(r.best_likelihood - max(gains)) < 1e-9
        spans = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        stated = [float(x) for x in r.likelihoods.split(",") if x]
        assert len(stated) == len(spans)
        want = {(k, s, e): gain(v) for s, k, e, v in found} | {(3, m.start(), m.end()): gain(m[0]) for m in others}
        for (kind, s, e), g in zip(spans, stated, strict=True):
            assert abs(g - want[(*secret_scan.KINDS, secret_scan.ADDED).index(kind), int(s), int(e)]) < 6e-4


def test_state_merging_on_a_small_language():
    """Words (ab)^n: the merged automaton goes round, and gives longer words of the language more than others."""
    automaton = secret_scan.infer([b"+/" * n for n in (1, 1, 1, 1, 2, 2, 2, 3, 3, 4)] * 20)
    assert len(automaton.step) <= 4
    assert abs(automaton.step[automaton.step[0, secret_scan.CLASSES.index("+")], secret_scan.CLASSES.index("/")]) in range(len(automaton.step) - 1)
    scores = automaton.mean_logs(*secret_scan._pack([b"+/" * 9, b"+/" * 8 + b"++", b"/+" * 9]))
    assert scores[0] > scores[1] + 0.1 and scores[0] > scores[2] + 0.1
    assert (abs(1 - __import__("numpy").exp(automaton.logs).sum(axis=1)) < 1e-9).all()


def test_more_languages_than_documents_for_all(spark):
    rows = [(i, f"word{i % 7} " * 20, f"l{i % 7}") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    net = language_id.fit(docs, docs_in_all=5)
    assert net.languages == [f"l{i}" for i in range(7)]
    out = language_id.predict(spark.createDataFrame([(None, "word1 " * 9), (None, None)], "doc_id long, text string"), net).collect()
    assert [r.lang_pred in net.languages for r in out] == [True, False]


# Sharding


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 41, 3000])
def test_jump_hash(spark, n):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(random.Random(n).getrandbits(63) for _ in range(200))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
    assert all(r.s == jump(r.k, n) for r in got)


@pytest.mark.parametrize("range_rows", [3, 2000])
def test_slots(spark, range_rows):
    rows = [(i, f"t{i % 7}é") for i in range(500)] + [(3, "t3é"), (3, "other"), (None, None), (None, "x"), (9, ""), (10, "long " * 200_000)] + [(11, f"one id {i}") for i in range(200)]
    df = spark.createDataFrame([(*r, "s", "d", "x") for r in rows], "doc_id long, text string, shard string, digest string, `range` string").repartition(4)
    out = sharding.assign_shards(df, 5, range_rows=range_rows).collect()
    assert {(r.digest, r.range) for r in out} == {("d", "x")}
    assert len(out) == len(rows)
    for s in range(5):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    for r in out:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key") and r.shard == jump(r.doc_id or 0, 5)
        assert r.grown_shard in (r.shard, 5)
    assert sharding.assign_shards(df.limit(0), 5).collect() == []


def test_keys_that_are_no_integers_are_hashed(spark):
    df = spark.createDataFrame([(f"doc-{i % 90}", f"t{i}") for i in range(200)] + [(None, "x"), ("7", None)], "doc_id string, text string").repartition(3)
    out = sharding.assign_shards(df, 6).collect()
    assert len(out) == 202 and all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(6))
    assert all(len({r.shard for r in out if r.doc_id == k}) == 1 and r.grown_shard in (r.shard, 6) for r in out for k in [r.doc_id])
    assert len({r.shard for r in out}) == 6 and next(r.shard for r in out if r.doc_id is None) == 0


def test_postings_of_long_texts_are_made_in_slices_of_bounded_bytes():
    """What a task holds at once depends on bytes, not on how many rows a batch has; long tokens aren't kept."""
    words = " ".join(f"word{i}" for i in range(15_000))
    texts = [words if i % 3 else None if i % 2 else "word1 word7" for i in range(120)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(120)), "text": texts})
    none = SimpleNamespace(value=np.packbits(np.ones(1 << decontamination.FILTER_BITS, bool)).tobytes())
    made = list(decontamination._postings(none)(iter([batch])))
    sizes = [sum(len(texts[i] or "") for i in part.column("doc_id").to_pylist()) for part in made]
    assert [i for part in made for i in part.column("doc_id").to_pylist()] == list(range(120))
    assert [n for part in made for n in part.column("n_words").to_pylist()] == [len((t or "").split()) for t in texts]
    assert max(sizes) <= 4 << 20 < sum(sizes)
    hashes = TokenHashes()
    assert hashes[b"x" * 5000] == hashes.of(b"x" * 5000) and hashes[b"short"] and list(hashes) == [b"short"]
