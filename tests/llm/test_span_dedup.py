import random
import re

from cadenza.llm.span_dedup import cut_text, remove_repeated_spans, split_sentences


def brute(rows, sentences=2, words=24, within=False):
    """The rule by a plain loop over all runs of pieces, documents in order."""
    docs, seen, drop = sorted(set(rows)), {}, {}
    for key, text in docs:
        pieces = split_sentences(text)
        full = [i for i, p in enumerate(pieces) if p.split()]
        norm = [" ".join(pieces[i].split()).lower() for i in full]
        gone = drop.setdefault((key, text), set())
        for a in range(len(full)):
            for b in range(a + sentences, len(full) + 1):
                if sum(len(x.split()) for x in norm[a:b]) >= words:
                    first = seen.setdefault(tuple(norm[a:b]), (key, text, a))
                    if first != (key, text, a) and (within or first[:2] != (key, text)):
                        gone |= set(range(full[a], full[b - 1] + 1))
                    break
    return {(k, t): "".join(p for i, p in enumerate(split_sentences(t)) if i not in gone) for (k, t), gone in drop.items()}


def words(rng, n, of=10**9):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def sentence(rng, of=10**9):
    """5 to 25 words with commas here and there, as prose has."""
    parts = [words(rng, rng.randint(2, 9), of) for _ in range(rng.choice([1, 1, 2, 3]))]
    return ", ".join(parts) + rng.choice([". ", "! ", ".\n", "? "])


def cleaned(spark, rows, **more):
    got = remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **more).collect()
    return {(r.doc_id, r.text): r for r in got}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    shared = ["".join(sentence(rng) for _ in range(rng.choice([1, 2, 3, 5, 9]))) for _ in range(8)]
    rows = []
    for i in range(250):
        text = "".join(sentence(rng) for _ in range(rng.randrange(12)))
        for s in rng.sample(shared, rng.choice([0, 0, 1, 2])):
            text = text + s + "".join(sentence(rng) for _ in range(rng.randrange(4))) + rng.choice(["", "", s])
        rows.append((i, text))
        if rng.random() < 0.1:
            rows.append((1000 + i, text.upper()))
    for within in (False, True):
        got = cleaned(spark, rows, within=within)
        assert {k: r.clean_text for k, r in got.items()} == brute(rows, within=within)
        assert sum(r.n_removed for r in got.values()) > 100
    assert brute(rows) != brute(rows, within=True)


def test_odd_rows(spark):
    long = "One two three four five six seven, eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen; eighteen nineteen twenty twenty-one two three four. "
    rows = [(1, None), (2, ""), (3, "..."), (4, long), (4, long), (None, long), (5, long + "And more."), (6, "It is. It is. " * 30), (7, "\n \n")]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], "doc_id long, text string, removed string, row int, spans int, own_id int, th int")
    out = remove_repeated_spans(df)
    assert out.columns == ["doc_id", "text", "row", "spans", "own_id", "th", "n_sentences", "n_removed", "removed", "clean_text"]
    got = sorted(((r.doc_id, r.clean_text, r.n_sentences, r.n_removed, r.removed) for r in out.collect()), key=str)
    want = [(1, None, 0, 0, ""), (2, "", 0, 0, ""), (3, "...", 1, 0, ""), (4, "", 4, 4, "0-3"), (4, "", 4, 4, "0-3"), (None, long, 4, 0, ""), (5, "And more.", 5, 4, "0-3"), (7, "\n \n", 1, 0, "")]
    assert [g for g in got if g[0] != 6] == sorted(want, key=str)
    assert {(r.row, r.spans, r.own_id, r.th) for r in out.collect()} == {(1, 2, 3, 4)}
    assert [g[1:2] + g[3:] for g in got if g[0] == 6] == [("It is. It is. " * 30, 0, "")]
    assert remove_repeated_spans(df.limit(0)).collect() == []


def test_pieces_give_the_text():
    for text in ("a.b. c\n\n d", "\n.x", "no end", "...", " a ! b?\t c", "word " * 100, "a b, " * 50, "你好。再见，朋友", "\n  ", "x " * 40 + "\n", " " * 30):
        assert "".join(split_sentences(text)) == text
    assert split_sentences("Ha!! Ha!! Ha!! He went home. He slept.") == ["Ha!! Ha!! Ha!! He went home. ", "He slept."]


def test_very_long_text(spark):
    rng = random.Random(5)
    passage = "".join(sentence(rng) for _ in range(6))
    long = "".join(sentence(rng) for _ in range(30_000))
    got = cleaned(spark, [(1, passage), (2, long + passage + "Its end is here."), (3, words(rng, 200_000))])
    kept = got[2, long + passage + "Its end is here."]
    assert kept.clean_text == long + "Its end is here." and kept.n_removed == len(split_sentences(passage))
    assert got[1, passage].n_removed == 0 and sum(r.n_removed for (i, _), r in got.items() if i == 3) == 0


def planted(rng, cut_inside):
    """Texts of which 120 hold passages of 51 to 90 words, three holders each, and 200 hold nothing that others have."""
    texts = ["".join(sentence(rng) for _ in range(rng.randint(4, 30))) for _ in range(320)]
    later, rows = {}, dict(enumerate(texts))
    for p in range(40):
        source = "".join(sentence(rng) for _ in range(16)).split()
        a, n = rng.randrange(20) if cut_inside else 0, rng.randint(51, 90)
        passage = " ".join(source[a : a + n])
        for i in range(3 * p, 3 * p + 3):
            own = rows[i].split()
            at = rng.randrange(len(own))
            rows[i] = " ".join([*own[:at], passage, *own[at:]])
            if i > 3 * p:
                later[i] = (n, len(rows[i].split()))
    return rows, later


def test_planted_passages_are_caught_and_clean_texts_left_alone(spark):
    rng = random.Random(6)
    refrain = "".join(sentence(rng) for _ in range(3))
    for cut_inside in (False, True):
        rows, later = planted(rng, cut_inside)
        rows[300] = refrain * 4 + rows[300]  # its own refrain, in no other text
        rows[301] += "Licensed under the terms of the agreement. All rights are reserved here. "  # a short line of many texts
        rows[302] += "Licensed under the terms of the agreement. All rights are reserved here. "
        got = {i: r for (i, _), r in cleaned(spark, list(rows.items())).items()}
        lost = {i: len(rows[i].split()) - len(got[i].clean_text.split()) for i in rows}
        assert sum(lost[i] >= 0.5 * n for i, (n, _) in later.items()) >= 0.95 * len(later)
        assert sum(got[i].n_removed > 0 for i in later) >= 0.98 * len(later)
        assert all(lost[i] <= n for i, (n, _) in later.items())
        assert all(lost[i] == 0 for i in rows if i not in later)


def test_passage_without_any_mark(spark):
    rng = random.Random(7)
    passages = [words(rng, 60) for _ in range(20)]
    rows = [(i, f"{words(rng, 20)} {passages[i % 20]} {words(rng, 20)}") for i in range(40)]
    got = {i: r.n_removed for (i, _), r in cleaned(spark, rows).items()}
    assert sum(got[i] > 0 for i in range(20, 40)) >= 18 and not any(got[i] for i in range(20))
    assert re.search("w", rows[0][1])


def han(rng, n, marks="，。"):
    """n characters with a mark after every 5 to 20 of them."""
    out = []
    while sum(map(len, out)) < n:
        out.append("".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(rng.randint(5, 20))) + (rng.choice(marks) if marks else ""))
    return "".join(out)


def test_scripts_without_spaces(spark):
    rng = random.Random(8)
    shared, plain, thai = han(rng, 600), han(rng, 600, ""), "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(600))
    rows = []
    for k, passage in enumerate((shared, plain, thai)):
        rows += [(10 * k + i, han(rng, 200) + passage + han(rng, 200)) for i in range(3)]
    rows += [(90 + i, han(rng, 900)) for i in range(4)] + [(95, "mixed 中文 words, and more 日本語 text here. " * 3)]
    got = {i: r for (i, _), r in cleaned(spark, rows).items()}
    text = dict(rows)
    for k, passage in enumerate((shared, plain, thai)):
        assert got[10 * k].clean_text == text[10 * k]
        for i in (1, 2):
            lost = len(text[10 * k + i]) - len(got[10 * k + i].clean_text)
            assert 0.85 * len(passage) <= lost <= len(passage)
    assert all(got[i].n_removed == 0 for i in got if i >= 90)


def test_words_of_mixed_scripts():
    ends, each = cut_text("ab 中文c, ด x")
    assert [w for words in each for w in words] == ["ab", "中", "文", "c,", "ด", "x"] and ends[-1] == len("ab 中文c, ด x")
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["中", "文", "ก", "a", "bc", " ", "\n", "。", "，", ". ", ", ", "\u3000", "é"]) for _ in range(rng.randrange(60)))
        assert "".join(split_sentences(text)) == text
        ends, each = cut_text(text)
        assert "".join("".join(w) for w in each) == "".join(text.split()) and len(ends) == len(each)


def test_null_ids_come_first(spark):
    rng = random.Random(10)
    passage = "".join(sentence(rng) for _ in range(6))
    got = cleaned(spark, [(1, passage + "Its own end."), (None, passage)])
    assert got[None, passage].n_removed == 0 and got[1, passage + "Its own end."].clean_text == "Its own end."
