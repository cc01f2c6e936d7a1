import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions import values as V


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("out")).first()["out"]


def many(spark, function, cases):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, s string").select("i", "s", function(F.col("s")).alias("out")).collect()
    for r in rows:
        assert r.out == cases[r.i][1], (r.s, r.out, cases[r.i][1])


def test_mojibake(spark):
    broken = [("½­ÖÇÃñ", "江智民"), ("ÂÉ¶¯³µÔØÒôÀÖ", "律动车载音乐"), ("Í«ÀÖ-Ê°Èþ", "瞳乐-拾叁"), ("ÖÐ¡¾3D»·ÈÆ¡¿I Need a Good One", "中【3D环绕】I Need a Good One")]
    broken += [(bytes.fromhex(h).decode("latin-1"), t) for h, t in (("d6dcbddcc2d7", "周杰伦"), ("c7e7ccec", "晴天"), ("c1d6bfa1bddc", "林俊杰"))]
    whole = ["Mötley Crüe", "Björk Guðmundsdóttir", "Håkon Øvreås", "Plácido Domingo", "Céline Dion", "Motörhead", "Þórðurinn", "Ágætis byrjun", "Björn Þórðarson", "Hjördís Guðrúnardóttir", "Ærø Øst", "Qing Tian", "晴天", "", None]
    many(spark, X.repair_mojibake, broken + [(s, s) for s in whole])
    many(spark, X.is_garbled, [(s, True) for s, _ in broken] + [(s, False) for s in whole])


def test_cleaning(spark):
    many(spark, X.strip_track_number, [("03 成都", "成都"), ("7 Years", "7 Years"), ("06 - 偏爱", "偏爱"), ("35.x", "x"), (None, "")])
    many(spark, X.strip_leading_groups, [("【双声道】Love Yourself", "Love Yourself"), ("[a](b) c", "c"), ("", "")])
    many(spark, X.strip_trailing_groups, [("吉祥飞舞 (DJ阿圣Remix 2018)", "吉祥飞舞"), ("a (b) [c]", "a")])
    many(spark, X.is_promo, [("群星 - 如果没有你", False), ("加群领歌", True), ("see www.x", True), (None, False)])
    many(spark, X.is_unknown, [(" [Unknown Artist] ", True), ("", True), (None, True), ("Air", False)])
    many(spark, X.is_pseudo_artist, [("Cydian", True), ("N/A", True), ("Air", False)])
    many(spark, X.has_separator, [("a-b", True), ("-b", False), ("a - ", False), ("a·b", True), ("ab", False)])
    many(spark, X.normalize, [("Ｈｅｌｌｏ【X】, World!", "hello x world"), (None, "")])
    many(spark, X.squeeze, [("A b-C", "abc")])
    many(spark, X.cjk_count, [("ab成都", 2), (None, 0)])
    many(spark, X.loose_name, [("A b（live）C", "abc")])
    many(spark, X.file_title, [("漂洋过海来看你 - 刘明湘.flac", "漂洋过海来看你"), ("x.mp3", "x")])
    many(spark, X.sanitize_lyrics, [("<script>x</script>a<b>c</b>\r\nd ", "ac\nd")])
    many(spark, X.has_timeline, [("[0:12]x", True), ("x", False)])


def test_titles(spark):
    many(spark, lambda c: X.split_title(c)["titles"], [("Mojito-周杰伦", ["Mojito", "周杰伦", "Mojito-周杰伦"]), ("06 - 偏爱", ["偏爱", "06 - 偏爱"]), ("plain", ["plain"])])
    many(spark, lambda c: X.split_title(c)["artists"], [("Mojito-周杰伦", ["周杰伦"]), ("06 - 偏爱", []), ("plain", [])])
    many(spark, lambda c: X.split_title(c, F.lit("周杰伦"))["titles"], [("周杰伦 - Mojito", ["Mojito", "周杰伦 - Mojito"])])
    got = one(spark, X.title_queries(F.lit("【双声道】Love Yourself"), F.lit("Justin")))
    assert [(r.strategy, r.q) for r in got] == [("S1", "Love Yourself"), ("S2", "Love Yourself Justin"), ("S3", "双声道 Love Yourself"), ("S3", "双声道 Love Yourself Justin")]


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", 1.0), ("abc", "", 0.0), ("abcd", "abxd", 0.75), ("ab", "abcd", 0.875), ("周杰伦", "周杰", 0.75 + 0.25 * 2 / 3)])
def test_title_similarity(spark, a, b, want):
    assert one(spark, X.title_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_artists(spark):
    assert one(spark, X.artist_similarity(F.lit("A/B feat. Clara"), F.lit("clara & Z"))) == 1.0
    assert one(spark, X.artist_similarity(F.lit(""), F.lit("x"))) == 0.0
    assert [one(spark, X.compare_artists(F.lit(a), F.lit(b))) for a, b in (("A-b", "ab"), ("刘明湘", "刘明香"), ("a", "b"))] == ["same", "variant", "different"]
    assert [one(spark, X.artist_verdict(F.lit(a), F.lit(b))) for a, b in (("A", "a"), ("Ann Lee", "Ann"), ("x", "y"), ("", "y"))] == ["exact", "near", "none", "none"]
    assert one(spark, X.audit_similarity(F.lit("abcd"), F.lit("abxd"))) == 0.75
    assert one(spark, X.char_jaccard(F.lit("aab"), F.lit("abb"))) == 0.5


def test_values(spark):
    years = spark.createDataFrame([(1989,), (1990,), (2005,), (2019,), (2020,), (0,)], "y int").select(V.year_to_era(F.col("y")).alias("e")).collect()
    assert [r.e for r in years] == ["80s及更早", "90s", "2000s", "2010s", "2020s", "未知"]
    many(spark, V.djb2, [("唱游", "64d3ce"), ("王菲", "68d322")])
    many(spark, V.normalize_status, [("Waiting", "waiting"), ("下载完成", "success"), ("FAILED", "error"), ("Downloading", "downloading"), (None, "waiting"), ("?", "waiting")])
    many(spark, V.to_millis, [("1700000000", 1700000000000), ("1700000000123", 1700000000123), ("2024-01-01", 1704067200000), ("x", 0), (None, 0), ("9" * 25, 0)])
    many(spark, V.mask_account, [("abcdef", "ab****f"), ("ab", "a*"), ("", ""), (None, "")])
    assert one(spark, V.best_encoding(F.array(*map(F.lit, ("KW_MP3_320", "KW_FLAC_2000", "KW_MP3_2000"))))) == "KW_FLAC_2000"
    assert [one(spark, V.progress(F.lit(p), F.lit(s))) for p, s in (("7", "success"), ("150", "running"), ("x", "running"), (None, "waiting"))] == [100.0, 99.0, 0.0, 0.0]
    verdicts = [(200, '{"code":200}', "ok"), (200, '{"code":503}', "businessError"), (200, '{"error":"x"}', "businessError"), (500, "{}", "httpError"), (200, "<html>", "parseError")]
    for status, body, want in verdicts:
        assert one(spark, V.response_verdict(F.lit(status), F.lit(body))) == want
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    assert tuple(one(spark, V.sniff_image(F.col("b")), b=bytearray(png))) == ("image/png", 640, 480)


def test_accents_in_pairs_are_no_broken_encoding(spark):
    whole = ["Outionch ouoneux éçon, ééon.", "Éçon ééon", "onéé onéé", "crééon, suppléé"]
    many(spark, X.repair_mojibake, [(s, s) for s in whole] + [("ÇçÌìlive", "晴天live")])
    many(spark, X.is_garbled, [(s, False) for s in whole] + [("ÇçÌìlive", True)])


def test_words_of_accents_alone_are_no_broken_encoding(spark):
    whole = ["reelle reelle çê, çê, çê.", "au èè èè èè", "Çê çê. Çê", "éèçê éèçê"]
    broken = [("ÖÐ ¹ú", "中 国"), ("Áõçæ", "刘珂")]
    many(spark, X.repair_mojibake, [(s, s) for s in whole] + broken)
    many(spark, X.is_garbled, [(s, False) for s in whole] + [(s, True) for s, _ in broken])
