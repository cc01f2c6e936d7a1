"""Queries of the survivorship operators, on values made from the parts and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import merge as M
from cadenza.plans.registry import query
from cadenza.plans.views import TRACKS_SQL, tables, tracks

NOW = 2024
WORDS = {"genre": ("SMALL", "LARGE", "PROMO"), "lang": ("en", "de"), "era": ("90s",), "mood": ("red", "hot"), "scene": ("ring", "bolt", "gear", "widget")}


def _current(spark, sf):
    return tables(spark, sf, "part").selectExpr("p_partkey as id", "'title' as field", "p_name as value", "case p_partkey % 3 when 0 then 'embed' when 1 then 'filename' else null end as source", "case when p_partkey % 3 = 1 then 0.4D else 0.8D end as confidence", "p_partkey % 13 = 0 as locked")


def _candidates(spark, sf):
    p = tables(spark, sf, "part")
    one = p.selectExpr("p_partkey as id", "'title' as field", "case when p_partkey % 5 = 0 then '-' else p_brand end as value", "case p_partkey % 4 when 0 then 'path' when 1 then 'online:netease' when 2 then 'llm' else 'manual' end as source", "(p_partkey % 10) / 10D as confidence", "0L as seq")
    two = p.where("p_partkey % 2 = 0").selectExpr("p_partkey as id", "'title' as field", "p_type as value", "'online:qq' as source", "0.65D as confidence", "1L as seq")
    return one.unionByName(two)


_PRIORITY = "case {0} when 'manual' then 100 when 'embed' then 50 when 'online:netease' then 30 when 'online:qq' then 28 when 'llm' then 22 when 'path' then 20 when 'filename' then 10 end"


def _apply(prev: str, n: int) -> str:
    """The CTE that applies the n-th candidate to the state of ``prev``."""
    ps, pc = _PRIORITY.format("s"), _PRIORITY.format("cs")
    return f"""s{n} as (select id, locked, case when o = 'accepted' then cv else v end as v, case when o = 'accepted' then cs else s end as s, case when o = 'accepted' then cc else c end as c, k + (coalesce(o, '') = 'accepted')::int as k from (
 select p.*, r.value as cv, r.source as cs, r.confidence as cc, case when r.id is null then null when locked then 'locked' when r.value = '-' then 'rejected' when s is not null and {ps} > {pc} and not (c < 0.7 and cc >= c + 0.2) then 'lower-priority' when cs = 'path' and s = 'embed' then 'lower-priority' else 'accepted' end as o
 from {prev} p left join ranked r on r.id = p.id and r.n = {n}))"""


@query(
    "m2_merge_fields",
    f"""with cands as (select p_partkey as id, case when p_partkey % 5 = 0 then '-' else p_brand end as value, case p_partkey % 4 when 0 then 'path' when 1 then 'online:netease' when 2 then 'llm' else 'manual' end as source, (p_partkey % 10) / 10::double as confidence, 0 as seq from part
 union all select p_partkey, p_type, 'online:qq', 0.65::double, 1 from part where p_partkey % 2 = 0), ranked as (select *, row_number() over (partition by id order by {_PRIORITY.format('source')} desc, seq) as n from cands),
 s0 as (select p_partkey as id, p_partkey % 13 = 0 as locked, p_name as v, case p_partkey % 3 when 0 then 'embed' when 1 then 'filename' end as s, case when p_partkey % 3 = 1 then 0.4::double else 0.8::double end as c, 0 as k from part), {_apply('s0', 1)}, {_apply('s1', 2)}
 select id, v as value, s as source, c as confidence, k as accepted from s2""",
)
def _m2(spark, sf):
    return M.merge_fields(_current(spark, sf), _candidates(spark, sf), NOW).select("id", "value", "source", "confidence", "accepted")


@query("f8_rejected_values", "select p_partkey as id, case when p_partkey % 4 = 0 then p_size * 60 not between 1900 and 2025 when p_partkey % 4 = 1 then p_type not in ('SMALL', 'LARGE', 'PROMO') when p_partkey % 4 = 2 then p_size % 2 = 0 else false end as rejected from part")
def _f8(spark, sf):
    df = tables(spark, sf, "part").selectExpr("p_partkey as id", "case p_partkey % 4 when 0 then 'year' when 1 then 'genre' when 2 then 'n' else 'title' end as field", "case p_partkey % 4 when 0 then cast(p_size * 60 as string) when 1 then p_type when 2 then cast(p_size % 2 as string) else p_name end as value")
    return df.select("id", M.rejected(F.col("field"), F.col("value"), NOW, WORDS).alias("rejected"))


@query("m5_online_candidates", "select p_partkey as id, unnest(['cleanTitle', 'cleanArtist', 'album', 'year']) as field, unnest([p_name, p_brand, p_type, (1975 + p_size)::varchar]) as value, 'online:netease' as source, unnest([sc, sc, sc, greatest(0, sc - 0.1)]) as confidence from (select *, (p_partkey % 100) / 100::double as sc from part)")
def _m5(spark, sf):
    best = tables(spark, sf, "part").selectExpr("p_partkey as id", "p_name as title", "p_brand as artist", "p_type as album", "1975 + p_size as year", "'netease' as source", "(p_partkey % 100) / 100D as score")
    return M.online_candidates(best).drop("seq")


@query("m3_cross_source_check", "with v as (select l_partkey as id, case when l_partkey % 3 = 0 then 'same' else l_returnflag end as value, l_discount as confidence from lineitem) select id, 'artist' as field, count(distinct value) = 1 as agree, case when count(distinct value) = 1 then least(1, round(max(confidence) + 0.15, 3)) else max(confidence) end as confidence, count(distinct value) > 1 as conflict from v group by id having count(*) >= 2")
def _m3(spark, sf):
    v = tables(spark, sf, "lineitem").selectExpr("l_partkey as id", "'artist' as field", "case when l_partkey % 3 = 0 then 'same' else l_returnflag end as value", "l_discount as confidence")
    return M.cross_source_check(v)


@query("m4_duration_boost", "select p_partkey as id, case when p_size % 9 = 0 then 0.0 when abs(p_size - p_partkey % 50) <= 15 then case when p_partkey % 50 = 0 then 0.0 else 0.05 end when p_partkey % 50 = 0 then 0.0 when abs(p_size - p_partkey % 50) <= 20 then 0.0 else -0.2 end::double as boost from part")
def _m4(spark, sf):
    df = tables(spark, sf, "part").selectExpr("p_partkey as id", "case when p_size % 9 = 0 then 0 else p_size end as a", "p_partkey % 50 as b")
    return df.select("id", M.duration_boost(F.col("a"), F.col("b")).alias("boost"))


_LABELS = "select p_partkey as id, p_type as genre, case when p_size % 2 = 0 then 'en' else 'xx' end as lang, '90s' as era, split_part(p_name, ' ', 1) as m, split_part(p_name, ' ', 2) as s, p_size as energy from part"


def _labels(spark, sf):
    df = tables(spark, sf, "part").selectExpr("p_partkey as id", "p_type as genre", "case when p_size % 2 = 0 then 'en' else 'xx' end as lang", "'90s' as era", "array(split_part(p_name, ' ', 1)) as mood", "array(split_part(p_name, ' ', 2)) as scene", "cast(p_size as string) as energy", "case when p_size % 4 = 0 then 'high' end as valence")
    return M.validate_labels(df, WORDS, "PROMO")


_VALID = f"""l as ({_LABELS}), v as (select *, case when genre in ('SMALL', 'LARGE', 'PROMO') then genre end as g, m in ('red', 'hot') as mo, s in ('ring', 'bolt', 'gear', 'widget') as so from l), o as (select *, mo or coalesce(g, 'PROMO') <> 'PROMO' as ok from v)"""


@query(
    "m6_validate_labels",
    f"""with {_VALID} select id, ok, case when ok then g end as genre, case when ok and lang = 'en' then lang end as lang, case when ok then era end as era, case when ok and mo then m else case when ok then '' end end as mood, case when ok and so then s else case when ok then '' end end as scene,
 case when ok then least(5, energy) end as energy, case when ok and energy % 4 = 0 then 3 end as valence, concat_ws(',', case when g is null then 'genre=' || genre end, case when lang = 'xx' then 'lang=xx' end, case when not mo then 'mood=' || m end, case when not so then 'scene=' || s end) as dropped from o""",
)
def _m6(spark, sf):
    return _labels(spark, sf).select("id", "ok", "genre", "lang", "era", F.array_join("mood", "|").alias("mood"), F.array_join("scene", "|").alias("scene"), "energy", "valence", F.array_join("dropped", ",").alias("dropped"))


@query("m7_label_candidates", f"with {_VALID} select id, field, value, 'llm' as source, case when id % 3 = 0 then 0.7 when id % 3 = 1 then 1.0 else 0.25 end::double as confidence from (select id, unnest(['genre', 'lang', 'era', 'mood', 'scene']) as field, unnest([g, case when lang = 'en' then lang end, era, case when mo then m end, case when so then s end]) as value from o where ok) where value is not null")
def _m7(spark, sf):
    return M.label_candidates(_labels(spark, sf).withColumn("confidence", F.expr("case id % 3 when 0 then 'abc' when 1 then '5' else '0.25' end"))).drop("seq")


@query("m7_turn_on_flags", "select 'tp_' || p_partkey as id, p_partkey % 40 = 0 or p_partkey % 3 = 0 as \"isAd\", case when p_partkey % 2 = 0 then 'vocab-v2' else 'old' end as \"modelVersion\" from part")
def _m7f(spark, sf):
    labels = tables(spark, sf, "part").where("p_partkey % 2 = 0 or p_partkey % 3 = 0").selectExpr("'tp_' || p_partkey as id", "p_partkey % 3 = 0 as isAd", "p_partkey % 2 = 0 as v")
    one = M.turn_on_flags(tracks(spark, sf).withColumn("modelVersion", F.lit("old")), labels.where("v"), ["isAd"])
    two = M.turn_on_flags(one, labels.where("not v"), ["isAd"], "old")
    return two.select("id", "isAd", "modelVersion")


@query("m8_fallback", "select p_partkey as id, case when p_partkey % 2 = 0 then '其他' else p_type end as genre, '其他' as lang, case when p_partkey % 3 = 0 then '90s' else '未知' end as era from part")
def _m8(spark, sf):
    return M.apply_fallback(tables(spark, sf, "part").selectExpr("p_partkey as id", "case when p_partkey % 2 = 0 then '' else p_type end as genre", "cast(null as string) as lang", "case when p_partkey % 3 = 0 then '90s' end as era"))


@query("m9_protect_existing", "select p_partkey as id, p_type as value from part where p_partkey % 3 = 2 and p_partkey % 2 = 0")
def _m9(spark, sf):
    cands = _candidates(spark, sf).where("seq = 1")
    return M.protect_existing(cands, _current(spark, sf)).select("id", "value")


@query("m10_edits", "select p_partkey as id, unnest(case when p_partkey % 4 = 0 then ['year', 'era'] else ['year'] end) as field, unnest(case when p_partkey % 4 = 0 then ['2001', '2000s'] else [(1975 + p_size)::varchar] end) as value, case when p_partkey % 4 = 0 then 'manual' else 'embed' end as source, unnest(case when p_partkey % 4 = 0 then [true, false] else [false] end) as locked from part")
def _m10(spark, sf):
    p = tables(spark, sf, "part")
    current = p.selectExpr("p_partkey as id", "'year' as field", "cast(1975 + p_size as string) as value", "'embed' as source", "0.9D as confidence", "false as locked")
    patches = p.where("p_partkey % 4 = 0").selectExpr("p_partkey as id", "explode(map('year', '2001', 'filePath', 'x')) as (field, value)")
    return M.apply_edits(current, M.allowed_edits(patches, ["year", "era", "filePath"])).drop("confidence")


@query("f7_allowed_edits", "select p_partkey as id, 'genre' as field, p_type as value from part")
def _f7(spark, sf):
    patches = tables(spark, sf, "part").selectExpr("p_partkey as id", "explode(map('genre', p_type, 'fileName', 'x', 'nonsense', 'y')) as (field, value)")
    return M.allowed_edits(patches, ["genre", "fileName"])


@query("m11_unlock", "select p_partkey as id, case when p_partkey % 2 = 0 then 'mood' else '' end as locked from part")
def _m11(spark, sf):
    df = tables(spark, sf, "part").selectExpr("p_partkey as id", "case when p_partkey % 2 = 0 then array('genre', 'mood') else array('genre') end as lockedFields")
    return M.unlock(df, ["genre", "era"]).select("id", F.array_join("lockedFields", ",").alias("locked"))


@query("m13_backfill_era", f"with {TRACKS_SQL} select id, case when partkey % 2 = 0 then era else '90s' end as era from tracks")
def _m13(spark, sf):
    return M.backfill_era(tracks(spark, sf).withColumn("era", F.expr("case when partkey % 2 = 0 then '' else '90s' end")).withColumn("era", F.expr("case when partkey % 2 = 0 and year = 0 then '未知' else era end"))).select("id", "era")


@query("m15_cover_dedup", "select 'cv_' || substr(sha1(html), 1, 12) as \"coverId\", count(*) as owners, max(octet_length(encode(html)))::int as bytes from pages where octet_length(encode(html)) >= 512 and sha1(html) not in (select sha1(html) from pages where page_id % 50 = 0) group by html")
def _m15(spark, sf):
    pages = tables(spark, sf, "pages").select(F.col("page_id").alias("owner"), F.col("html").cast("binary").alias("content"), "page_id")
    return M.dedup_covers(pages, pages.where("page_id % 50 = 0").select(F.sha1("content").alias("hash")))


@query("m16_refresh_lyrics", "select 'tp_' || p_partkey as id, case when p_partkey % 4 = 0 then 'la la la la la' when p_partkey % 3 = 0 then 'new words' end as lyrics from part")
def _m16(spark, sf):
    return M.refresh_text(tracks(spark, sf), tables(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("'tp_' || p_partkey as id", "'new words' as lyrics"), "lyrics").select("id", "lyrics")


@query("f6_stale_labels", "select 'tp_' || p_partkey as id from part where p_partkey % 3 <> 0 and p_partkey % 5 <> 0 order by 1 limit 500")
def _f6(spark, sf):
    locks = "case when p_partkey % 5 = 0 then array('genre', 'mood', 'scene', 'lang', 'era') else array('genre') end as lockedFields"
    return M.stale_labels(tables(spark, sf, "part").selectExpr("'tp_' || p_partkey as id", "case when p_partkey % 3 = 0 then 'm1 vocab-v2' else 'm1 vocab-v1' end as modelVersion", locks), limit=500).select("id")


@query("j16_unknown_words", "select p_partkey as id, 'genre' as dim, p_type as value from part where p_type not in (select p_type from part where p_partkey < 3)")
def _j16(spark, sf):
    p = tables(spark, sf, "part").selectExpr("p_partkey as id", "'genre' as dim", "p_type as value")
    return M.unknown_words(p, p.where("id < 3")).select("id", "dim", "value")


@query("m17_rerun_labels", f"with {_VALID}, n as (select id, case when ok and id % 7 <> 0 then g end as g from o) select id, coalesce(g, 'old') as value, case when g is null then 'path' else 'llm' end as source, case when g is null then 0.6 else 0.9 end::double as confidence from n")
def _m17(spark, sf):
    labels = M.label_candidates(_labels(spark, sf).withColumn("confidence", F.lit("0.9"))).where("field = 'genre'")
    current = tables(spark, sf, "part").selectExpr("p_partkey as id", "'genre' as field", "'old' as value", "'path' as source", "0.6D as confidence", "p_partkey % 7 = 0 as locked")
    return M.merge_fields(current, labels, NOW, WORDS).select("id", "value", "source", "confidence")


@query("m2_widen", "select p_partkey as id, p_name as title, p_type as genre, 'a' as genre_source from part")
def _m2w(spark, sf):
    p = tables(spark, sf, "part").selectExpr("p_partkey as id", "explode(map('title', p_name, 'genre', p_type)) as (field, value)").withColumns({"source": F.lit("a"), "confidence": F.lit(0.5)})
    return M.widen(p, ["title", "genre"]).select("id", "title", "genre", F.element_at("sourceMap", "genre").alias("genre_source"))
