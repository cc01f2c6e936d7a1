"""Queries of the text and value functions, over documents, pages, conversations, parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions import values as V
from cadenza.plans.registry import query
from cadenza.plans.views import TASKS_SQL, tables, tasks
from cadenza.sources import ingest, sinks
from cadenza.sources.shared import dealt


def _docs(spark, sf):
    return tables(spark, sf, "documents")


#: Names in the right encoding, and as they look when their GB18030 bytes are read as Latin-1.
_FIXED = ("江智民", "律动车载音乐")
_BROKEN = tuple(x.encode("gb18030").decode("latin-1") for x in _FIXED)
_MIXED = f"case doc_id % 5 when 0 then '{_BROKEN[0]}' when 1 then '{_BROKEN[1]}' when 2 then 'Björk Guðmundsdóttir' when 3 then '晴天' else text end"
_REPAIRED = f"case doc_id % 5 when 0 then '{_FIXED[0]}' when 1 then '{_FIXED[1]}' when 2 then 'Björk Guðmundsdóttir' when 3 then '晴天' else text end"
_PROMO = "公众号关注".encode("gb18030").decode("latin-1")


def _mixed(spark, sf):
    """Texts of documents, in four of five rows names in right and broken encodings."""
    return _docs(spark, sf).selectExpr("doc_id", f"{_MIXED} as text")


def _titles(spark, sf):
    """Titles of several shapes, made from the parts."""
    shape = "case p_partkey % 6 when 0 then p_name || '-' || p_brand when 1 then '0' || (p_partkey % 9) || ' - ' || p_name when 2 then '[HD] ' || p_name when 3 then p_name || ' (live ' || p_size || ')' when 4 then p_name || '_' || p_type else p_name end"
    return tables(spark, sf, "part").selectExpr("p_partkey as id", f"{shape} as title", "p_brand as artist")


_TITLES = "titles as (select p_partkey as id, case p_partkey % 6 when 0 then p_name || '-' || p_brand when 1 then '0' || (p_partkey % 9) || ' - ' || p_name when 2 then '[HD] ' || p_name when 3 then p_name || ' (live ' || p_size || ')' when 4 then p_name || '_' || p_type else p_name end as title, p_brand as artist from part)"


@query("p1_cjk_count", f"select doc_id, case doc_id % 5 when 3 then 2 else 0 end as n, doc_id % 5 = 3 as has from documents")
def _p1(spark, sf):
    return _mixed(spark, sf).select("doc_id", X.cjk_count(F.col("text")).alias("n"), X.has_cjk(F.col("text")).alias("has"))


@query("p2_garbled_flag", "select doc_id, doc_id % 5 in (0, 1) as garbled from documents")
def _p2(spark, sf):
    return _mixed(spark, sf).select("doc_id", X.is_garbled(F.col("text")).alias("garbled"))


@query("p3_mojibake_repair", f"select doc_id, {_REPAIRED} as repaired from documents")
def _p3(spark, sf):
    return _mixed(spark, sf).select("doc_id", X.repair_mojibake(F.col("text")).alias("repaired"))


_NORMAL = "trim(regexp_replace(regexp_replace(lower({0}), '[\\[\\]()<>]', ' ', 'g'), '[^a-z0-9\\pL\\pN]+', ' ', 'g'))"


@query("p4_normalize", f"select doc_id, {_NORMAL.format('text')} as key from (select doc_id, {_REPAIRED} as text from documents)")
def _p4(spark, sf):
    return _mixed(spark, sf).select("doc_id", X.normalize(F.col("text")).alias("key"))


@query("p5_squeeze", f"select doc_id, md5(replace({_NORMAL.format('text')}, ' ', '')) as key from (select doc_id, {_REPAIRED} as text from documents)")
def _p5(spark, sf):
    return _mixed(spark, sf).select("doc_id", F.md5(X.squeeze(F.col("text"), False)).alias("key"))


@query("p6_promo_flag", "select page_id, case page_id % 4 when 0 then true when 1 then false else contains(html, 'http') or contains(html, 'www.') or contains(html, 'vx') or contains(html, 'VX') end as promo from pages")
def _p6(spark, sf):
    pages = tables(spark, sf, "pages").selectExpr("page_id", f"case page_id % 4 when 0 then '{_PROMO}' when 1 then 'a plain name' else html end as html")
    return pages.select("page_id", X.is_promo(F.col("html")).alias("promo"))


@query("p7_unknown_flag", "select p_partkey as id, p_partkey % 4 in (0, 1) as unknown from part")
def _p7(spark, sf):
    v = F.expr("case p_partkey % 4 when 0 then ' Unknown Artist' when 1 then '' else p_brand end")
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.is_unknown(v).alias("unknown"))


@query("p8_pseudo_flag", "select p_partkey as id, p_partkey % 4 = 0 as s, p_size % 2 = 0 as n from part")
def _p8(spark, sf):
    p = tables(spark, sf, "part").selectExpr("p_partkey as id", "case when p_partkey % 4 = 0 then ' N/A ' else p_brand end as s", "p_size % 2 as n")
    return p.select("id", X.is_pseudo(F.col("s")).alias("s"), X.is_pseudo(F.col("n"), "number").alias("n"))


@query("p9_pseudo_artist", "select p_partkey as id, p_partkey % 3 < 2 as pseudo from part")
def _p9(spark, sf):
    v = F.expr("case p_partkey % 3 when 0 then 'Various Artists' when 1 then '群星' else p_brand end")
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.is_pseudo_artist(v).alias("pseudo"))


@query("p10_placeholder_album", "select p_partkey as id, p_partkey % 3 = 0 as placeholder from part")
def _p10(spark, sf):
    v = F.expr("case p_partkey % 3 when 0 then 'MUSIC' else p_type end")
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.is_placeholder_album(v).alias("placeholder"))


@query("p11_separator_flag", f"with {_TITLES} select id, id % 6 in (0, 1, 4) as sep from titles")
def _p11(spark, sf):
    return _titles(spark, sf).select("id", X.has_separator(F.col("title")).alias("sep"))


@query("p12_strip_track_number", f"with {_TITLES} select id, trim(regexp_replace(title, '^\\s*[0-9]{{1,3}}\\s*[._-]\\s*', '')) as title from titles")
def _p12(spark, sf):
    return _titles(spark, sf).select("id", X.strip_track_number(F.col("title")).alias("title"))


@query("p13_strip_brackets", "select doc_id, trim(regexp_replace(regexp_replace(text, '[\\[\\]()<>]', ' ', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) as t from documents")
def _p13(spark, sf):
    return _docs(spark, sf).select("doc_id", X.strip_brackets(F.col("text")).alias("t"))


@query("p14_strip_leading_groups", f"with {_TITLES} select id, trim(regexp_replace(title, '^(\\[[^\\]]*\\]\\s*){{1,6}}', '')) as title from titles")
def _p14(spark, sf):
    return _titles(spark, sf).select("id", X.strip_leading_groups(F.col("title")).alias("title"))


@query("p15_strip_trailing_groups", f"with {_TITLES} select id, trim(regexp_replace(title, '(\\s*[\\[(][^\\])]*[\\])]){{1,6}}\\s*$', '')) as title from titles")
def _p15(spark, sf):
    return _titles(spark, sf).select("id", X.strip_trailing_groups(F.col("title")).alias("title"))


@query("p16_split_title", f"with {_TITLES} select id, case id % 6 when 0 then split_part(title, '-', 1) when 1 then substr(title, 6) when 2 then trim(replace(replace(title, '[', ''), ']', '')) when 3 then trim(replace(replace(title, '(', ''), ')', '')) when 4 then split_part(title, '_', 1) else title end as first, case id % 6 when 0 then split_part(title, '-', 2) when 4 then split_part(title, '_', 2) end as artist from titles")
def _p16(spark, sf):
    s = X.split_title(F.col("title"))
    return _titles(spark, sf).select("id", F.get(s["titles"], 0).alias("first"), F.get(s["artists"], 0).alias("artist"))


@query("p17_query_forms", f"with {_TITLES} select id, case id % 6 when 0 then split_part(title, '-', 1) when 1 then substr(title, 6) when 2 then trim(replace(title, '[HD]', '')) when 3 then replace(replace(title, '(', ''), ')', '') when 4 then split_part(title, '_', 1) else title end as s1, case id % 6 when 0 then split_part(title, '-', 1) when 1 then substr(title, 6) when 2 then trim(replace(title, '[HD]', '')) when 3 then replace(replace(title, '(', ''), ')', '') when 4 then split_part(title, '_', 1) else title end || ' ' || artist as s2 from titles")
def _p17(spark, sf):
    q = X.title_queries(F.col("title"), F.col("artist"))
    return _titles(spark, sf).select("id", F.get(q, 0)["q"].alias("s1"), F.get(q, 1)["q"].alias("s2"))


@query("p18_edit_distance", "select a.p_partkey as id, levenshtein(a.p_name, b.p_name)::int as d from part a join part b on b.p_partkey = a.p_partkey + 1")
def _p18(spark, sf):
    p = tables(spark, sf, "part")
    return p.join(p.selectExpr("p_partkey - 1 as p_partkey", "p_name as other"), "p_partkey").select(F.col("p_partkey").alias("id"), F.levenshtein("p_name", "other").alias("d"))


def _neighbours(spark, sf):
    p = tables(spark, sf, "part").selectExpr("p_partkey as id", "replace(p_name, ' ', '') as a")
    return p.join(p.selectExpr("id - 1 as id", "case when id % 3 = 0 then substr(a, 1, 4) else a end as b"), "id")


@query("p19_title_similarity", "with n as (select a.p_partkey as id, replace(a.p_name, ' ', '') as a, case when b.p_partkey % 3 = 0 then substr(replace(b.p_name, ' ', ''), 1, 4) else replace(b.p_name, ' ', '') end as b from part a join part b on b.p_partkey = a.p_partkey + 1), d as (select *, 1 - levenshtein(a, b)::double / greatest(length(a), length(b)) as r from n) select id, round(case when a = b then 1 when contains(a, b) or contains(b, a) then greatest(r, 0.75 + 0.25 * (least(length(a), length(b))::double / greatest(length(a), length(b)))) else r end, 9) as s from d")
def _p19(spark, sf):
    return _neighbours(spark, sf).select("id", F.round(X.title_similarity(F.col("a"), F.col("b")), 9).alias("s"))


@query("p20_artist_similarity", "select p_partkey as id, case when p_partkey % 2 = 0 then 1.0 else 0.0 end::double as s from part")
def _p20(spark, sf):
    p = tables(spark, sf, "part").selectExpr("p_partkey as id", "p_name || ' feat. ' || p_brand as a", "case when p_partkey % 2 = 0 then p_brand || ' & zzz' else '12345' end as b")
    s = X.artist_similarity(F.col("a"), F.col("b"))
    return dealt(p).select("id", F.when(s < 0.5, 0.0).otherwise(s).alias("s"))


_NEIGHBOURS_SQL = "n as (select a.p_partkey as id, replace(a.p_name, ' ', '') as a, case when b.p_partkey % 3 = 0 then substr(replace(b.p_name, ' ', ''), 1, 4) else replace(b.p_name, ' ', '') end as b from part a join part b on b.p_partkey = a.p_partkey + 1)"


def audit_sql(pairs: str) -> str:
    """CTEs, for ``with recursive``, that end in audited (id, s): the second opinion on the texts a and b of the CTE ``pairs``.

    lcs holds the last row of the table of common subsequences, one character of a further in each step; no text is empty.
    """
    times = "len(list_filter(string_split({0}, ''), lambda d: d = c))"
    return f"""lcs as (select id, a, b, 0 as i, list_transform(range(length(b) + 1), lambda j: 0) as l from {pairs}
 union all select id, a, b, i + 1, [0] || list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(l[k + 1], l[k] + (substr(a, i + 1, 1) = substr(b, k, 1))::int)))) from lcs where i < length(a)),
ends as (select id, a, b, l[-1] as common, list_sum(list_transform(list_distinct(string_split(a, '')), lambda c: least({times.format('a')}, {times.format('b')}))) as shared, least(length(a), length(b)) as shorter, greatest(length(a), length(b)) as longer from lcs where i = length(a)),
audited as (select id, case when a = b then 1.0 else greatest(common::double / longer, shared::double / (length(a) + length(b) - shared), case when contains(a, b) or contains(b, a) then 0.72::double + 0.28::double * (shorter::double / longer) else 0 end) end::double as s from ends)"""


@query("p21_audit_similarity", f"with recursive {_NEIGHBOURS_SQL}, {audit_sql('n')} select id, round(s, 9) as s from audited")
def _p21(spark, sf):
    return _neighbours(spark, sf).select("id", F.round(X.audit_similarity(F.col("a"), F.col("b")), 9).alias("s"))


@query("p22_artist_verdict", "select p_partkey as id, case p_partkey % 3 when 0 then 'exact' when 1 then 'near' else 'none' end as v from part")
def _p22(spark, sf):
    b = F.expr("case p_partkey % 3 when 0 then lower(p_brand) when 1 then p_brand || ' band' else 'zzzz' end")
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.artist_verdict(F.col("p_brand"), b).alias("v"))


@query("p24_fold_script", "select doc_id, translate(text, 'äöü', 'aou') as t from documents")
def _p24(spark, sf):
    return _docs(spark, sf).select("doc_id", X.fold_script(F.col("text"), "äöü", "aou").alias("t"))


@query("p25_loose_name", f"with {_TITLES} select id, regexp_replace(regexp_replace(lower(title), '\\s+', '', 'g'), '[(][^)]*[)]', '', 'g') as n from titles")
def _p25(spark, sf):
    return _titles(spark, sf).select("id", X.loose_name(F.col("title")).alias("n"))


@query("p26_file_title", "select p_partkey as id, p_name as t, p_name || ' - ' || p_brand as core from part")
def _p26(spark, sf):
    f = F.expr("p_name || ' - ' || p_brand || '.flac'")
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.file_title(f).alias("t"), X.file_core(f).alias("core"))


@query("p27_title_segments", "select p_partkey as id, case when length(p_name) <= 14 then p_name end as head, case when length(p_name) <= 14 then p_brand end as tail from part")
def _p27(spark, sf):
    s = X.title_segments(F.expr("p_name || ' - ' || p_brand"))
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), s["head"].alias("head"), s["tail"].alias("tail"))


@query("p28_path_inference", "select p_partkey as id, p_brand as artist, p_type as album from part")
def _p28(spark, sf):
    s = X.infer_from_path(F.expr("p_brand || '/' || p_type || '/' || p_name || '.mp3'"), F.lit(2))
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), s["artist"].alias("artist"), s["album"].alias("album"))


@query("p29_split_path", "with p as (select page_id, list_filter(string_split(url, '/'), lambda x: x <> '') as a from pages) select page_id, a[-3] as artist_dir, a[-2] as album_dir, a[-1] as file from p")
def _p29(spark, sf):
    s = X.split_path(F.col("url"))
    return tables(spark, sf, "pages").select("page_id", s["artistDir"].alias("artist_dir"), s["albumDir"].alias("album_dir"), s["fileName"].alias("file"))


@query("p30_same_label", f"with {_TITLES} select id, id % 6 = 5 as same from titles")
def _p30(spark, sf):
    t = _titles(spark, sf).join(tables(spark, sf, "part").selectExpr("p_partkey as id", "upper(p_name) as other"), "id")
    return t.select("id", X.same_label(F.col("title"), F.col("other")).alias("same"))


@query("p31_content_flags", f"with {_TITLES} select id, regexp_matches(title || ' ' || artist, '(?i)live') as \"isLive\", regexp_matches(title || ' ' || artist, '(?i)remix|dj') as \"isRemix\", false as \"isInstrumental\", false as \"isCover\" from titles")
def _p31(spark, sf):
    return _titles(spark, sf).select("id", *(c.alias(n) for n, c in X.content_flags(F.col("title"), F.col("artist")).items()))


@query("p32_era", "select o_orderkey as id, case when extract(year from o_orderdate) < 2000 then '90s' else '2000s' end as era from orders")
def _p32(spark, sf):
    return tables(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), V.year_to_era(F.year("o_orderdate")).alias("era"))


@query("p33_valid_year", "select p_partkey as id, p_size * 60 between 1900 and 2025 as ok from part")
def _p33(spark, sf):
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), V.valid_year(F.col("p_size") * 60, 2024).alias("ok"))


@query("p34_sanitize", "select page_id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '<[^>]+>', '', 'g'), chr(13) || chr(10), chr(10))[:51200], '^\\s+', ''), '\\s+$', '') as t from pages")
def _p34(spark, sf):
    return tables(spark, sf, "pages").select("page_id", X.sanitize_lyrics(F.col("html")).alias("t"))


@query("p35_timeline_flag", "select conv_id, turn, regexp_matches(text, '\\[[0-9]{1,2}:[0-9]{2}') as timed from conversations")
def _p35(spark, sf):
    return tables(spark, sf, "conversations").select("conv_id", "turn", X.has_timeline(F.col("text")).alias("timed"))


@query("p36_stable_ids", "select page_id, 'tp_' || substr(sha1(url), 1, 12) as id from pages")
def _p36(spark, sf):
    return tables(spark, sf, "pages").select("page_id", V.stable_id(F.col("url"), "tp_").alias("id"))


@query("p37_djb2", "with recursive h(s, i, v) as (select p_brand, 0, 5381::bigint from (select distinct p_brand from part) union all select s, i + 1, (v * 33 + unicode(substr(s, i + 1, 1))) % 4294967296 from h where i < length(s)) select s as name, lower(ltrim(to_hex(v), '0')) as id from h where i = length(s)")
def _p37(spark, sf):
    return tables(spark, sf, "part").select("p_brand").distinct().select(F.col("p_brand").alias("name"), V.djb2(F.col("p_brand")).alias("id"))


@query("p38_status", f"with {TASKS_SQL} select id, case status when 'finished' then 'success' when 'queue' then 'waiting' else 'running' end as status from tasks")
def _p38(spark, sf):
    return tasks(spark, sf).select("id", V.public_status(V.normalize_status(F.col("status"))).alias("status"))


@query("p39_best_encoding", "select p_partkey as id, case when p_size * 40 between 100 and 1999 and p_size * 40 > 320 then 'KW_FLAC_' || (p_size * 40) when p_size * 40 = 320 then 'KW_FLAC_320' when p_size * 40 > 1999 then 'KW_FLAC_' || (p_size * 40) else 'KW_MP3_320' end as best from part")
def _p39(spark, sf):
    names = F.expr("array('KW_MP3_320', 'KW_FLAC_' || (p_size * 40), 'KW_MP3_128')")
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), V.best_encoding(names).alias("best"))


@query("p40_millis", "select o_orderkey as id, epoch_ms(o_orderdate) as a, epoch_ms(o_orderdate) as b from orders")
def _p40(spark, sf):
    o = tables(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), V.to_millis(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("a"), V.to_millis(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("b"))


@query("p41_estimates", f"with {TASKS_SQL}, x as (select id, status, e - s as el, floor(kbps * 1000 / 8 * seconds + 0.5)::bigint as b from tasks) select id, el as elapsed, b as bytes, case when status = 'finished' and el > 0 then floor(b::double / el + 0.5)::bigint else 0 end as speed from x")
def _p41(spark, sf):
    t = tasks(spark, sf).withColumns({"elapsed": V.elapsed_seconds(F.col("startedAt"), F.col("updatedAt")), "bytes": V.estimated_bytes(F.col("kbps"), F.col("seconds"))})
    done = (V.normalize_status(F.col("status")) == "success") & (F.col("elapsed") > 0)
    return t.select("id", "elapsed", "bytes", F.when(done, F.floor(F.col("bytes") / F.col("elapsed") + 0.5)).otherwise(F.lit(0)).cast("long").alias("speed"))


@query("p42_progress", f"with {TASKS_SQL} select id, case when status = 'finished' then 100 else least(99, greatest(0, progress)) end::double as progress from tasks")
def _p42(spark, sf):
    return tasks(spark, sf).select("id", V.progress(F.col("progress"), V.normalize_status(F.col("status"))).alias("progress"))


@query("p44_masked", "select c_custkey as id, substr(c_name, 1, 2) || '****' || substr(c_name, -1) as name from customer")
def _p44(spark, sf):
    return tables(spark, sf, "customer").select(F.col("c_custkey").alias("id"), V.mask_account(F.col("c_name")).alias("name"))


@query("p45_verdict", "select event_id as id, case when event_id % 7 = 0 then 'parseError' when cast(json_extract_string(props, '$.k') as int) % 2 = 1 then 'businessError' when event_type = 'error' then 'httpError' else 'ok' end as verdict from events")
def _p45(spark, sf):
    e = tables(spark, sf, "events").selectExpr("event_id as id", "case when event_type = 'error' then 503 else 200 end as status", "case when event_id % 7 = 0 then '<html>' when cast(get_json_object(props, '$.k') as int) % 2 = 1 then '{\"code\": 460}' else '{\"code\": 200}' end as body")
    return e.select("id", V.response_verdict(F.col("status"), F.col("body")).alias("verdict"))


@query("p46_busy_flag", "select event_id as id, event_type = 'error' or event_id % 5 = 0 as busy from events")
def _p46(spark, sf):
    e = tables(spark, sf, "events").selectExpr("event_id as id", "case when event_type = 'error' then 503 else 200 end as status", "case when event_id % 5 = 0 then 'Server BUSY' else '' end as msg")
    return e.select("id", V.is_busy(F.col("status"), F.col("msg")).alias("busy"))


@query("p47_real_cover", "select p_partkey as id, p_partkey % 2 = 0 as real from part")
def _p47(spark, sf):
    return tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), V.is_real_cover(F.expr("case when p_partkey % 2 = 0 then 'al-' || p_size when p_partkey % 3 = 0 then 'mf-1' end")).alias("real"))


@query("p49_lyrics_view", "select p_partkey as id, p_partkey % 2 = 0 as available, case when p_partkey % 2 = 0 then p_name else '' end as lyrics from part")
def _p49(spark, sf):
    p = tables(spark, sf, "part").selectExpr("p_partkey as id", "case when p_partkey % 2 = 0 then p_name end as l")
    return p.select("id", F.col("l").isNotNull().alias("available"), F.coalesce("l", F.lit("")).alias("lyrics"))


@query("p50_formats", "select p_partkey as id, case p_partkey % 3 when 0 then 'FLAC' when 1 then 'M4A' else 'UNKNOWN' end as format, case p_partkey % 3 when 0 then 'audio/flac' when 1 then 'audio/mp4' else '' end as media from part")
def _p50(spark, sf):
    p = tables(spark, sf, "part").selectExpr("p_partkey as id", "case p_partkey % 3 when 0 then 'FLAC' when 1 then 'm4b' else 'txt' end as e")
    return p.select("id", V.format_of(F.col("e")).alias("format"), V.media_type_of(F.col("e")).alias("media"))


@query("p51_sized_links", "select page_id, case when contains(split_part(url, '/', 3), 'example.com') then split_part(url, '?', 1) || '?param=300y300' else url end as link from pages")
def _p51(spark, sf):
    return tables(spark, sf, "pages").select("page_id", V.sized_link(F.col("url"), 300, ["example.com"]).alias("link"))


@query("p52_query_text", f"with {_TITLES} select id, 'recording:\"' || regexp_replace(title, '([+&|!(){{}}\\[\\]^\"~*?:\\\\/-])', '\\\\\\1', 'g') || '\" AND artist:\"' || artist || '\"' as q from titles")
def _p52(spark, sf):
    return _titles(spark, sf).select("id", X.structured_query(F.col("title"), F.col("artist")).alias("q"))


@query("s2_ignored_paths", "select page_id, url from pages where not list_contains(string_split(url, '/'), 'en')")
def _s2(spark, sf):
    return ingest.skip_ignored(tables(spark, sf, "pages"), ["en"], "url").select("page_id", "url")


@query("s1_inventory_columns", "select p_brand || '/' || p_name || '.MP3' as \"filePath\", p_name || '.MP3' as \"fileName\", 'mp3' as \"fileExt\", 1 as \"dirDepth\" from part where p_partkey % 2 = 0")
def _s1(spark, sf):
    return ingest.inventory_columns(tables(spark, sf, "part").selectExpr("p_brand || '/' || p_name || case when p_partkey % 2 = 0 then '.MP3' else '.txt' end as filePath"))


@query("s5_candidates_a", "select p_partkey as id, p_partkey::varchar as cand_id, p_name as title, p_brand || '/' || p_type as artist_text, p_size as duration_sec from part")
def _s5(spark, sf):
    body = F.expr("case when p_partkey % 2 = 0 then to_json(named_struct('id', p_partkey, 'name', p_name, 'ar', array(named_struct('name', p_brand), named_struct('name', p_type)), 'dt', p_size * 1000 + 300)) else to_json(named_struct('id', p_partkey, 'name', p_name, 'artists', array(named_struct('name', p_brand), named_struct('name', p_type)), 'duration', p_size * 1000)) end")
    return ingest.candidates_a(tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), body.alias("body"))).select("id", "cand_id", "title", "artist_text", "duration_sec")


@query("s6_candidates_b", "select p_partkey as id, p_name as title, p_brand as artist_text, 1950 + p_size as year from part")
def _s6(spark, sf):
    body = F.expr("to_json(named_struct('id', p_partkey, 'title', p_name, 'artist-credit', array(named_struct('name', p_brand)), 'first-release-date', (1950 + p_size) || '-05-01'))")
    return ingest.candidates_b(tables(spark, sf, "part").select(F.col("p_partkey").alias("id"), body.alias("body"))).select("id", "title", "artist_text", "year")


@query("s7_search_results", "select p_partkey::varchar as id, p_name as name, 2 as artists from part where p_partkey % 3 <> 0")
def _s7(spark, sf):
    body = F.expr("case p_partkey % 3 when 0 then '{\"id\": 5}' else to_json(named_struct('songId', p_partkey, 'title', p_name, 'singer', p_brand || '、' || p_type)) end")
    return ingest.search_results(tables(spark, sf, "part").select(body.alias("body"))).select("id", "name", F.size("artists").alias("artists"))


@query("s8_task_records", "select o_orderkey::varchar as id, o_orderstatus as status, case when o_custkey > 600 then round(o_custkey / 1000)::int else o_custkey::int end as seconds from orders")
def _s8(spark, sf):
    body = F.to_json(F.struct(F.col("o_orderkey").alias("taskId"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("duration")))
    return ingest.task_records(tables(spark, sf, "orders").select(body.alias("body"))).select("id", "status", F.col("durationSec").alias("seconds"))


@query("s9_unwrap", "select o_custkey as id, count(*) as n from orders group by 1")
def _s9(spark, sf):
    o = tables(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey")).alias("rows"))
    body = F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.struct("rows"))).otherwise(F.to_json("rows"))
    return ingest.unwrap(o.select(F.col("o_custkey").alias("id"), body.alias("body")), ["list", "rows"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("s10_labels", "select p_partkey as id, p_type as genre from part where p_partkey % 3 <> 0")
def _s10(spark, sf):
    one = F.expr("to_json(array(named_struct('id', p_partkey, 'genre', p_type)))")
    body = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), one, F.lit("\n```"))).when(F.col("p_partkey") % 3 == 2, F.concat(one, F.lit(" done"))).otherwise(F.lit("sorry"))
    labels, _ = ingest.read_labels(tables(spark, sf, "part").select(body.alias("body")))
    return labels.select(F.col("id").cast("long").alias("id"), "genre")


@query(
    "s11_label_batches",
    """with r as (select *, substr(md5(p_partkey::varchar), 1, 3) as part from part), n as (select *, row_number() over (partition by part order by p_partkey) - 1 as k from r)
 select part || '-' || (k // 8) as batch, '[' || string_agg('{"id":' || p_partkey || ',"title":"' || p_name || '","artist":"' || p_brand || '","album":"' || p_type || '","year":' || p_size || '}', ',' order by p_partkey) || ']' as payload, count(*) as rows from n group by 1""",
)
def _s11(spark, sf):
    t = tables(spark, sf, "part").selectExpr("p_partkey as id", "p_name as title", "p_brand as artist", "p_type as album", "p_size as year")
    return ingest.label_batches(t)


@query("s12_legacy_lines", "select 'l' || p_partkey as legacy_id, p_brand || ',' || p_name as file_path from part")
def _s12(spark, sf):
    return ingest.legacy_ids(tables(spark, sf, "part").selectExpr("'\"l' || p_partkey || '\",\"' || p_brand || ',' || p_name || '\"' as value"))


@query("s15_csv_lines", "select '\"' || p_partkey || '\",\"' || p_name || ' \"\"x\"\"\",\"' || p_brand || ' ' || p_type || '\"' as line from part")
def _s15(spark, sf):
    t = tables(spark, sf, "part").selectExpr("p_partkey as id", "p_name || ' \"x\"' as title", "array(p_brand, p_type) as mood")
    return sinks.csv_lines(t, ["id", "title", "mood"])


@query("s18_markdown_lines", "select '| ' || p_type || ' | ' || count(*) || ' |' as line from part group by p_type")
def _s18(spark, sf):
    return sinks.markdown_lines(tables(spark, sf, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), ["p_type", "n"])
