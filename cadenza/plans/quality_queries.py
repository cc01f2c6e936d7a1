"""Queries of the quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.functions import values as V
from cadenza.operators import link as L
from cadenza.operators import quality as Q
from cadenza.operators import sketches as K
from cadenza.plans.link_queries import POOLED_SQL, SCORED_SQL, WHOLE_POOLED_SQL, _candidates, _local, _pooled, _pooled_short, _scored
from cadenza.plans.registry import query
from cadenza.plans.text_queries import audit_sql
from cadenza.plans.views import ATTEMPTS_SQL, TASKS_SQL, TRACKS_SQL, attempts, tables, tasks, tracks
from cadenza.sources.shared import written

_NAMES = "['miss', 'weak', 'likely', 'exact']"
_BEST_SQL = f"{SCORED_SQL}, best as (select *, {_NAMES}[st + 1] as tier, {_NAMES}[rt + 1] as rtier, case when track_id % 3 = 0 then 'A' when track_id % 3 = 1 then 'B' else 'C' end as layer from scored qualify row_number() over (partition by track_id, source order by st desc, ss desc, rt desc, rs desc, seq) = 1)"


def _best(spark, sf):
    best = L.best_candidate(_scored(spark, sf), "track_id", "source")
    layer = F.expr("case track_id % 3 when 0 then 'A' when 1 then 'B' else 'C' end")
    return best.select("*", F.col("strict.tier").alias("tier"), F.col("relaxed.tier").alias("rtier"), layer.alias("layer"))


def _rates(flags: dict[str, str], source: str, by: str = "") -> str:
    """SQL of a rate table."""
    parts = [f"select {by + ', ' if by else ''}'{k}' as metric, count(*) filter (where {v}) as n, count(*) as \"of\" from {source} {'group by ' + by if by else ''}" for k, v in flags.items()]
    return "select *, round(100.0 * n / greatest(1, \"of\"), 1)::double as percent from (" + " union all ".join(parts) + ")"


@query(
    "a11_depth_report",
    """with p as (select list_filter(string_split(url, '/'), lambda x: x <> '') as parts from pages), g as (select len(parts) - 1 as depth, count(*) as files, count(distinct parts[1]) as top_dirs, count(*) filter (where len(parts) >= 3 and length(parts[2]) <= 60) as inferred from p group by 1)
 select *, round(100.0 * files / sum(files) over (), 1)::double as percent from g""",
)
def _a11(spark, sf):
    return Q.depth_report(tables(spark, sf, "pages").selectExpr("url as path"))


@query("a13_status_counts", f"with {TASKS_SQL} select count(*) filter (where status = 'queue') as waiting, count(*) filter (where status = 'finished') as success, 0::bigint as error, count(*) filter (where status = 'downloading') as downloading from tasks")
def _a13(spark, sf):
    return Q.status_counts(tasks(spark, sf).withColumn("status", V.normalize_status(F.col("status"))), ("waiting", "success", "error", "downloading"))


@query("a16_availability", "with t as (select length(text) > 0 as title, lang is not null as lang, n_chars > 500 as long from documents) " + _rates({"title": "title", "lang": "lang", "long": "long"}, "t"))
def _a16(spark, sf):
    d = tables(spark, sf, "documents")
    return Q.rate_table(d, {"title": F.char_length("text") > 0, "lang": F.col("lang").isNotNull(), "long": F.col("n_chars") > 500})


#: Tags of files, a part of them in a broken encoding, promotional, stand-ins or missing.
_BROKEN = "江智民".encode("gb18030").decode("latin-1")
_TAGS = {
    "title": f"case p_partkey % 5 when 0 then '{_BROKEN}' when 1 then '加群 ' || p_partkey when 2 then p_name || ' - ' || p_brand else p_name end",
    "artist": f"case p_partkey % 7 when 0 then '{_BROKEN}' when 1 then '未知' when 2 then '加群' else p_brand end",
    "album": f"case p_partkey % 4 when 0 then '{_BROKEN}' when 1 then '' else p_type end",
    "path": f"case p_partkey % 9 when 0 then '{_BROKEN}' else p_brand end || '/' || p_name",
    "cover": "case when p_partkey % 3 = 0 then 'tr-' else 'al-' end || p_partkey",
    "seconds": "case when p_size < 6 then 0 else p_size end",
}


def _tags(spark, sf):
    return tables(spark, sf, "part").selectExpr("p_partkey as id", *(f"{v} as {k}" for k, v in _TAGS.items()))


@query(
    "a16_before_and_after",
    """select unnest([{'metric': 'title', 'before': count(*) filter (where p_partkey % 5 not in (0, 1)), 'after': count(*) filter (where p_partkey % 5 <> 1), 'rescued': count(*) filter (where p_partkey % 5 = 0)},
 {'metric': 'artist', 'before': count(*) filter (where p_partkey % 7 > 2), 'after': count(*) filter (where p_partkey % 7 not in (1, 2)), 'rescued': count(*) filter (where p_partkey % 7 = 0)},
 {'metric': 'album', 'before': count(*) filter (where p_partkey % 4 > 1), 'after': count(*) filter (where p_partkey % 4 <> 1), 'rescued': count(*) filter (where p_partkey % 4 = 0)}], recursive := true) from part""",
)
def _a16b(spark, sf):
    return Q.rescued_by_repair(_tags(spark, sf), ("title", "artist", "album"))


_DIRT = {
    "garbled_any": "p_partkey % 5 = 0 or p_partkey % 7 = 0 or p_partkey % 4 = 0 or p_partkey % 9 = 0", "garbled_title": "p_partkey % 5 = 0", "garbled_artist": "p_partkey % 7 = 0", "garbled_album": "p_partkey % 4 = 0", "garbled_path": "p_partkey % 9 = 0",
    "promo_any": "p_partkey % 5 = 1 or p_partkey % 7 = 2", "promo_title": "p_partkey % 5 = 1", "promo_artist": "p_partkey % 7 = 2", "promo_album": "false", "title_has_separator": "p_partkey % 5 = 2",
    "artist_unknown": "p_partkey % 7 = 1", "album_unknown": "p_partkey % 4 = 1", "cover_placeholder": "p_partkey % 3 = 0", "no_duration": "p_size < 6",
}


@query("a17_dirtiness", _rates(_DIRT, "part"))
def _a17(spark, sf):
    return Q.rate_table(_tags(spark, sf), Q.dirt_flags(*map(F.col, ("title", "artist", "album", "path", "cover", "seconds"))))


@query("a18_agreement", f"with {TRACKS_SQL} select 'artist' as metric, count(*) filter (where cleanArtist is not null and cleanArtist = artist and partkey % 4 <> 0) as n, count(cleanArtist) as \"of\", round(100.0 * count(*) filter (where cleanArtist is not null and cleanArtist = artist and partkey % 4 <> 0) / count(cleanArtist), 1)::double as percent from tracks")
def _a18(spark, sf):
    other = F.when(F.col("partkey") % 4 == 0, F.lit("x")).otherwise(F.col("artist"))
    return Q.rate_table(tracks(spark, sf), {"artist": F.coalesce(F.col("cleanArtist") == other, F.lit(False))}, where={"artist": F.col("cleanArtist").isNotNull()})


@query("a19_top_values", "select p_name as value, count(*) as n from part group by 1 order by n desc, value limit 10")
def _a19(spark, sf):
    return Q.top_values(tables(spark, sf, "part"), "p_name", 10)


@query("a19_distinct_counts", "select unnest([{'column': 'p_name', 'n': count(distinct p_name)}, {'column': 'p_brand', 'n': count(distinct p_brand)}], recursive := true) from part")
def _a19d(spark, sf):
    return Q.distinct_counts(tables(spark, sf, "part"), ["p_name", "p_brand"])


@query("a20_tier_histogram", f"with {_BEST_SQL} select layer, source, count(*) filter (where tier = 'exact') as exact, count(*) filter (where tier = 'likely') as likely, count(*) filter (where tier = 'weak') as weak, count(*) filter (where tier = 'miss') as miss, count(*) as total from best group by rollup (layer, source)")
def _a20(spark, sf):
    return Q.tier_histogram(_best(spark, sf), ["layer", "source"])


_HITS = {"strict": "tier in ('exact', 'likely')", "relaxed": "rtier in ('exact', 'likely')", "either": "tier in ('exact', 'likely') or rtier in ('exact', 'likely')"}


def _hit_flags():
    s, r = Q.is_hit(F.col("tier")), Q.is_hit(F.col("rtier"))
    return {"strict": s, "relaxed": r, "either": s | r}


@query("a21_hit_rates", f"with {_BEST_SQL} " + _rates(_HITS, "best", "source"))
def _a21(spark, sf):
    return Q.rate_table(_best(spark, sf), _hit_flags(), by=["source"])


@query("a22_field_delivery", f"with {_BEST_SQL}, h as (select * from best where tier in ('exact', 'likely')) " + _rates({"artist": "c_artist <> ''", "duration": "\"durDiff\" <= 15"}, "(select h.*, c.c_artist from h join cand c using (c_cand_id))"))
def _a22(spark, sf):
    return Q.rate_table(_best(spark, sf).where(Q.is_hit(F.col("tier"))), {"artist": F.col("c_artist") != "", "duration": F.coalesce(F.col("durDiff") <= 15, F.lit(False))})


@query(
    "a23_strategy_comparison",
    f"""with {WHOLE_POOLED_SQL}, q as (select track_id, query_no, strategy, max(st) as st from pooled group by all)
 select strategy, count(*) as issued, count(distinct track_id) as tracks, count(*) filter (where st >= 2) as hits, round(100.0 * count(*) filter (where st >= 2) / count(*), 1)::double as percent from q group by 1""",
)
def _a23(spark, sf):
    return Q.strategy_comparison(L.best_candidate(_pooled(spark, sf), "track_id", "query_no", "strategy"), "track_id")


_WEIGHTED = """sizes as (select case when p_partkey % 3 = 0 then 'A' when p_partkey % 3 = 1 then 'B' else 'C' end as layer, count(*) * case when p_partkey % 3 = 0 then 3 else 1 end as size from part group by p_partkey % 3)"""


def _sizes(spark, sf):
    layer = F.expr("case p_partkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end").alias("layer")
    return tables(spark, sf, "part").groupBy(layer).agg((F.count(F.lit(1)) * F.when(F.col("layer") == "A", 3).otherwise(1)).alias("size"))


@query("a24_weighted_rates", f"with {_BEST_SQL}, {_WEIGHTED}, r as (" + _rates(_HITS, "best", "layer") + ") select metric, round(sum(size * n::double / \"of\") / sum(size) * 100, 1)::double as rate from r join sizes using (layer) group by 1")
def _a24(spark, sf):
    return Q.weighted_rate(Q.layer_rates(_best(spark, sf), _hit_flags()), _sizes(spark, sf))


_TRUST = {"non_empty": "c_artist <> ''", "corroborated": "c_artist <> '' and not conflict", "auto_writable": "tier = 'exact' and not conflict", "overwrite_safe": "tier = 'exact' and not conflict and \"durDiff\" <= 15"}


@query("a25_trust_tiers", f"with {_BEST_SQL}, b as (select best.*, c.c_artist from best join cand c using (c_cand_id)) " + _rates(_TRUST, "b", "layer"))
def _a25(spark, sf):
    named, exact = F.col("c_artist") != "", F.col("tier") == "exact"
    flags = {"non_empty": named, "corroborated": named & ~F.col("conflict"), "auto_writable": exact & ~F.col("conflict"), "overwrite_safe": exact & ~F.col("conflict") & F.coalesce(F.col("durDiff") <= 15, F.lit(False))}
    return Q.rate_table(_best(spark, sf), flags, by=["layer"])


@query("a26_hit_breakdown", f"with {_BEST_SQL} select case when conflict then 'duration' when artistSim < 0.5 then 'artist' else 'corroborated' end as reason, count(*) as n from best where tier in ('exact', 'likely') group by 1")
def _a26(spark, sf):
    return Q.first_reason(_best(spark, sf).where(Q.is_hit(F.col("tier"))), [("duration", F.col("conflict")), ("artist", F.col("artistSim") < 0.5)], "corroborated")


_PAIRS = f"{_BEST_SQL}, n as (select track_id, tier in ('exact', 'likely') as a from best where source = 'netease'), m as (select track_id, tier in ('exact', 'likely') as b from best where source = 'musicbrainz'), pairs as (select coalesce(a, false) as a, coalesce(b, false) as b from n full join m using (track_id))"


def _pairs(spark, sf):
    best = _best(spark, sf).select("track_id", "source", "tier", F.col("c_artist").alias("artist"))
    return L.by_source(best, "track_id", "netease", "musicbrainz")


@query("a27_source_overlap", f"with {_PAIRS} " + _rates({"both": "a and b", "only_first": "a and not b", "only_second": "b and not a", "neither": "not a and not b", "either": "a or b"}, "pairs"))
def _a27(spark, sf):
    p = _pairs(spark, sf).select(Q.is_hit(F.col("netease_tier")).alias("a"), Q.is_hit(F.col("musicbrainz_tier")).alias("b"))
    return Q.source_overlap(p, "a", "b")


@query("a28_artist_disagreement", f"with {_BEST_SQL}, b as (select best.*, c.c_artist from best join cand c using (c_cand_id)), n as (select track_id, c_artist as x from b where source = 'netease'), m as (select track_id, c_artist as y from b where source = 'musicbrainz') select case when x <> '' and x = y then 'same' else 'different' end as verdict, count(*) as n from n join m using (track_id) group by 1")
def _a28(spark, sf):
    p = _pairs(spark, sf).where("netease_artist is not null and musicbrainz_artist is not null")
    return p.groupBy(X.compare_artists(F.col("netease_artist"), F.col("musicbrainz_artist")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("a29_duration_buckets", f"with {_BEST_SQL}, b as (select case when durDiff <= 5 then '0-5' when durDiff <= 15 then '6-15' when durDiff <= 20 then '16-20' when durDiff <= 30 then '21-30' else '>30' end as bucket, count(*) as n from best group by 1) select *, round(100.0 * n / sum(n) over (), 1)::double as percent from b")
def _a29(spark, sf):
    return Q.duration_buckets(_best(spark, sf))


#: The best of all candidates of each track and source, misses too.
_ALL_SQL = _BEST_SQL.replace(" where not conflict and (s >= 0.65 or r >= 0.8)", "")


@query("a30_miss_attribution", f"with {_ALL_SQL} select case when conflict then 'duration conflict' when titleSim < 0.5 then 'title' when artistSim = 0 then 'no artist' else 'other' end as reason, count(*) as n from best where tier not in ('exact', 'likely') group by 1")
def _a30(spark, sf):
    missed = L.best_without_hit(_local(spark, sf), _candidates(spark, sf), _scored(spark, sf))
    return Q.first_reason(missed, [("duration conflict", F.col("conflict")), ("title", F.col("titleSim") < 0.5), ("no artist", F.col("artistSim") == 0)])


@query("a31_pseudo_entities", "select p_brand as name, count(*) as n, regexp_matches(p_brand, '#1') as marked, round(100.0 * count(*) / (select count(*) from part), 3)::double as percent from part group by 1 having count(*) >= 80")
def _a31(spark, sf):
    return Q.pseudo_entities(tables(spark, sf, "part"), "p_brand", "#1", 80)


@query("a32_swapped_fields", "select p_partkey from part where length(split_part(p_name, ' ', 1)) <= 4 and length(p_brand) >= 8")
def _a32(spark, sf):
    t = tables(spark, sf, "part").withColumn("t", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return Q.swapped_suspects(t, "t", "p_brand").where(F.char_length("p_brand") >= 8).select("p_partkey")


_REPLIES = {"status": "case when code >= 90 then 503 when code >= 80 then 429 else 200 end", "transport": "case when idx % 3 = 0 then 'proxy' else 'direct' end", "endpoint": "case when code % 2 = 0 then 'search' else 'lyrics' end"}


@query(
    "a33_source_health",
    f"""with {ATTEMPTS_SQL}, r as (select *, {", ".join(f"{v} as {k}" for k, v in _REPLIES.items())}, case when not ok then 'not ok' when n_found = 0 then 'empty' else 'found' end as outcome from attempts),
 d as ({" union all ".join(f"select source, '{k}' as dimension, {k}::varchar as value, count(*) as n from r group by all" for k in ("outcome", "code", *_REPLIES))})
 select *, round(100.0 * n / sum(n) over (partition by source, dimension), 1)::double as percent from d""",
)
def _a33(spark, sf):
    return Q.source_health(attempts(spark, sf).selectExpr("*", *(f"{v} as {k}" for k, v in _REPLIES.items())))


@query("a34_segments", f"with {ATTEMPTS_SQL} select (idx // 20)::bigint as segment, round(avg(elapsed), 6) as mean, max(elapsed) as max, round(100.0 * count(*) filter (where n_found = 0) / count(*), 1)::double as zero_percent, round(100.0 * count(*) filter (where ok) / count(*), 1)::double as ok_percent from attempts group by 1")
def _a34(spark, sf):
    return Q.segments(attempts(spark, sf))


@query("a35_latency_summary", f"with {ATTEMPTS_SQL}, r as (select *, row_number() over (partition by source order by elapsed, idx) as r, count(*) over (partition by source) as c from attempts), g as (select source, round(avg(elapsed), 6) as mean, round(count(*) / count(distinct q), 3)::double as requests_each, max(elapsed) filter (where r = c // 2 + 1) as upper_median from r group by 1) select *, round(mean * 2903 / 60000 / 1, 6) as minutes_1, round(mean * 2903 / 60000 / 2, 6) as minutes_2, round(mean * 2903 / 60000 / 4, 6) as minutes_4, round(mean * 2903 / 60000 / 8, 6) as minutes_8 from g")
def _a35(spark, sf):
    return Q.latency_summary(attempts(spark, sf), "source", 2903)


@query("a36_pool_sizes", f"with {POOLED_SQL}, s as (select track_id, count(distinct c_cand_id) as n from pooled group by 1) select round(avg(n), 3) as mean, max(n) as largest, count(*) filter (where n > 12) as cut, count(*) as pools from s")
def _a36(spark, sf):
    return Q.truncation(_pooled_short(spark, sf).select("track_id", "c_cand_id").distinct(), "track_id", 12)


@query("a37_profile_union", f"with {_BEST_SQL}, t as (select track_id, layer, bool_or(tier in ('exact', 'likely') or rtier in ('exact', 'likely')) as u from best group by all) " + _rates({"union": "u"}, "t", "layer"))
def _a37(spark, sf):
    flags = _hit_flags()
    t = _best(spark, sf).groupBy("track_id", "layer").agg(F.bool_or(flags["either"]).alias("u"))
    return Q.rate_table(t, {"union": F.col("u")}, by=["layer"])


@query("a38_profile_differences", f"with {_BEST_SQL} select source, track_id, c_cand_id, tier, rtier, ss as strict_score, rs as relaxed_score from best where (tier in ('exact', 'likely')) <> (rtier in ('exact', 'likely'))")
def _a38(spark, sf):
    flags = _hit_flags()
    return _best(spark, sf).where(flags["strict"] != flags["relaxed"]).select("source", "track_id", "c_cand_id", "tier", "rtier", F.col("strict.score").alias("strict_score"), F.col("relaxed.score").alias("relaxed_score"))


_HIT_PAIRS = "hits as (select track_id || ' ' || best.source as id, title_key as a, c_title_key as b from best join local using (track_id) join cand using (c_cand_id) where tier in ('exact', 'likely'))"


@query(
    "a39_second_opinion",
    f"""with recursive {_BEST_SQL}, {_HIT_PAIRS}, {audit_sql('hits')}, j as (select best.source, titleSim, round(s, 3) as second from best join audited on audited.id = track_id || ' ' || best.source)
 select source, case when second >= 0.85 then 'A' when second >= 0.7 then 'B' else 'C' end as verdict, count(*) as n, round(max(abs(second - titleSim)), 3)::double as largest_gap from j group by all""",
)
def _a39(spark, sf):
    b = _best(spark, sf).where(Q.is_hit(F.col("tier"))).withColumn("second", F.round(X.audit_similarity(F.col("title_key"), F.col("c_title_key")), 3))
    verdict = F.when(F.col("second") >= 0.85, "A").when(F.col("second") >= 0.7, "B").otherwise("C")
    return b.groupBy("source", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("second") - F.col("titleSim"))), 3).alias("largest_gap"))


_SEGMENTS = "case when p_partkey % 3 = 0 then split_part(p_name, ' ', 1) else p_name || ' ' || p_partkey end"


@query(
    "a40_write_safety",
    f"""with {_BEST_SQL}, seg as (select p_partkey as track_id, split_part(p_name, ' ', 1) as segment, {_SEGMENTS} as name from part), often as (select name from seg group by 1 having count(*) >= 4),
 amb as (select track_id, segment in (select name from often) as ambiguous from seg)
 select case when tier not in ('exact', 'likely') then 'none' when tier = 'exact' and not ambiguous then 'overwrite' when track_id % 2 = 1 and not ambiguous then 'fill' when track_id % 2 = 1 then 'fill-review' else 'keep' end as bucket, count(*) as n from best join amb using (track_id) group by 1""",
)
def _a40(spark, sf):
    names = tables(spark, sf, "part").selectExpr("p_partkey as track_id", "split_part(p_name, ' ', 1) as segment", f"{_SEGMENTS} as name")
    ambiguous = Q.ambiguous_titles(names, "segment", "name").select("track_id", F.lit(True).alias("ambiguous"))
    best = _best(spark, sf).join(ambiguous, "track_id", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))
    return Q.write_safety(best, Q.is_hit(F.col("tier")), F.col("tier") == "exact", F.col("ambiguous"), F.col("track_id") % 2 == 0)


@query("a41_label_quality", "with j as (select quality, toxic, n_chars from labels join documents using (doc_id)) " + _rates({"parsed": "quality is not null", "good": "quality = 1", "toxic": "toxic = 1", "short": "n_chars < 200"}, "j"))
def _a41(spark, sf):
    j = tables(spark, sf, "labels").join(tables(spark, sf, "documents"), "doc_id")
    return Q.rate_table(j, {"parsed": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "short": F.col("n_chars") < 200})


@query("a43_prefix_histogram", "select case when p_partkey % 9 = 0 then '' else split_part(lower(p_type), 'e', 1) end as prefix, count(*) as n from part group by 1")
def _a43(spark, sf):
    return Q.prefix_histogram(tables(spark, sf, "part").selectExpr("case when p_partkey % 9 = 0 then '' else lower(p_type) end as c"), "c", "e")


@query(
    "a44_match_audit",
    f"""with {_BEST_SQL} select case when tier in ('exact', 'likely') then 'hit' when rtier in ('exact', 'likely') then 'relaxed only' when tier = 'weak' then 'near miss' else 'miss' end as list,
 source, track_id, c_cand_id, titleSim as "titleSim", artistSim as "artistSim", durDiff as "durDiff", conflict, ss as strict_score, rs as relaxed_score from best""",
)
def _a44(spark, sf):
    flags = _hit_flags()
    name = F.when(flags["strict"], "hit").when(flags["relaxed"], "relaxed only").when(F.col("tier") == "weak", "near miss").otherwise("miss")
    scores = (F.col("strict.score").alias("strict_score"), F.col("relaxed.score").alias("relaxed_score"))
    return _best(spark, sf).select(name.alias("list"), "source", "track_id", "c_cand_id", "titleSim", "artistSim", "durDiff", "conflict", *scores)


_COVERED = {"artist": "cleanArtist is not null", "album": "album <> ''", "genre": "genre is not null", "year": "year > 0", "lyrics": "lyrics is not null", "cover": "coverId <> ''"}


@query(
    "a12_run_report",
    f"""with {TRACKS_SQL}, {ATTEMPTS_SQL}, t as (select count(*) as rows, {", ".join(f"round(100.0 * count(*) filter (where {v}) / count(*), 1) as {k}" for k, v in _COVERED.items())},
 {", ".join(f"count(*) filter (where qualityLevel = '{q}') as q_{q}" for q in ("high", "medium", "low"))} from tracks),
 r as (select max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) as ms, count(*) as done from attempts)
 select unnest([{{'metric': 'population', 'value': rows::double}}, {{'metric': 'processed', 'value': done::double}}, {", ".join(f"{{'metric': 'coverage_{k}', 'value': {k}::double}}" for k in _COVERED)},
 {", ".join(f"{{'metric': 'quality_{q}', 'value': q_{q}::double}}" for q in ("high", "medium", "low"))},
 {{'metric': 'elapsed_ms', 'value': ms::double}}, {{'metric': 'ms_per_row', 'value': round(ms::double / done, 3)}}, {{'metric': 'estimate_ms', 'value': round(ms::double / done * rows)}}], recursive := true) from t, r""",
)
def _a12(spark, sf):
    log = attempts(spark, sf).select(F.unix_millis(F.col("ts").cast("timestamp")).alias("started_at"), F.unix_millis(F.col("ts").cast("timestamp")).alias("finished_at"), F.lit(1).alias("done"))
    return Q.run_report(tracks(spark, sf), {k: F.expr(v) for k, v in _COVERED.items()}, log)


@query(
    "a19_stored_sketches",
    f"""with {ATTEMPTS_SQL} select source, count(*) as rows, true as distinct_near, true as median_near, true as p90_near from attempts group by 1""",
)
def _a19s(spark, sf):
    """Sketches of each day, stored and merged, against the exact figures: whether they keep to their error bounds."""
    rows = attempts(spark, sf)
    parts = written(K.build_sketches(rows, F.to_date("ts"), ("q",), ("elapsed",), ("source",)), "sketches")
    merged = K.merge_sketches(parts, ("source",))
    rank = lambda c, s: F.abs(F.count_if(F.col("elapsed") <= F.col(c)) / F.count(F.lit(1)) - s) <= K.RANK_ERROR + 1 / F.count(F.lit(1))
    both = rows.join(merged.drop("rows"), "source").groupBy("source")
    return both.agg(F.count(F.lit(1)).alias("rows"), K.distinct_is_within(F.first("distinct_q"), F.count_distinct("q")).alias("distinct_near"), rank("elapsed_p50", 0.5).alias("median_near"), rank("elapsed_p90", 0.9).alias("p90_near"))


@query("o10_ambiguous_titles", "with t as (select p_partkey as id, split_part(p_name, ' ', 1) as segment, split_part(p_name, ' ', 2) as name from part), f as (select name, count(*) as times from (select id, case when id % 3 = 0 then segment else name end as name from t) group by 1 having count(*) >= 4) select id, segment, times from t join f on segment = f.name")
def _o10(spark, sf):
    t = tables(spark, sf, "part").selectExpr("p_partkey as id", "split_part(p_name, ' ', 1) as segment", "case when p_partkey % 3 = 0 then split_part(p_name, ' ', 1) else split_part(p_name, ' ', 2) end as name")
    return Q.ambiguous_titles(t, "segment", "name").select("id", "segment", "times")


@query("w10_run_progress", "with s as (select epoch(date_trunc('hour', ts))::bigint as second, count(*) as n from events group by 1), w as (select second, sum(n) over (order by second)::bigint as done, round(sum(n) over (order by second) / (second - min(second) over () + 1), 6)::double as rate from s) select second, done, round(100.0 * done / 20000, 1)::double as percent, rate, case when rate > 0 then round((20000 - done) / rate, 3)::double end as eta from w")
def _w10(spark, sf):
    log = tables(spark, sf, "events").select(F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp")).alias("second"), F.lit(1).cast("long").alias("done"))
    return Q.run_progress(log, 20000)


_LAYERS = "layers as (select doc_id as id, case when regexp_matches(text, '[*$%&|]') then 'A' when regexp_matches(text, '[0-9]') then 'B' when lang <> 'en' then 'C' when n_chars < 500 then 'D' else 'E' end as layer from documents)"


def _layers(spark, sf):
    t = F.col("text")
    rules = [("A", t.rlike("[*$%&|]")), ("B", t.rlike("[0-9]")), ("C", F.col("lang") != "en"), ("D", F.col("n_chars") < 500)]
    return Q.assign_layer(tables(spark, sf, "documents"), rules, "E").select(F.col("doc_id").alias("id"), "layer")


@query("q1_layers", f"with {_LAYERS} select * from layers")
def _q1(spark, sf):
    return _layers(spark, sf)


#: Titles of all layers: a broken encoding (also of promotion, which comes second), promotion, a separator, none, CJK.
_LAYERED = f"case p_partkey % 5 when 0 then '{_BROKEN}' when 1 then '加群 ' || p_partkey when 2 then p_name || ' - ' || p_brand when 3 then p_name else '晴天' end"


@query("q1_sampler_layers", "select p_partkey as id, ['A', 'B', 'C', 'D', 'E'][p_partkey % 5 + 1] as layer from part")
def _q1s(spark, sf):
    titles = tables(spark, sf, "part").selectExpr("p_partkey as id", f"{_LAYERED} as title")
    return Q.assign_layer(titles, Q.sampler_rules(F.col("title")), "E").select("id", "layer")


_SAMPLE = f"""{_LAYERS}, r as (select *, row_number() over (partition by layer order by md5('7:' || id), id) as r, case layer when 'A' then 40 when 'B' then 30 when 'C' then 50 when 'D' then 30 else 50 end as q from layers),
sample as (select id, layer, case when r <= q then 'quota' else 'fill' end as picked from r order by (r <= q) desc, md5('7:' || id), id limit 200)"""


@query("q2_stratified_sample", f"with {_SAMPLE} select * from sample")
def _q2(spark, sf):
    return Q.stratified_sample(_layers(spark, sf), 200, 7)


@query("q2_sample_distribution", f"with {_SAMPLE}, p as (select layer, count(*) as n from sample group by 1) select l.layer, count(*) as pool, coalesce(max(p.n), 0) as picked from layers l left join p using (layer) group by 1")
def _q2d(spark, sf):
    return Q.sample_distribution(Q.stratified_sample(_layers(spark, sf), 200, 7), _layers(spark, sf))


@query("q3_systematic_sample", "select id from (select doc_id as id, row_number() over (order by md5(doc_id::varchar), doc_id) - 1 as r from documents) where r % 9 = 0")
def _q3(spark, sf):
    return Q.systematic_sample(tables(spark, sf, "documents").selectExpr("doc_id as id"), 9)


@query("q4_expectations", "select unnest([{'name': 'lines', 'expected': 60000.0, 'found': count(*)::double, 'ok': count(*) = 60000}, {'name': 'none', 'expected': 1.0, 'found': null, 'ok': false}], recursive := true) from lineitem")
def _q4(spark, sf):
    facts = tables(spark, sf, "lineitem").agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("name", F.lit("lines"))
    expected = spark.createDataFrame([("lines", 60000.0), ("none", 1.0)], "name string, value double")
    return Q.check_expectations(facts.select("name", "value"), expected)


@query("q5_claims", "select p_type as name, count(*)::double as expected, count(*)::double as found, true as ok from part group by 1")
def _q5(spark, sf):
    counts = tables(spark, sf, "part").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    lines = counts.select(F.format_string("| %s | %.0f rows |", "name", "value").alias("line"))
    return Q.check_expectations(counts, Q.parse_claims(lines))


@query("q6_sensitivity", f"with {_BEST_SQL} select bar, n, percent from (select metric as bar, n, percent from (" + _rates({str(b): f"ss >= {b}" for b in (0.5, 0.65, 0.85, 0.95)}, "best") + "))")
def _q6(spark, sf):
    return Q.sensitivity(_best(spark, sf).withColumn("s", F.col("strict.score")), "s", (0.5, 0.65, 0.85, 0.95))


@query("q7_definitions", f"with {TRACKS_SQL} " + _rates({"year": "year <> 0", "year_valid": "year between 1900 and 2024", "album": "album <> ''", "album_or_genre": "album <> '' or genre is not null"}, "tracks"))
def _q7(spark, sf):
    y, a = F.col("year"), F.col("album") != ""
    return Q.rate_table(tracks(spark, sf), {"year": y != 0, "year_valid": V.valid_year(y, 2024, 0), "album": a, "album_or_genre": a | F.col("genre").isNotNull()})


@query("f10_task_filter", f"with {TASKS_SQL} select id, name from tasks where status = 'downloading'")
def _f10(spark, sf):
    t = tasks(spark, sf).withColumn("status", V.public_status(V.normalize_status(F.col("status"))))
    return t.where("status = 'running'").select("id", "name")
