"""Queries of the linkage operators. Candidates are made from the parts table: the same titles under other ids, some of them changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.text import loose_name, parts_similarity, squeeze, squeezed_parts, title_queries
from cadenza.operators import digest_tree as D
from cadenza.operators import link as L
from cadenza.operators.retrieve import build_index, retrieve
from cadenza.operators.similar import contained_pairs, spread
from cadenza.plans.registry import query
from cadenza.plans.views import ATTEMPTS_SQL, attempts, stored, tables
from cadenza.sources.shared import dealt, shuffled, written


def _local(spark, sf):
    df = tables(spark, sf, "part").selectExpr("p_partkey as track_id", "p_name || ' ' || p_partkey as title", "p_brand as artist", "p_partkey % 9 <> 0 as artist_usable", "cast(p_size * 10 as int) as seconds")
    return dealt(df).withColumn("title_key", squeeze(F.col("title"), False))


#: Under one title in four stands a sign more, under one in seven something before it, under one in nine something behind.
_CANDIDATE_TITLE = "case when p_partkey % 4 = 0 then p_name || ' x' || p_partkey when p_partkey % 7 = 0 then 'The ' || p_name || ' ' || p_partkey when p_partkey % 9 = 0 then p_name || ' ' || p_partkey || ' live' else p_name || ' ' || p_partkey end"


def _candidates(spark, sf):
    df = tables(spark, sf, "part").selectExpr(
        "p_partkey as c_cand_id", "p_partkey as seq", "case when p_partkey % 3 = 0 then 'netease' else 'musicbrainz' end as source", f"{_CANDIDATE_TITLE} as c_title",
        "case when p_partkey % 10 = 0 then '' else p_brand end as c_artist", "cast(p_size * 10 + p_partkey % 40 as int) as c_seconds",
    )
    return dealt(df).withColumn("c_title_key", squeeze(F.col("c_title"), False))


def _scored(spark, sf):
    """The hits of all tracks and candidates. They are matched once; all queries on them read the stored table."""
    return stored(spark, sf, "scored", lambda: L.match_and_score(_local(spark, sf), _candidates(spark, sf)))


_SIM = """case when title_key = c_title_key then 1.0 when length(title_key) >= 2 and length(c_title_key) >= 2 and (contains(title_key, c_title_key) or contains(c_title_key, title_key))
 then greatest(1 - levenshtein(title_key, c_title_key)::double / greatest(length(title_key), length(c_title_key)), 0.75 + 0.25 * (least(length(title_key), length(c_title_key))::double / greatest(length(title_key), length(c_title_key))))
 else 1 - levenshtein(title_key, c_title_key)::double / greatest(length(title_key), length(c_title_key)) end"""
_ASIM = """case when not artist_usable or c_artist = '' then 0.0 when a = ca then 1.0 when contains(a, ca) or contains(ca, a) then greatest(1 - levenshtein(a, ca)::double / greatest(length(a), length(ca)), 0.75 + 0.25 * (least(length(a), length(ca))::double / greatest(length(a), length(ca))))
 else 1 - levenshtein(a, ca)::double / greatest(length(a), length(ca)) end"""
SCORED_SQL = f"""local as (select p_partkey as track_id, p_brand as artist, p_partkey % 9 <> 0 as artist_usable, (p_size * 10)::int as seconds, regexp_replace(lower(p_name || ' ' || p_partkey), '[^a-z0-9]+', '', 'g') as title_key, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') as a from part),
cand as (select p_partkey as c_cand_id, p_partkey as seq, case when p_partkey % 3 = 0 then 'netease' else 'musicbrainz' end as source, case when p_partkey % 10 = 0 then '' else p_brand end as c_artist, regexp_replace(lower(case when p_partkey % 10 = 0 then '' else p_brand end), '[^a-z0-9]+', '', 'g') as ca,
 (p_size * 10 + p_partkey % 40)::int as c_seconds, regexp_replace(lower({_CANDIDATE_TITLE}), '[^a-z0-9]+', '', 'g') as c_title_key from part),
p0 as (select *, {_SIM} as t, {_ASIM} as ar, abs(seconds - c_seconds) as gap from local join cand on true),
p1 as (select *, case when gap > 30 then 0.5 when gap > 15 then 0.85 else 1.0 end as f, gap > 30 as hard, gap > 30 and greatest(seconds, c_seconds) >= 600 and t >= 0.95 as forgiven from p0),
p2 as (select *, hard and not forgiven as conflict, case when forgiven then 1.0 else f end as used, case when artist_usable then 0.6::double * t + 0.4::double * ar else 0.8::double * t + case when c_artist <> '' then 0.12 else 0 end end as base from p1),
p3 as (select *, case when conflict then least(base * used, 0.5) else base * used end as s, case when conflict then least(t * used, 0.5) else t * used end as r from p2),
scored as (select track_id, c_cand_id, seq, source, conflict, round(t, 3) as titleSim, round(ar, 3) as artistSim, gap as durDiff, f::double as durFactor, round(s, 3) as ss, round(r, 3) as rs,
 case when s >= 0.85 and not conflict then 3 when s >= 0.65 and not conflict then 2 when s >= 0.45 then 1 else 0 end as st, case when r >= 0.92 and not conflict then 3 when r >= 0.8 and not conflict then 2 when r >= 0.6 then 1 else 0 end as rt from p3 where not conflict and (s >= 0.65 or r >= 0.8))"""
_NAMES = "['miss', 'weak', 'likely', 'exact']"

#: The candidates that a query is given, as a search of a source gives.
FOUND_EACH = 8
#: ``w6`` and ``a36`` ask as their SQL does: three queries at most, by four terms.
QUERIES_EACH, TERMS_EACH = 3, 4


def _queries(spark, sf, most=None):
    """track_id, query_no, strategy, q: all of title_queries, or the first ``most``. One title in four names its artist too, so there are queries of each strategy."""
    asked = _local(spark, sf).withColumn("asked", F.when(F.col("track_id") % 4 == 1, F.concat("title", F.lit(" - "), "artist")).otherwise(F.col("title")))
    forms = title_queries(F.col("asked"), F.when(F.col("artist_usable"), F.col("artist")))
    forms = forms if most is None else F.slice(forms, 1, most)
    return asked.select("track_id", F.posexplode(forms).alias("query_no", "form")).select("track_id", "query_no", "form.strategy", "form.q")


def _pooled(spark, sf, most=None, terms=None):
    """The candidates that the queries of each track find, scored: track_id, query_no, strategy and the columns of a pair."""

    def build():
        local = written(_local(spark, sf).withColumn("_parts", squeezed_parts(F.col("artist"))), "match-local")
        cands = written(_candidates(spark, sf).withColumn("_c_parts", squeezed_parts(F.col("c_artist"))), "match-candidates")
        index = build_index(cands, "c_cand_id", F.concat_ws(" ", "c_title", "c_artist"))
        found = retrieve(_queries(spark, sf, most), index, FOUND_EACH, ("track_id", "query_no", "strategy"), most=terms)
        # a pair is scored once, whichever of the track's few queries find it
        pairs = found.groupBy("track_id", F.col("id").alias("c_cand_id")).agg(F.collect_list(F.struct("query_no", "strategy", "relevance", "rank")).alias("asked"))
        met = spread(pairs.join(shuffled(cands), "c_cand_id"), "track_id").join(shuffled(local), "track_id")
        scored = L.pair_score(met, alike=parts_similarity(F.col("_parts"), F.col("_c_parts"))).drop("_parts", "_c_parts")
        return scored.withColumn("asked", F.explode("asked")).select("asked.*", *(c for c in scored.columns if c != "asked"))

    return stored(spark, sf, f"pooled-{most}-{terms}", build)


def _pooled_short(spark, sf):
    return _pooled(spark, sf, QUERIES_EACH, TERMS_EACH)


_POOL_PAIRS = SCORED_SQL.replace("from local join cand on true", "from (select distinct track_id, c_cand_id from pool) join local using (track_id) join cand using (c_cand_id)").replace("from p3 where not conflict and (s >= 0.65 or r >= 0.8)", "from p3")
POOLED_SQL = f"""said as (select p_partkey as track_id, p_name || ' ' || p_partkey as title, p_brand as artist, p_partkey % 9 <> 0 as usable, p_partkey % 4 = 1 as named from part),
forms as (select track_id, case when named and usable then [title, title || ' ' || artist, title || ' - ' || artist] when named then [title, artist, title || ' - ' || artist] when usable then [title, title || ' ' || artist] else [title] end as f,
 case when named and not usable then ['S1', 'S3', 'S3'] else ['S1', 'S2', 'S3'] end as s from said),
queries as (select track_id, unnest(range(len(f)))::int as query_no, unnest(s[:len(f)]) as strategy, unnest(f) as q from forms),
holds as (select p_partkey as id, list_distinct(regexp_extract_all(lower({_CANDIDATE_TITLE} || ' ' || case when p_partkey % 10 = 0 then '' else p_brand end), '[a-z0-9]+')) as ts from part),
posts as (select id, unnest(ts) as term from holds), weights as (select term, count(*) as df, round(1000 * ln(1 + (select count(*) from holds) / count(*)))::bigint as weight from posts group by 1),
words as (select track_id, query_no, term, df, weight from (select track_id, query_no, unnest(list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+'))) as term from queries) join weights using (term)
 qualify row_number() over (partition by track_id, query_no order by df, term) <= 4),
ranked as (select track_id, query_no, id as c_cand_id, sum(weight)::bigint as relevance from words join posts using (term) group by 1, 2, 3 qualify row_number() over (partition by track_id, query_no order by sum(weight) desc, id) <= {FOUND_EACH}),
pool as (select * from ranked join queries using (track_id, query_no)), {_POOL_PAIRS}, pooled as (select pool.query_no, pool.strategy, pool.relevance, scored.* from pool join scored using (track_id, c_cand_id))"""
#: The same without its cuts: all queries of title_queries, by all their terms.
WHOLE_POOLED_SQL = (
    POOLED_SQL.replace("[title, title || ' ' || artist, title || ' - ' || artist] when named then", "[title, title || ' ' || artist, title || ' - ' || artist, title || ' - ' || artist || ' ' || artist] when named then")
    .replace("else ['S1', 'S2', 'S3'] end", "else ['S1', 'S2', 'S3', 'S3'] end").replace("\n qualify row_number() over (partition by track_id, query_no order by df, term) <= 4", "")
)
_BEST = "order by st desc, ss desc, rt desc, rs desc, seq"


@query("w1_pair_score", f"with {SCORED_SQL} select track_id, c_cand_id, titleSim as \"titleSim\", artistSim as \"artistSim\", durDiff as \"durDiff\", durFactor as \"durFactor\", conflict, ss as strict_score, {_NAMES}[st + 1] as strict_tier, rs as relaxed_score, {_NAMES}[rt + 1] as relaxed_tier from scored")
def _w1(spark, sf):
    return _scored(spark, sf).select("track_id", "c_cand_id", "titleSim", "artistSim", "durDiff", "durFactor", "conflict", F.col("strict.score").alias("strict_score"), F.col("strict.tier").alias("strict_tier"), F.col("relaxed.score").alias("relaxed_score"), F.col("relaxed.tier").alias("relaxed_tier"))


@query("j1_match_join", f"with {SCORED_SQL} select track_id, source, c_cand_id, {_NAMES}[st + 1] as tier, ss as score from scored qualify row_number() over (partition by track_id, source {_BEST}) = 1")
def _j1(spark, sf):
    return L.best_candidate(_scored(spark, sf), "track_id", "source").select("track_id", "source", "c_cand_id", F.col("strict.tier").alias("tier"), F.col("strict.score").alias("score"))


@query("w2_best_candidate", f"with {SCORED_SQL} select track_id, c_cand_id, {_NAMES}[st + 1] as tier from scored qualify row_number() over (partition by track_id {_BEST}) = 1")
def _w2(spark, sf):
    return L.best_candidate(_scored(spark, sf), "track_id").select("track_id", "c_cand_id", F.col("strict.tier").alias("tier"))


@query("w3_best_relaxed", f"with {SCORED_SQL} select track_id, c_cand_id, {_NAMES}[rt + 1] as tier from scored qualify row_number() over (partition by track_id order by rt desc, rs desc, st desc, ss desc, seq) = 1")
def _w3(spark, sf):
    return L.best_candidate(_scored(spark, sf), "track_id", relaxed_first=True).select("track_id", "c_cand_id", F.col("relaxed.tier").alias("tier"))


@query("w4_top_candidates", f"with {SCORED_SQL} select track_id, c_cand_id, row_number() over (partition by track_id {_BEST}) as rank from scored qualify rank <= 20")
def _w4(spark, sf):
    return L.top_candidates(_scored(spark, sf), 20, "track_id").select("track_id", "c_cand_id", "rank")


@query("p17_retrieved", f"with {WHOLE_POOLED_SQL} select track_id, query_no, strategy, c_cand_id, relevance, row_number() over (partition by track_id, query_no order by relevance desc, c_cand_id)::int as rank from pooled")
def _p17r(spark, sf):
    return _pooled(spark, sf).select("track_id", "query_no", "strategy", "c_cand_id", "relevance", "rank")


@query("w6_early_stop", f"with {POOLED_SQL}, b as (select * from pooled qualify row_number() over (partition by track_id, query_no {_BEST}) = 1) select track_id, query_no, c_cand_id from b qualify row_number() over (partition by track_id order by st >= 2 desc, query_no) = 1")
def _w6(spark, sf):
    per_query = L.best_candidate(_pooled_short(spark, sf), "track_id", "query_no")
    return L.early_stop(per_query, "track_id").select("track_id", "query_no", "c_cand_id")


@query("w7_best_tier", f"with {SCORED_SQL} select track_id, {_NAMES}[max(st) + 1] as tier from scored group by 1")
def _w7(spark, sf):
    return L.best_source_tier(_scored(spark, sf), "track_id")


def _items(spark, sf):
    return tables(spark, sf, "part").selectExpr("p_partkey as item", "case p_partkey % 3 when 0 then p_name || ' ' || p_partkey when 1 then 'The ' || p_name || ' ' || p_partkey else p_name || '_' || p_partkey end as name", "p_brand as artist")


def _library(spark, sf):
    return tables(spark, sf, "part").selectExpr("p_partkey as id", "p_partkey as seq", "p_name || ' ' || p_partkey as title", "p_brand as artist", "p_name || '_' || p_partkey || ' - ' || p_brand || '.mp3' as fileName")


_LIBRARY_SQL = """want as (select p_partkey as item, replace(lower(case p_partkey % 3 when 0 then p_name || ' ' || p_partkey when 1 then 'The ' || p_name || ' ' || p_partkey else p_name || '_' || p_partkey end), ' ', '') as n, lower(p_brand) as a from part),
have as (select p_partkey as id, replace(lower(p_name || ' ' || p_partkey), ' ', '') as t, lower(p_brand) as b, replace(lower(p_name || '_' || p_partkey), ' ', '') as f, replace(lower(p_name || '_' || p_partkey || ' - ' || p_brand), ' ', '') as core from part),
every as (select item, 1 as stage, id from want join have on n = t where contains(a, b) or contains(b, a)
 union all select item, 2, id from want join have on contains(n, t) or contains(t, n) where contains(a, b) or contains(b, a)
 union all select item, 3, id from want join have on n = f or starts_with(n, f) or starts_with(f, n) where contains(a, b) or contains(b, a) or contains(core, a)),
matched as (select item, min(stage::bigint * 1000000000 + id) as m from every group by 1)"""


@query("j5_library_match", f"with {_LIBRARY_SQL} select item, (m // 1000000000)::int as stage, m % 1000000000 as id from matched")
def _j5(spark, sf):
    return L.library_match(_items(spark, sf), _library(spark, sf))


@query("j3_contained_titles", "with a as (select distinct c_mktsegment || (c_custkey % 20) as x from customer), b as (select distinct p_type || (p_size % 12) as p from part) , l as (select x as l, lower(x) as x from a), r as (select p as r, lower(substr(p, 1, 1 + length(p) % 4)) as y from b) select l, r from l join r on contains(x, y) or contains(y, x)")
def _j3(spark, sf):
    one = tables(spark, sf, "customer").selectExpr("c_mktsegment || (c_custkey % 20) as l").distinct().selectExpr("l", "lower(l) as x")
    two = tables(spark, sf, "part").selectExpr("p_type || (p_size % 12) as r").distinct().selectExpr("r", "lower(substr(r, 1, 1 + length(r) % 4)) as y")
    return contained_pairs(one, two)


@query("j6_downloaded_report", f"with {_LIBRARY_SQL} select m is not null as \"inLibrary\", count(*) as n from want left join matched using (item) group by 1")
def _j6(spark, sf):
    return L.library_counts(L.downloaded_report(_items(spark, sf), _library(spark, sf)))


_FILES = "select p_partkey, 'f' || p_partkey as filePath, p_partkey % 97 as mtime, case when {c} and p_size % 5 = 0 then p_size + 1 else p_size end as size from part"


def _old(spark, sf):
    return tables(spark, sf, "part").where("p_partkey % 10 <> 0").selectExpr("'f' || p_partkey as filePath", "p_partkey % 97 as mtime", "p_size as size")


def _new(spark, sf):
    return tables(spark, sf, "part").where("p_partkey % 7 <> 0").selectExpr("'f' || p_partkey as filePath", "p_partkey % 97 as mtime", "case when p_size % 5 = 0 then p_size + 1 else p_size end as size")


_FILES_SQL = f"old as ({_FILES.format(c='false')} where p_partkey % 10 <> 0), new as ({_FILES.format(c='true')} where p_partkey % 7 <> 0)"


@query("j7_changed_files", f"with {_FILES_SQL} select n.filePath as \"filePath\", n.mtime, n.size, case when o.filePath is null then 'new' else 'changed' end as reason from new n left join old o using (filePath) where o.filePath is null or o.size <> n.size")
def _j7(spark, sf):
    return L.changed_files(_new(spark, sf), _old(spark, sf))


@query("j8_deletions", f"with {_FILES_SQL} select filePath as \"filePath\", 'removed' as verdict from old where filePath not in (select filePath from new)")
def _j8(spark, sf):
    return L.deletions(_old(spark, sf), _new(spark, sf))


# a listing with folders, of which a few lost, gained and changed files
_PLACE = "p_brand || '/' || p_type || '/' || p_name || ' ' || p_partkey"
_TREE = f"""told as (select {_PLACE} || '.mp3' as "filePath", p_partkey % 97 as mtime, p_size as size from part where not (p_brand = 'Brand#7' and p_partkey % 10 = 1)),
 seen as (select {_PLACE} || '.mp3' as "filePath", p_partkey % 97 as mtime, case when p_brand = 'Brand#9' and p_partkey % 3 = 0 then p_size + 1 else p_size end as size from part where not (p_brand = 'Brand#12' and p_size % 4 = 0))"""


def _listings(spark, sf):
    place = F.expr(f"{_PLACE} || '.mp3'").alias("filePath")
    part, mtime = tables(spark, sf, "part"), F.expr("p_partkey % 97 as mtime")
    told = part.where("not (p_brand = 'Brand#7' and p_partkey % 10 = 1)").select(place, mtime, F.col("p_size").alias("size"))
    size = F.expr("case when p_brand = 'Brand#9' and p_partkey % 3 = 0 then p_size + 1 else p_size end as size")
    return told, part.where("not (p_brand = 'Brand#12' and p_size % 4 = 0)").select(place, mtime, size)


@query("j8_tree_deletions", f"with {_TREE} select filePath as \"filePath\", 'removed' as verdict from told where filePath not in (select filePath from seen)")
def _j8t(spark, sf):
    sides = _listings(spark, sf)
    return D.tree_deletions(*sides, *(D.build_tree(s) for s in sides))


@query(
    "j19_tree_changes",
    f"""with {_TREE} select coalesce(a.filePath, b.filePath) as "filePath", case when a.filePath is null then 'added' when b.filePath is null then 'removed' else 'changed' end as change
 from told a full join seen b on a.filePath = b.filePath where a.filePath is null or b.filePath is null or a.mtime <> b.mtime or a.size <> b.size""",
)
def _j19t(spark, sf):
    sides = _listings(spark, sf)
    return D.file_changes(*sides, D.changed_folders(*(D.build_tree(s) for s in sides)))


@query("m14_upsert", f"with {_FILES_SQL} select filePath as \"filePath\", mtime, size from new union all select filePath, mtime, size from old where filePath not in (select filePath from new)")
def _m14(spark, sf):
    return L.upsert(_old(spark, sf), _new(spark, sf), "filePath")


@query("m14_remove", f"with {_FILES_SQL} select filePath as \"filePath\", mtime, size from old where filePath not in (select filePath from new)")
def _m14r(spark, sf):
    return L.remove(_old(spark, sf), _new(spark, sf), "filePath")


@query("j10_legacy_ids", "select 'f' || p_partkey as \"filePath\", case when p_partkey % 4 = 0 then ['l' || p_partkey, 'm' || (p_partkey % 10)] else ['l' || p_partkey] end as \"legacyIds\" from part")
def _j10(spark, sf):
    mapping = tables(spark, sf, "part").where("p_partkey % 4 = 0").selectExpr("'m' || (p_partkey % 10) as legacy_id", "'f' || p_partkey as file_path")
    return L.map_legacy_ids(tables(spark, sf, "part").selectExpr("'f' || p_partkey as filePath", "array('l' || p_partkey) as legacyIds"), mapping)


@query("j10_unmatched_legacy", "select 'm' || o_orderkey as legacy_id, 'f' || o_orderkey as file_path from orders where o_orderkey not in (select p_partkey from part) order by 1, 2 limit 200")
def _j10u(spark, sf):
    mapping = tables(spark, sf, "orders").selectExpr("'m' || o_orderkey as legacy_id", "'f' || o_orderkey as file_path")
    return L.unmatched_legacy_ids(tables(spark, sf, "part").selectExpr("'f' || p_partkey as filePath"), mapping)


@query("j11_lyrics_fallback", "select p_partkey as id, case when p_partkey % 3 = 0 then 'sidecar words ' || p_partkey when p_partkey % 4 = 0 then 'embedded words' when p_partkey % 5 = 0 then 'online words here' end as lyrics, case when p_partkey % 3 = 0 then 'sidecar' when p_partkey % 4 = 0 then 'embedded' when p_partkey % 5 = 0 then 'online' end as \"lyricsSource\" from part")
def _j11(spark, sf):
    p = tables(spark, sf, "part")
    own = p.selectExpr("p_partkey as id", "case when p_partkey % 4 = 0 then 'embedded words' else 'short' end as lyrics")
    return L.lyrics_fallback(own, p.where("p_partkey % 3 = 0").selectExpr("p_partkey as id", "'sidecar words ' || p_partkey as lyrics"), p.where("p_partkey % 5 = 0").selectExpr("p_partkey as id", "'online words here' as lyrics"))


@query("j14_sources_side_by_side", f"with {SCORED_SQL}, b as (select * from scored qualify row_number() over (partition by track_id, source {_BEST}) = 1), n as (select track_id, {_NAMES}[st + 1] as netease_tier from b where source = 'netease'), m as (select track_id, {_NAMES}[st + 1] as musicbrainz_tier from b where source = 'musicbrainz') select * from n full join m using (track_id)")
def _j14(spark, sf):
    best = L.best_candidate(_scored(spark, sf), "track_id", "source").select("track_id", "source", F.col("strict.tier").alias("tier"), F.col("c_artist").alias("artist"))
    return L.by_source(best, "track_id", "netease", "musicbrainz").select("track_id", "netease_tier", "musicbrainz_tier")


@query("j15_merge_existing", "select p_partkey as id, case when p_partkey % 5 = 0 then 'locked' when p_partkey % 3 = 0 then 'old' when p_partkey % 2 = 0 then p_type else 'bare' end as genre, case when p_partkey % 2 = 0 then p_size else 1 end as size from part")
def _j15(spark, sf):
    p = tables(spark, sf, "part")
    old = p.selectExpr("p_partkey as id", "case when p_partkey % 5 = 0 then 'locked' when p_partkey % 3 = 0 then 'old' else 'bare' end as genre", "case when p_partkey % 5 = 0 then array('genre') else array() end as lockedFields", "case when p_partkey % 3 = 0 then map('genre', 'embed') else map('x', 'y') end as sourceMap", "1 as size")
    return L.merge_existing(old, p.where("p_partkey % 2 = 0").selectExpr("p_partkey as id", "p_type as genre", "p_size as size"), ["genre"], ["size"])


@query("j18_duplicates", """with d as (select p_partkey as id, p_brand as artist, p_name as title, p_size as seconds from part), g as (select *, case when seconds - lag(seconds) over w <= 2 then 0 else 1 end as fresh from d window w as (partition by artist, title order by seconds, id)),
 r as (select *, sum(fresh) over (partition by artist, title order by seconds, id) as run from g) select id, artist, title, seconds, min(id) over (partition by artist, title, run) as "group", count(*) over (partition by artist, title, run) as n from r qualify n > 1""")
def _j18(spark, sf):
    return L.duplicates(tables(spark, sf, "part").selectExpr("p_partkey as id", "p_brand as artist", "p_name as title", "p_size as seconds"), "artist", "title", "seconds", 2)


@query("j19_reconcile", "select unnest([{'metric': 'rows_a', 'n': (select count(*) from orders)}, {'metric': 'rows_b', 'n': (select count(*) from lineitem)}, {'metric': 'keys_a', 'n': (select count(distinct o_custkey) from orders)}, {'metric': 'keys_b', 'n': (select count(distinct l_partkey) from lineitem)}, {'metric': 'only_a', 'n': (select count(distinct o_custkey) from orders where o_custkey not in (select l_partkey from lineitem))}, {'metric': 'only_b', 'n': (select count(distinct l_partkey) from lineitem where l_partkey not in (select o_custkey from orders))}], recursive := true)")
def _j19(spark, sf):
    return L.reconcile(tables(spark, sf, "orders").selectExpr("o_custkey as k"), tables(spark, sf, "lineitem").selectExpr("l_partkey as k"), "k")


@query("w11_failure_streaks", f"with {ATTEMPTS_SQL}, a as (select source, idx, idx % 3 <> 0 as ok from attempts), i as (select *, sum(ok::int) over (partition by source order by idx) as g from a) select source, min(idx) as start, count(*) as length, count(*) >= 3 as rotate from i where not ok group by source, g")
def _w11(spark, sf):
    return L.failure_streaks(attempts(spark, sf).withColumn("ok", F.col("idx") % 3 != 0))


@query("u3_unclassified", f"with {ATTEMPTS_SQL} select source, case when code > 90 then 'busy' when ok then 'empty' else 'failed' end as verdict, count(*) as n from attempts where n_found = 0 group by 1, 2")
def _u3(spark, sf):
    verdict = F.when(F.col("code") > 90, "busy").when(F.col("ok"), "empty").otherwise("failed").alias("verdict")
    return attempts(spark, sf).where("n_found = 0").groupBy("source", verdict).agg(F.count(F.lit(1)).alias("n"))


@query("u1_pool_union", "with a as (select p_partkey as id, 'old' as origin from part where p_partkey % 3 <> 0), b as (select p_partkey as id, 'new' as origin from part where p_partkey % 2 = 0) select * from a union all select * from b where id not in (select id from a)")
def _u1(spark, sf):
    p = tables(spark, sf, "part")
    old, new = (p.where(c).selectExpr("p_partkey as id", f"'{o}' as origin") for c, o in (("p_partkey % 3 <> 0", "old"), ("p_partkey % 2 = 0", "new")))
    return L.upsert(new, old, "id")


@query("u4_fresh_over_cache", "with c as (select o_custkey as k, max(o_orderkey) as v from orders where o_orderkey % 5 <> 1 group by 1), f as (select o_custkey as k, max(o_orderkey) as v from orders where o_orderkey % 5 = 1 group by 1) select * from f union all select * from c where k not in (select k from f)")
def _u4(spark, sf):
    cache, fresh = (tables(spark, sf, "orders").where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")) for c in ("o_orderkey % 5 <> 1", "o_orderkey % 5 = 1"))
    return L.upsert(cache, fresh, "k")


@query("u6_new_task_ids", "select o_orderkey as id from orders where o_orderkey not in (select o_orderkey from orders where o_custkey % 2 = 0)")
def _u6(spark, sf):
    o = tables(spark, sf, "orders")
    return L.remove(o.selectExpr("o_orderkey as id"), o.where("o_custkey % 2 = 0").selectExpr("o_orderkey as id"), "id")


#: Seconds for which a stored result of a query serves.
STORED_SECONDS = 6 * 3600


@query(
    "u7_query_dedup",
    f"""with {ATTEMPTS_SQL}, a as (select idx, q, source, epoch_us(ts) // 1000000 as asked_at, n_found from attempts), r as (select q, source, asked_at, max(n_found) as n_found from a group by all)
 select a.idx, a.q, a.source, a.asked_at, case when a.asked_at - r.asked_at <= {STORED_SECONDS} then r.asked_at end as stored_at, case when a.asked_at - r.asked_at <= {STORED_SECONDS} then r.n_found end as stored_n_found, coalesce(a.asked_at - r.asked_at > {STORED_SECONDS}, true) as ask
 from a asof left join r on a.q = r.q and a.source = r.source and a.asked_at > r.asked_at""",
)
def _u7(spark, sf):
    asked = attempts(spark, sf).select("idx", "q", "source", F.unix_seconds(F.col("ts").cast("timestamp")).alias("asked_at"), "n_found")
    return L.stored_results(asked.drop("n_found"), asked.select("q", "source", "asked_at", "n_found"), ["q", "source"], "asked_at", STORED_SECONDS, ["n_found"])


@query("u8_first_page_wins", "select o_custkey as id, o_orderkey % 50 as page, o_orderkey as place, o_orderstatus as status from orders qualify row_number() over (partition by o_custkey order by o_orderkey % 50, o_orderkey) = 1")
def _u8(spark, sf):
    rows = tables(spark, sf, "orders").selectExpr("o_custkey as id", "o_orderkey % 50 as page", "o_orderkey as place", "o_orderstatus as status")
    return L.first_page_rows(rows, "id", "page", "place")


@query("u2_corrections", f"with {SCORED_SQL}, b as (select track_id, max(st) as st from scored where seq % 4 <> 0 group by 1), a as (select track_id, max(st) as st from scored group by 1) select track_id, {_NAMES}[coalesce(b.st, 0) + 1] as tier_before, {_NAMES}[a.st + 1] as tier_after from a left join b using (track_id) where a.st > coalesce(b.st, 0)")
def _u2(spark, sf):
    scored = _scored(spark, sf)
    before = L.best_source_tier(scored.where("seq % 4 <> 0"), "track_id").withColumnRenamed("tier", "tier_before")
    after = L.best_source_tier(scored, "track_id").withColumnRenamed("tier", "tier_after")
    both = after.join(shuffled(before), "track_id", "left").withColumn("tier_before", F.coalesce("tier_before", F.lit("miss")))
    return both.where(L.tier_rank(F.col("tier_after")) > L.tier_rank(F.col("tier_before")))


@query("f12_paired_filter", f"with {_LIBRARY_SQL} select item, n from want where contains(n, 'ring') and item in (select item from matched)")
def _f12(spark, sf):
    found = L.downloaded_report(_items(spark, sf), _library(spark, sf)).where("inLibrary").withColumn("n", loose_name(F.col("name")))
    return found.where(F.contains("n", F.lit("ring"))).select("item", "n")

