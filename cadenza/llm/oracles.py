"""DuckDB SQL for the numbered queries that SQL can state."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def lower_sql(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def archive_sql() -> str:
    value = "('0x' || substr(h, g * 5 + 1, 5))::bigint"
    chars = " || ".join(f"substr('{_BASE32}', ((v >> {s}) & 31)::int + 1, 1)" for s in (15, 10, 5, 0))
    return f"""with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select h, string_agg({chars}, '' order by g) as digest from (select h, g, {value} as v from (select distinct h from p), (select unnest(range(8)) as g)) group by h),
m as (select h, max(page_id) as kept from p group by h)
select page_id, octet_length(encode(html))::bigint as payload_bytes, digest as payload_digest, case when kept <> page_id then 'revisit' else 'response' end as record_type,
 case when kept <> page_id then kept end as refers_to, null::varchar as problem from p join d using (h) join m using (h)"""


def contamination_sql(width: int, slop: int) -> str:
    """Exact hits by joins on whole windows; n_near from all starts about the places of each window's rarest term."""
    words = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with docs as (select doc_id, {words.format(lower_sql('text'))} as w from documents),
items as (select item_id, {words.format(lower_sql('text'))} as w from benchmark),
wins as (select distinct item_id, w[i + 1 : i + least({width}, len(w))] as t from (select item_id, w, unnest(range(greatest(1, len(w) - {width - 1}))) as i from items where len(w) > 0)),
sizes as (select distinct len(t) as n from wins),
spans as (select doc_id, n, i, w[i + 1 : i + n] as t from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as i from docs join sizes on len(w) >= n)),
hits as (select doc_id, i, n, item_id from spans join wins using (t)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from hits) group by 1),
want as (select win, unnest(range(len(t))) as k, unnest(t) as x from (select row_number() over () as win, w[i + 1 : i + least({width}, len(w))] as t
 from (select w, unnest(range(greatest(1, len(w) - {width - 1}))) as i from items where len(w) > 0))),
posts as (select doc_id, x, list(p) as places from (select doc_id, unnest(w) as x, unnest(range(len(w))) as p from docs) where x in (select x from want) group by 1, 2),
counts as (select x, sum(len(places)) as c from posts group by 1),
rare as (select win, arg_min({{'k': k, 'x': x}}, (coalesce(c, 0), k)) as r from want left join counts using (x) group by 1 having min(coalesce(c, 0)) > 0),
starts as (select distinct win, doc_id, p - r.k + unnest(range(-{slop}, {slop + 1})) as s from (select win, r, doc_id, unnest(places) as p from rare join posts on posts.x = r.x)),
tried as (select win, doc_id, s, bool_and(coalesce(list_contains(places, s + k), false)) as exact, bool_and(coalesce(len(list_filter(places, lambda p: abs(p - s - k) <= {slop})) > 0, false)) as near
 from starts join want using (win) left join posts using (doc_id, x) group by all),
runs as (select win, doc_id, exact, s - row_number() over (partition by win, doc_id order by s) as run from tried where near),
nears as (select doc_id, count(*) as n_near from (select win, doc_id, run from runs group by all having not bool_or(exact)) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from docs left join places using (doc_id) left join found using (doc_id) left join nears using (doc_id)"""


def near_duplicates_sql() -> str:
    words = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
    return f"""with recursive docs as (select doc_id, {words.format(lower_sql('text'))} as w from documents),
sets as (select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') as s from (select doc_id, w, unnest(range(greatest(1, len(w) - 4))) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by 1),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as i from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * i >= 80 * (p.n + q.n - i)),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y),
firsts as (select x, min(y) as c from reach group by 1)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(f.c, d.doc_id)) as component_id from docs d left join sizes s using (doc_id) left join firsts f on f.x = d.doc_id"""


def sharding_sql(shards: int) -> str:
    def jump(n: int, name: str) -> str:
        step = "((k * 2862933555777941757 + 1) % 18446744073709551616)"
        return f"""{name}(doc_id, k, b, j) as (select doc_id, doc_id::uhugeint, -1::bigint, 0::bigint from documents
 union all select doc_id, {step}::uhugeint, j, floor((j + 1) * (2147483648::double / (({step} // 8589934592) + 1)::double))::bigint from {name} where j < {n})"""

    # the table of the checksum, then the checksum of the bytes, one after the other
    bit = "case when c % 2 = 1 then xor(3988292384::bigint, c // 2) else c // 2 end"
    return f"""with recursive {jump(shards, 'one')}, {jump(shards + 1, 'two')},
t(n, i, c) as (select n, 0, n::bigint from range(256) r(n) union all select n, i + 1, {bit} from t where i < 8),
crc as (select list(c order by n) as tab from t where i = 8),
docs as (select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, hex(encode(coalesce(text, ''))) as h from documents),
bytes as (select doc_id, size, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::bigint) as b from docs),
sums as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(tab[xor(c & 255, x) + 1], c >> 8)), 4294967295::bigint) as text_crc32 from bytes, crc),
placed as (select doc_id, size::bigint as size, text_crc32, 'key' as law, o.b::int as shard, w.b::int as grown_shard from sums join (select doc_id, b from one where j >= {shards}) o using (doc_id) join (select doc_id, b from two where j >= {shards + 1}) w using (doc_id))
select *, row_number() over (partition by shard order by substr(md5(doc_id::varchar || ':' || text_crc32), 1, 8), doc_id) - 1 as slot from placed"""


def hard_negatives_sql() -> str:
    return """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
n as (select p.*, s.other as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.other) as r
 from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, r::int as rank, negative_id, positive_score, negative_score from n where r <= 10"""


def divergence_sql(least_docs: int, term_ranks: int) -> str:
    """Every pair of sources over every kept term, without a tree."""
    words = f"regexp_extract_all({lower_sql('text')}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    share = "(1 + (1000000000::hugeint * ({0} + 1)) // ({1} + v))"
    apart = "(({0} - {1}) * ({0} - {1})) // {1}"
    return f"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, {words} as w, row_number() over () as row from documents),
t as (select lang, source, row, unnest(w) as term from d),
kept as (select lang, term, count(*) as total from t group by 1, 2 having count(distinct row) >= {least_docs}),
vs as (select lang, count(*)::hugeint as v, sum(total)::hugeint as lang_n from kept group by 1),
c as (select lang, source, term, count(*) as c from t semi join kept using (lang, term) group by 1, 2, 3),
ns as (select lang, source, sum(c)::hugeint as n from c group by 1, 2),
g as (select lang, source, coalesce(v, 0) as v, coalesce(n, 0) as n, coalesce(lang_n, 0) as lang_n from (select distinct lang, source from d) left join vs using (lang) left join ns using (lang, source)),
cells as (select g.lang, g.source, term, coalesce(c, 0)::hugeint as c, total, v, lang_n, {share.format('coalesce(c, 0)', 'n')} as p from g join kept using (lang) left join c using (lang, source, term)),
sums as (select a.lang, a.source, b.source as item, sum({apart.format('a.p', 'b.p')})::bigint as value from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
shares as (select lang, source, term, p, {share.format('total', 'lang_n')} as q from cells where c > 0),
terms as (select lang, source, 'term' as part, term as item, ({apart.format('p', 'q')})::bigint as value from shares where p > q)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pairs union all from terms) qualify part = 'pair' or rank <= {term_ranks}"""
