"""The numbered queries and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import language_id, packing, quality_classifier, secret_scan
from cadenza.llm.common import is_held_out, read_table
from cadenza.llm.decontamination import contamination
from cadenza.llm.divergence import audit
from cadenza.llm.hard_negatives import hard_negatives
from cadenza.llm.jaccard_join import near_duplicates
from cadenza.llm.mixing import mix
from cadenza.llm.oracles import archive_sql, contamination_sql, divergence_sql, hard_negatives_sql, near_duplicates_sql, sharding_sql
from cadenza.llm.quality_rules import apply_rules
from cadenza.llm.sharding import assign_shards
from cadenza.llm.span_dedup import remove_repeated_spans
from cadenza.llm.warc import archive_round_trip

SHARDS = 40
WINDOW_WORDS = 10
#: Places that a word of a proximity match of op2 may be off.
SLOP = 1
LLR_THRESHOLD = -0.3
QUALITY_THRESHOLD = 0.3
#: Of the corpus's tokens, how many the mixture may have; how often a document may be repeated; integer weights.
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.75, 2, 17
#: Documents of a language that a term of the audit must stand in, and how many terms are listed for a source.
AUDIT_DOCS, AUDIT_RANKS = 3, 200
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = {"domain": {"books": 3, "forums": 2, "web": 5}, "lang": {"en": 45, "de": 20, "fr": 20, "es": 15}}


def op1_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_round_trip(read_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op2_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, read_table(spark, sf_dir, "benchmark"), WINDOW_WORDS, SLOP)


def op3_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_spans(docs).drop("text")


def op4_parity_sketch_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model)
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= QUALITY_THRESHOLD).cast("int").alias("predicted")
    )


def op6_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def domain_of(source: Column) -> Column:
    """The given tables have no domain; the number in a source's name stands for it."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forums")), number % 3 + 1)


def mixed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``docs`` mixed by domain, language and source."""
    levels = {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, levels, MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED, keep=keep)


def op7_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs, ["doc_id", "lang", "source"]).select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "n_tokens", "epoch")


def op8_inferred_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan(docs, secret_scan.fit(docs)).drop("text")


def op9_ngram_llr_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return apply_rules(docs, good, LLR_THRESHOLD, keep=["doc_id"])


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs, SHARDS, keep=["doc_id"])


def op11_one_bit_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op12_pattern_tree_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), AUDIT_DOCS, AUDIT_RANKS)


def op13_linear_grouping_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, **packing.vocabulary_files())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_zstd": op1_warc_zstd,
    "op2_positional_index_decontamination": op2_positional_index_decontamination,
    "op3_sentence_span_dedup": op3_sentence_span_dedup,
    "op4_parity_sketch_jaccard": op4_parity_sketch_jaccard,
    "op5_random_indexing_quality": op5_random_indexing_quality,
    "op6_byte_cnn_language": op6_byte_cnn_language,
    "op7_hierarchical_mixing": op7_hierarchical_mixing,
    "op8_inferred_secret_formats": op8_inferred_secret_formats,
    "op9_ngram_llr_rules": op9_ngram_llr_rules,
    "op10_jump_sharding": op10_jump_sharding,
    "op11_one_bit_hard_negatives": op11_one_bit_hard_negatives,
    "op12_pattern_tree_divergence": op12_pattern_tree_divergence,
    "op13_linear_grouping_packing": op13_linear_grouping_packing,
}

def _share_sql(name: str, level: str, parents: tuple[str, ...], weight: str) -> str:
    """The CTEs that hand the budget of ``parents`` to the nodes of ``level``."""
    here = ", ".join((*parents, level))
    joined = "using (" + ", ".join(parents) + ")" if parents else "on true"
    part = "partition by " + ", ".join(parents) if parents else ""
    given = f"d{len(parents)}"
    return f"""
{name}a as (select n.*, {given}.given, ({weight})::bigint as weight from (select {here}, sum(cap)::bigint cap from caps group by all) n join {given} {joined}),
{name}b as (select *, case when weight > 0 then cap::double / weight::double else 1e308 end ratio from {name}a),
{name}c as (select *, coalesce(sum(cap) over ({part} order by ratio, {level} rows between unbounded preceding and 1 preceding), 0) used,
  sum(weight) over ({part} order by ratio, {level} rows between current row and unbounded following) heavy from {name}b),
{name}e as (select *, case when heavy > 0 then greatest(given - used, 0)::double / heavy::double else 0 end rate from {name}c),
{name}f as (select *, coalesce(max(case when ratio > rate then rate end) over ({part}), 0) lev from {name}e),
d{len(parents) + 1} as (select {here}, (case when ratio <= rate then cap else least(cap, floor(lev * weight::double)) end)::bigint given from {name}f)"""


def _mixing_sql() -> str:
    def case(level: str) -> str:
        given = MIX_WEIGHTS.get(level, {})
        return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in given.items()) + " else 1 end" if given else "1"

    shares = ",".join(_share_sql(f"s{i}", level, MIX_LEVELS[:i], case(level)) for i, level in enumerate(MIX_LEVELS))
    return f"""with docs as (
  select doc_id, lang, source, md5(coalesce(text, '')) text_md5, ['web', 'books', 'forums'][coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as int), 0) % 3 + 1] as domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint tokens from docs group by all),
caps as (select *, tokens * {MIX_EPOCHS} as cap from leaves),
d0 as (select floor(sum(tokens)::double * {MIX_FRACTION})::bigint given from leaves),{shares},
plan as (select l.domain, l.lang, l.source, l.tokens, d3.given budget, least({MIX_EPOCHS}, case when tokens > 0 then floor(d3.given / tokens)::int else 0 end) whole
  from leaves l join d3 using (domain, lang, source) where d3.given > 0),
summed as (select d.*, p.whole, p.budget - p.whole * p.tokens rest, sum(n_tokens) over (partition by d.domain, d.lang, d.source
  order by substr(md5('{MIX_SEED}:' || p.whole || ':' || doc_id || ':' || text_md5), 1, 8), doc_id, n_tokens rows between unbounded preceding and current row) s
  from docs d join plan p using (domain, lang, source)),
times as (select *, least({MIX_EPOCHS}, whole + (s <= rest)::int) n from summed)
select doc_id, domain, lang, source, n_tokens, unnest(range(0, n))::int as epoch from times where n > 0"""


#: Queries that learn, op3's spans of varying length and op13's ids are tested by brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_zstd": archive_sql(),
    "op2_positional_index_decontamination": contamination_sql(WINDOW_WORDS, SLOP),
    "op4_parity_sketch_jaccard": near_duplicates_sql(),
    "op10_jump_sharding": sharding_sql(SHARDS),
    "op7_hierarchical_mixing": _mixing_sql(),
    "op11_one_bit_hard_negatives": hard_negatives_sql(),
    "op12_pattern_tree_divergence": divergence_sql(AUDIT_DOCS, AUDIT_RANKS),
}
