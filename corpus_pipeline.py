"""The corpus pipeline: five stages from raw documents to numbered shards.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and is written as Parquet and
reread as the next one's input. All but the last return the columns of documents as they came, whatever their names. They
call the general operators in cadenza.llm; the parameters are those of the queries there.

Stages: documents that the quality classifier scores below the threshold go; one document of each group of near
duplicates stays, that with the smallest id; documents with a benchmark window go; sources are mixed to their
weights, which can drop documents of over-supplied sources and repeat those of scarce ones; every row gets a shard.

Rows are told apart by id and text, not by id alone: an id that several texts have, or none, doesn't mix up their
verdicts. Rows that repeat id and text are one document. Null texts count as empty; null ids count as larger than all
others; empty tables pass through every stage as empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import quality_classifier
from cadenza.llm.common import materialize, owned, packed, read_table
from cadenza.llm.decontamination import contamination
from cadenza.llm.jaccard_join import near_duplicates
from cadenza.llm.queries import QUALITY_THRESHOLD, SHARDS, WINDOW_WORDS, mixed
from cadenza.llm.sharding import assign_shards


def _identity() -> Column:
    """What makes two rows one document; orders rows by id, null ids last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above. The classifier learns from labelled rows of ``docs``."""
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(packed(docs), model, text="row.text")
    return scored.where(F.col("quality_score") >= QUALITY_THRESHOLD).select("row.*")


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component, by id, then by text; one of rows that repeat it. Null ids come last."""
    groups = near_duplicates(docs.select(_identity().alias("k"), "text"), "k")
    firsts = materialize(groups.where(F.col("component_id") == F.col("k")).select("k").distinct(), "firsts")
    rows = packed(docs, _identity().alias("k")).join(firsts, "k", "left_semi")
    return rows.dropDuplicates(["k"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = contamination(docs.select(_identity().alias("k"), "text"), read_table(spark, sf_dir, "benchmark"), WINDOW_WORDS, key="k")
    hit = materialize(found.where("contaminated").select("k").distinct(), "contaminated")
    return packed(docs, _identity().alias("k")).join(hit, "k", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture selects them."""
    return mixed(packed(docs, *(F.col(c) for c in ("doc_id", "text", "lang", "source"))), keep=["row"]).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its size, checksum, shard and slot."""
    return assign_shards(docs, SHARDS, keep=["doc_id"])


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The classifier is a trained network, which SQL can't state; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What earlier stages of this call wrote to the shared folder is removed when the next stage has been written."""
    docs = read_table(spark, sf_dir, "documents")
    with owned() as tables:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
            tables.remove(spark, docs)
    return docs
