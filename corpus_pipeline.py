"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, language_id, mixing, token_store
from tessera.llm.shared import Workspace

#: A document nearer to no profile than this share of the greatest distance is in none of the learnt languages.
MIN_LANGUAGE_SCORE = 0.05


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose language is one of those learnt; letterless, empty, null and alien texts go.

    Each row is judged by its own text, repeated ids and rows without one too.
    """
    return language_id.keep(docs, language_id.learn(docs.where(language_id.fold() != 0)), MIN_LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id.

    Rows of one doc_id are one document: the one with the least non-null text stays (of equal ones, that least in the
    other columns). Rows without doc_id are no documents and go.
    """
    kept = jaccard_join.jaccard_join(docs).where("kept").select("doc_id", "n_rows")
    out = docs.join(kept.where("n_rows = 1"), "doc_id", "left_semi").select(docs.columns)
    again = kept.where("n_rows > 1")
    if again.isEmpty():
        return out
    least = F.min(F.struct(F.col("text").isNull(), "text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("least")
    rest = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least)
    return out.unionByName(rest.select("doc_id", "least.*").select(docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go, all rows of their doc_id with them; rows without doc_id stay unsearched."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (up to three times, or not at all).

    Equal rows are one with the copies of all; different rows of one doc_id are told apart by a hash of their columns.
    """
    told = docs.withColumn("_row", F.xxhash64(*docs.columns))
    mixed = mixing.mix(told, carry=("_row",)).groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_mixed")).agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0")
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_mixed"))
    return told.dropDuplicates(["doc_id", "_row"]).join(mixed, match).withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as directly addressable codes; the rows are those read back from the files."""
    return token_store.read_store(token_store.write_store(docs, Workspace(spark, "pipeline-store")))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

#: No SQL expresses the rank-order profiles and the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; every stage's result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
