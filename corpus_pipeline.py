"""The corpus pipeline: five stages, each a Parquet table that the next one reads.

quality rules -> line dedup -> MinHash near-dedup -> mixing sources -> SentencePiece.
A stage takes (spark, docs, sf_dir). All but the last return the columns of
documents, extra ones included, whatever their names; texts that line dedup
shortens get a new ``n_chars``, if there is such a column. Null ids and texts,
repeated rows and empty tables are those of the operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrank.llm import dart_minhash, line_dedup, quality_rules, sentencepiece_offsets, source_mix
from cohortrank.session import materialize, table

TOKENIZER = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share, but for their first occurrence.

    Documents that had words and lost them all are copies of others; they go.
    """
    return line_dedup.drop_lines(docs, drop_emptied=True, keep="first")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; of rows equal in id and text, the least by all columns."""
    heads = dart_minhash.near_duplicates(docs).filter("kept").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = whole.join(heads, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    once = kept.filter("rows = 1").select("row").unionByName(kept.filter("rows > 1").groupBy("id", "hash").agg(
        F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row")).select("row"))
    return once.select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return source_mix.repeat(source_mix.mix(rows), ["row"]).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix, encoded and decoded."""
    return sentencepiece_offsets.encode_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near_dedup), ("source_mix", mix), ("sentencepiece", encode)]

#: Signatures, a trained model and the tokenizer can't be stated in SQL. Tests hold run() against a brute-force version on a small
#: labelled fixture (verdicts are those of the quality query): lines, groups, repetitions, token counts and digests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
