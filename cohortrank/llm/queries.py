"""Registered queries of the training-data operators and of the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import chat_format, dart_minhash, ego_join, line_dedup, max_sketch, nbsvm, quality_rules, rtree_negatives, secret_scan, sentencepiece_offsets, source_mix, substring_dedup, warc_zip

TOKENIZER = "piece_bpe_32k.model"


def _sha(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", _sha("kept_text").alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(secret_scan.document_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
                        F.sha2(secret_scan.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_zip.write_archives(table(spark, sf_dir, "pages"))
    return warc_zip.read_records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.score(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_offsets.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", _sha("kept_text").alias("kept_sha256"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return rtree_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON records of mixed layouts, formatted, and read back from the formatted text and its loss mask."""
    sample = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sample).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat_format.format_records(chat_format.mixed_records(chat_format.conversations(rows)))
    out = out.select("conv_id", chat_format.formatted(F.col("segments")).alias("formatted"), chat_format.read_loss(F.col("segments")).alias("loss"))
    out = out.withColumn("turns", chat_format.read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), _sha("loss").alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secret_scan, op3_warc_zip, op4_quality_classifier, op5_quality_rules, op6_sentencepiece,
                                   op7_embedding_near_dedup, op8_source_mix, op9_line_dedup, op10_minhash_near_dedup, op11_hard_negatives, op12_ranked_search, op13_chat_format, pipeline)}
