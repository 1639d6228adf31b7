"""The queries opN_<name>: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, lines, neighbours, packing, secrets, shard, spots, substrings, toxicity
from .common import read


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shard_by_bytes(read(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _equals(value: int):
    return lambda x: x == value


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("_spans", lambda s: s["kind"])
    count = {r.kind: F.size(F.filter(kinds, _equals(i))).cast("long") for i, r in enumerate(secrets.RULES)}
    text = secrets.spans_text(F.col("_spans"))
    return found.select("doc_id", *[c.alias(f"n_{k}") for k, c in count.items()], F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), _pattern())


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.fingerprint_documents(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = packing.bpe_encoder(_vocabulary("byte_bpe_50k.json"), _pattern())
    return packing.pack(read(spark, sf_dir, "documents"), encoder, end_id=1, capacity=2048)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


QUERIES = {"op1_shard": op1_shard, "op2_secrets": op2_secrets, "op4_line_dedup": op4_line_dedup, "op10_substrings": op10_substrings, "op3_bpe": op3_bpe, "op5_spotsigs": op5_spotsigs, "op6_jaccard": op6_jaccard, "op7_packing": op7_packing, "op8_toxicity": op8_toxicity, "op9_neighbours": op9_neighbours}
