"""The registered queries of the document operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import fingerprints, language_model, licenses, mixing, negatives, pieces, privacy, quality, secrets, sharding, similarity, spelling, toxicity
from sluice.llm.common import documents


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether decoding them gives the text again (a mark for a space in the text is read as a space)."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.xxhash64(F.replace("text", F.lit(pieces.MARK), F.lit(" "))).alias("text_key"))
    out = pieces.decode(pieces.encode(docs))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.xxhash64("decoded") == F.col("text_key")).alias("round_trip"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(documents(spark, sf_dir))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(privacy.find(documents(spark, sf_dir)))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_model.train(docs.filter(~language_model.held_out()))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    return language_model.score(docs, model).select("doc_id", language_model.held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.totals["n"]).cast("long").alias("train_tokens"), "base_score", "score", perplexity)


def op8_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.groups(documents(spark, sf_dir), k=4, percent=85)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out()))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "sentences")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector carries the next label; anchors are the vectors whose id is divisible by 100."""
    rows = negatives.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets, op2_pieces, op3_quality, op4_mixing, op5_privacy, op6_sharding, op7_language_model, op8_similarity, op9_fingerprints, op10_toxicity,
        op11_negatives, op12_licenses, op13_spelling,
    )
}
