"""One query per operator over its whole table, with the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from statwitness.llm.common import materialise
from statwitness.llm import chat, decontaminate, exact, htmltext, langid, minhash, mixing, mixlm, resample, secretscan, tokens, toxicity, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file of the op9 contract; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *[F.col(f"mix.{c}") for c in ("size", "source_size", "target", "taken")])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.summary(secretscan.find_secrets(table(spark, sf_dir, "documents")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=85)
    return found.documents.withColumnRenamed("id", "doc_id")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def toxic_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    """Learned from the labelled documents outside the held-out part."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text").filter(~langid.held_out(F.col("key"), 5, 0))
    return toxicity.train(texts, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = toxic_lexicon(spark, sf_dir)
    scored = toxicity.score_texts(table(spark, sf_dir, "documents"), lexicon)
    return scored.select(F.col("id").alias("doc_id"), langid.held_out(F.col("id"), 5, 0).alias("held_out"), "score", "predicted")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    turns = materialise(chat.format_turns(rows))
    # prompts repeat what is before them, which this codec makes short
    return chat.read_back(turns, materialise(chat.examples(turns), "zstd"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(~langid.held_out(F.col("doc_id"), 3, 1)).select(F.col("doc_id").alias("key"), "text", "lang")
    scored = langid.predict(docs, langid.train(learned))
    return scored.select(F.col("id").alias("doc_id"), langid.held_out(F.col("id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_tokens(written).withColumnRenamed("id", "doc_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = mixlm.base_parts(F.col("doc_id"), 10)
    learned = mixlm.learn(docs, F.when(rest == 0, 0).when(rest == 9, 2).otherwise(1))
    scored = mixlm.score(docs, learned)
    return scored.select(F.col("id").alias("doc_id"), (mixlm.base_parts(F.col("id"), 10) == 0).alias("held_out"), "n_tokens", "n_known",
                         F.lit(learned.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score", "n_bytes", "bits_per_byte")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix, op2_secrets, op3_near_duplicates, op4_main_text, op5_toxicity, op6_chat, op7_language,
                            op8_exact_duplicates, op9_tokens, op10_decontaminate, op11_resample, op12_variants, op13_lm_scores)}

SQL: dict[str, str] = {"op1_mix": mixing.SQL, "op8_exact_duplicates": exact.SQL, "op11_resample": resample.SQL, "op12_variants": variants.SQL}
