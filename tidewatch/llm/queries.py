"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import align, chat, codes, decontaminate, dedup, language, mixing, oracles, quality, repeats, tokens, topk, toxicity, vectors
from tidewatch.llm.arrow import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = language.train(docs.where("not held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


#: A conversation whose texts look like control strings; part of the query's definition.
CONTROL_TURNS = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values %s as t(conv_id, turn, role, text)" % ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in CONTROL_TURNS))
    chats = chat.format_chats(chat.canonical_turns(chat.gathered(rows.unionByName(extra))))
    back = chats.select("conv_id", "formatted", chat.read_back().alias("turns"), chat.read_loss().alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def examples(spark: SparkSession, sf_dir: str, column: str, parts: int, part: int) -> tuple[DataFrame, DataFrame]:
    """All documents marked as held out or not, and the labels of those that are not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", parts, part))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", parts, part)).select("doc_id", F.col(column).alias("label"))
    return docs, labels


def predicted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = examples(spark, sf_dir, "toxic", 3, 1)
    return predicted(toxicity.score_toxicity(docs, toxicity.learn(docs, labels)).drop("text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[1].drop("source")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = examples(spark, sf_dir, "quality", 4, 2)
    return predicted(quality.score_quality(docs, quality.fit(docs, labels)).drop("text"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(codes.digest(books)))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.largest_products(vectors, vectors.where("vec_id % 100 = 0"))


def queries() -> dict:
    own = [
        op1_language_id, op2_minhash_dedup, op3_decontamination, op4_token_counts, op5_embedding_dedup,
        op6_chat_format, op7_toxicity, op8_mixing, op9_quality, op10_repeats,
        op11_token_alignment, op12_vector_codes, op13_exact_topk,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_dedup": oracles.MINHASH, "op5_embedding_dedup": oracles.VECTORS, "op6_chat_format": oracles.chats(CONTROL_TURNS), "op12_vector_codes": oracles.codes(), "op13_exact_topk": oracles.PRODUCTS}
