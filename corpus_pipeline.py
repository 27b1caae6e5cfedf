"""A training corpus in five stages: language, near-duplicates, repeats, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``docs``, whatever they are; columns of the same names
as an operator's own never reach the operator. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.llm import decontaminate, dedup, language, mixing, repeats
from tidewatch.llm.arrow import held_out
from tidewatch.llm.storage import discard, stored

#: A text of more bits a byte than this under every known language is in none of them.
FOREIGN_BITS = 6.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, null and empty texts included, and texts in no language that was learned.

    The model is fitted on the table's own language labels, held-out rows excepted. Without labelled rows there is no
    language to compare with, and all documents stay.
    """
    model = language.train(docs.where(~held_out()))
    if not model.languages:
        return docs
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    told = language.identify(own, model)
    return told.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= FOREIGN_BITS)).select("row.*")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates, and one row of each id; null ids and texts stay."""
    groups = stored(dedup.near_duplicates(docs.select("doc_id", "text"), percent=80), "near-duplicates")
    kept = docs.join(groups.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    repeated = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    # of rows that share an id the one with the least text stays, whatever the order in which they are read
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *[F.col(c).cast("string").asc_nulls_last() for c in docs.columns if c not in ("doc_id", "text")])
    once = kept.where("doc_id is not null").withColumn("_turn", F.row_number().over(first)).where("_turn = 1").drop("_turn")
    return once.unionByName(kept.where("doc_id is null"))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte that a 100-byte string with an earlier start covers; a character cut in two goes as well.

    Documents of which nothing is left go; null and empty texts stay. ``n_chars`` is counted anew where it exists.
    """
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    cut = repeats.remove_repeats(own, as_text=True).where("n_removed = 0 or octet_length(kept_text) > 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_chars")]
    fresh = [text.alias("text")] + ([F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")).alias("n_chars")] if "n_chars" in docs.columns else [])
    return cut.select(*columns, *fresh).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; documents with null ids or texts stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.contaminated(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with size, source_size, target and taken (words the mix takes, repeats counted).

    Documents of which the mix takes no word go, and so do rows with a null id. An id under several sources has a share
    in each of them; rows that repeat an id and source are added up there.
    """
    _, shares = mixing.mix(docs.select("doc_id", "text", "source"))
    a, b = docs.drop("size", "source_size", "target", "taken").alias("a"), shares.where("taken > 0").alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    return a.join(b, same).select("a.*", "b.size", "b.source_size", "b.target", "b.taken")


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]
#: Language models, minima and suffix order have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages in turn; each stage's table is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
