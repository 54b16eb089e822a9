"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

All stages but the last return the columns that they were given, whatever the names and types of those besides doc_id,
text, lang and source; a stage's own columns take names that are free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachefold.llm.common import crc_remainder, drop_folder, free_name, materialize, new_folder
from cachefold.llm.langid import UNKNOWN, predictor
from cachefold.llm.mixing import mixed_documents
from cachefold.llm.neardup import near_duplicates
from cachefold.llm.packing import pack
from cachefold.llm.pii import pseudonymize
from cachefold.llm.queries import table, tokenizer_path

LEAST_SCORE = 0.15  # a text whose best language scores lower has no language that the model knows
SHINGLE = 5


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that fit no known language."""
    found = free_name(docs.columns, "found")
    predict = predictor(docs, crc_remainder("doc_id", 4) == 2)
    told = docs.withColumn(found, predict(F.col("text").cast("string")))
    return told.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE)).select(*columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates.

    Rows of that id that are equal in all columns are kept once, others stay; rows without an id have no group and stay.
    """
    found = materialize(near_duplicates(docs, k=SHINGLE).where("doc_id is not null").select("doc_id", "kept"), "found")
    # The ids that go are fewer than those that stay; rows without an id meet none of them. Texts are dealt by id at any size.
    rest = docs.join(found.where("not kept").select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*columns(docs))
    repeated = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rest
    # Ids that are repeated: rows are told apart by a digest of all their columns.
    rows = rest.select("doc_id", F.struct(*columns(rest)).alias("row")).join(repeated, "doc_id", "left_semi")
    digest = F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256)
    rows = rows.withColumn("digest", digest).groupBy("doc_id", "digest").agg(F.any_value("row").alias("row")).select("row.*")
    return rest.join(repeated, "doc_id", "left_anti").select(*columns(docs)).unionByName(rows)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by format-preserving pseudonyms."""
    return pseudonymize(docs, count=free_name(docs.columns, "n_pii")).select(*columns(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops and repeats documents so that sources have their target shares of words."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("pii", private_data),
    ("mixing", source_mix),
    ("packing", packed),
]

#: Learnt scores, MinHash components, keyed permutations and token ids have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared folder and read again.

    A stage's input is deleted when its output is written.
    """
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if done is not None:
            drop_folder(spark, done)
        docs, done = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
