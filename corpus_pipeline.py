"""A corpus pipeline: language, near copies, secrets, mix, token ids.

Each stage takes the rows that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import byte_bpe, jaccard_join, language_id, mixing, queries, secret_scan
from marketlens.operators.ordered import numbered
from marketlens.sources.scratch import discard, new_path, staged

ORACLE_SQL = None
#: What links two documents: the contract of stages on word shingles, which is not that of the op2 query.
WORDS_PER_SHINGLE, PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is rejected go: no letter, or too far from every centroid."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    judged = docs.withColumn("llm_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("llm_row", "text")
    return language_id.predict(judged, model).where(~F.col("rejected")).select("llm_row.*")


def with_row_numbers(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """All rows and `llm_row`, a number that every later read gives again: the number of the row's file and its place in it.

    A stage's rows are files already, so nothing is written but the list of files; rows from elsewhere are written once.
    """
    if not docs.inputFiles():
        docs = staged(docs, "pipeline-rows")
    files = docs.select(F.col("_metadata.file_path").alias("llm_file")).distinct()
    files = staged(numbered(files, ["llm_file"], "llm_file_number", "pipeline-files"), "pipeline-file-numbers")
    placed = docs.select("*", F.col("_metadata.file_path").alias("llm_file"), F.col("_metadata.row_index").alias("llm_place"))
    number = F.shiftleft("llm_file_number", 33) + F.col("llm_place")
    return placed.join(files, "llm_file").withColumn("llm_row", number).drop("llm_file", "llm_place", "llm_file_number")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that of the least doc_id, then of the least digest of its columns.

    Rows are linked by their five-word shingles at a Jaccard index of 0.8. They are judged one by one, whatever ids they
    repeat or lack; a row without an id goes if a row with one is left. Rows without words are linked with nothing.
    """
    rows = with_row_numbers(spark, docs)
    judged = jaccard_join.classes(rows.select(F.col("llm_row").alias("doc_id"), "text"), percent=PERCENT, width=WORDS_PER_SHINGLE)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("digest"), "llm_row").alias("place")
    named = judged.select(F.col("doc_id").alias("llm_row"), "component_id").join(rows.select("llm_row", order), "llm_row")
    placed = staged(named, "pipeline-judged")
    discard(judged)
    best = placed.groupBy("component_id").agg(F.min("place").alias("best"), F.count("*").alias("n")).where("n > 1")
    dropped = placed.join(best, "component_id").where("llm_row <> best.llm_row").select("llm_row")
    return rows.join(dropped, "llm_row", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked and its length is brought up to date."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in clean.columns:
        return clean
    length = F.when(F.col("text").isNotNull(), F.length("text").cast(clean.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids and of their decoded bytes."""
    return byte_bpe.digests(docs.select("doc_id", "source", "text"), queries.rank_file())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
