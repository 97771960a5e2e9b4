"""Filings documents: parallel arrays to rows, and the symbol-to-CIK lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import values as V

# Central index keys of the five companies.
COMPANY_CIKS = {
    "AAPL": "0000320193",
    "MSFT": "0000789019",
    "NVDA": "0001045810",
    "NFLX": "0001065280",
    "AMZN": "0001018724",
}
ARRAYS = ["form", "filingDate", "primaryDocument", "primaryDocDescription"]


def cik_frame(spark: SparkSession, ciks: dict[str, str] = COMPANY_CIKS) -> DataFrame:
    return spark.createDataFrame(list(ciks.items()), "symbol string, cik string")


def lookup_cik(rows: DataFrame, dim: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Add the zero-padded CIK of each symbol; symbols the dimension lacks are left out.

    The dimension is broadcast by Spark while it is below the broadcast threshold.
    """
    ids = dim.select(F.col("symbol").alias(symbol), V.padded_id(F.col("cik")).alias("cik"))
    return rows.join(ids, symbol)


def name_companies(docs: DataFrame, dim: DataFrame) -> DataFrame:
    """Documents named by the symbol of their file: company and CIK of a symbol that the dimension holds.

    Other documents keep the name and the CIK they bring. A symbol has one CIK: the least, if the dimension repeats it.
    """
    ids = dim.groupBy("symbol").agg(V.padded_id(F.min("cik")).alias("_cik"))
    known = F.col("_cik").isNotNull()
    return docs.join(ids, "symbol", "left").withColumns({
        "company_name": F.when(known, F.col("symbol")).otherwise(F.coalesce("company_name", "symbol")),
        "cik": F.coalesce("_cik", "cik"),
    }).drop("_cik")


def _recent(name: str) -> Column:
    return F.col(f"filings.recent.{name}")


def _shortest() -> Column:
    return F.least(*[F.coalesce(F.size(_recent(a)), F.lit(0)) for a in ARRAYS])


def uneven_filings(docs: DataFrame) -> DataFrame:
    """Documents whose arrays differ in length, with the number of entries left out."""
    longest = F.greatest(*[F.coalesce(F.size(_recent(a)), F.lit(0)) for a in ARRAYS])
    return (
        docs.select("company_name", "cik", longest.alias("longest"), _shortest().alias("shortest"))
        .where(F.col("longest") > F.col("shortest"))
        .withColumn("entries_left_out", F.col("longest") - F.col("shortest"))
    )


def flatten_filings(docs: DataFrame) -> DataFrame:
    """One row per filing of documents(company_name, cik, filings), up to the shortest of the four arrays."""
    kept = [F.slice(_recent(a), F.lit(1), _shortest()).alias(a) for a in ARRAYS]
    rows = docs.where(_shortest() > 0).select("company_name", "cik", F.inline(F.arrays_zip(*kept)))
    return rows.select(
        "company_name",
        "cik",
        F.col("form").alias("form_type"),
        F.col("filingDate").cast("string").alias("filing_date"),
        V.split_words(F.col("primaryDocument")).alias("document_links"),
        F.col("primaryDocDescription").alias("description"),
        F.lit(None).cast("string").alias("content"),
    )
