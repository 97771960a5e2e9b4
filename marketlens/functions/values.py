"""Typed parsing of landing values, with bad values told apart from missing ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in a landing document, and as a missing one.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MISSING_NUMBER_PATTERN = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def to_number(raw: Column) -> Column:
    """Text to double. Anything that is not a plain number becomes NULL."""
    return F.when(raw.rlike(NUMBER_PATTERN), F.trim(raw).try_cast("double"))


def is_bad_number(raw: Column) -> Column:
    """True where a value is present but is neither a number nor a spelled-out missing one."""
    return F.coalesce(~raw.rlike(f"{NUMBER_PATTERN}|{MISSING_NUMBER_PATTERN}"), F.lit(False))


def finite(value: Column) -> Column:
    """NaN and infinities to NULL."""
    # NaN sorts above infinity.
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def to_volume(value: Column) -> Column:
    """Missing volume counts as zero; a whole number becomes a 64-bit integer."""
    return F.coalesce(finite(value), F.lit(0.0)).cast("long")


def is_fractional(value: Column) -> Column:
    present = finite(value)
    return F.coalesce(present != F.floor(present), F.lit(False))


def to_date(raw: Column) -> Column:
    """ISO text to date, a time behind it allowed; anything else becomes NULL and the row is kept."""
    timed = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.when(raw.try_cast("timestamp").isNotNull(), F.substring(raw, 1, 10).try_cast("date")))
    return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw.try_cast("date")).otherwise(timed)


def to_published(raw: Column) -> Column:
    """Feed time such as 20240131T235959 to timestamp; other shapes become NULL."""
    return F.try_to_timestamp(raw, F.lit("yyyyMMdd'T'HHmmss"))


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0, "Positive").when(score < 0, "Negative").otherwise("Neutral")


def split_words(text: Column) -> Column:
    """Whitespace split without empty items."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def padded_id(raw: Column, width: int = 10) -> Column:
    """Number or text to a zero-padded id."""
    return F.lpad(raw.cast("long").cast("string"), width, "0")


def timestamp_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", value)


def variant_field(record: Column, path: str, kind: str, default) -> Column:
    """Field of a variant record. A missing key takes the default; a JSON null stays NULL."""
    raw = F.try_variant_get(record, path, "variant")
    return F.when(raw.isNull(), F.lit(default).cast(kind)).when(
        ~F.is_variant_null(raw), F.try_variant_get(record, path, kind)
    )


def hash_bucket(key: Column, buckets: int) -> Column:
    """Stable bucket of a key from the first eight hex digits of its md5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets
