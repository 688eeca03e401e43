"""Plain text of PDF files by their text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.functions.text import js_trim

# The text of an empty result and the escapes of shown strings.
PLACEHOLDER = "[PDF content could not be extracted]"

_ESCAPES = ((r"\\n", "\n"), (r"\\r", ""), (r"\\t", " "), (r"\\\(", "("), (r"\\\)", ")"), (r"\\\\", r"\\"))


def pdf_text_column(raw: Column) -> Column:
    """Shown strings first, then long printable runs; repeated ones once."""

    def decode(s: Column) -> Column:
        for pattern, char in _ESCAPES:
            s = F.regexp_replace(s, pattern, char)
        return js_trim(s)

    shown = F.transform(F.regexp_extract_all(raw, F.lit(r"\(([^)]+)\)\s*Tj"), F.lit(1)), decode)
    runs = F.filter(
        F.transform(F.regexp_extract_all(raw, F.lit(r"[\x20-\x7E]{20,}"), F.lit(0)), js_trim),
        lambda s: ~(s.contains("<<") | s.contains(">>") | s.contains("/Type")),
    )
    parts = F.filter(F.array_distinct(F.concat(shown, runs)), lambda s: s != "")
    return F.coalesce(F.nullif(js_trim(F.array_join(parts, "\n")), F.lit("")), F.lit(PLACEHOLDER))


def pdf_text(
    spark: SparkSession, path: str, size_limit: int | None = None, read_bytes: int | None = None
) -> DataFrame:
    """``(path, text, skipped)`` of the PDF files in a folder.

    Whole files are read. With ``size_limit`` larger files have no text and say so in
    ``skipped``; with ``read_bytes`` only the beginning of each file is looked at.
    """
    files = spark.read.format("binaryFile").load(path)
    too_large = F.lit(False) if size_limit is None else F.col("length") > size_limit
    content = F.col("content") if read_bytes is None else F.substring("content", 1, read_bytes)
    # bytes that are not UTF-8 become replacement characters
    raw = F.coalesce(F.try_validate_utf8(content.cast("string")), F.make_valid_utf8(content.cast("string")))
    return files.select(
        "path",
        F.when(~too_large, pdf_text_column(raw)).alias("text"),
        F.when(too_large, F.lit("too large")).alias("skipped"),
    )
