"""Stored chat transcripts in event-stream form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MESSAGE = "type string, content string, confidence double, answered_from_sources_only boolean"


def parse_sse(df: DataFrame) -> DataFrame:
    """``(id, answer, confidence, sources_only)`` of transcripts ``(id, body)``."""
    lines = F.filter(
        F.split("body", "\n"), lambda l: l.startswith("data: ") & (l != "data: [DONE]")
    )
    messages = F.transform(lines, lambda l: F.from_json(F.substring(l, 7, 1 << 30), _MESSAGE))
    parsed = df.select("id", messages.alias("m"))
    texts = F.transform(
        F.filter("m", lambda m: m["type"] == "text"), lambda m: F.coalesce(m["content"], F.lit(""))
    )
    last = F.try_element_at(F.filter("m", lambda m: m["type"] == "sources"), F.lit(-1))
    has = F.exists("m", lambda m: m["type"] == "sources")
    return parsed.select(
        "id",
        F.array_join(texts, "").alias("answer"),
        F.when(has, F.coalesce(last["confidence"], F.lit(0.0))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(has, F.coalesce(last["answered_from_sources_only"], F.lit(True))).otherwise(F.lit(True)).alias("sources_only"),
    )
