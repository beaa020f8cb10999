"""Model replies: text that should be JSON, often inside a Markdown code fence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import strip

_FENCE = "```"


def unfence(reply: Column) -> Column:
    """Text inside the first fence (its info line dropped) up to the last fence."""
    text = strip(reply)
    after = F.substring(text, F.instr(text, _FENCE) + 3, F.length(text))
    body = F.when(after.contains("\n"), F.substring(after, F.instr(after, "\n") + 1, F.length(after))).otherwise(after)
    inner = F.when(body.contains(_FENCE), strip(F.regexp_extract(body, r"(?s)^(.*)```", 1))).otherwise(body)
    return F.when(text.contains(_FENCE), inner).otherwise(text)


def parse_model_replies(df: DataFrame, schema: str, body: str = "reply", strict: bool = True) -> DataFrame:
    """Add ``parsed``; replies that are no JSON of the shape become no rows."""
    raw = unfence(F.col(body))
    parsed = df.withColumn("parsed", F.from_json(raw, schema, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.try_parse_json(raw).isNotNull() & F.col("parsed").isNotNull()) if strict else parsed
