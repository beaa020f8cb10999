"""The checklist catalogue as a table that documents are validated against.

Bodies are compiled where they lie: one Arrow pass over the distinct bodies gives each checklist's fields, rules and
groups as values, and patterns are tried by the JVM's own compiler in the same row. Documents bind to a version of
their checklist, join its values, and one plan validates them all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.operators import programs
from docaudit.plans.checklist import SPEC_TYPE, Checklist, literal_table
from docaudit.plans.normalise import normalised_body
from docaudit.session import ship_package

_BOTH = f"struct<spec:{SPEC_TYPE},programs:{programs.PROGRAMS_TYPE}>"


def compiled_body(spec_id: str | None, body: str | None, normalise: bool = True) -> str | None:
    """A body's fields, rules and groups as JSON; None where the body is no object."""
    try:
        read = json.loads(body or "")
    except ValueError:
        return None
    if not isinstance(read, dict):
        return None
    checklist = Checklist.from_body(str(spec_id or ""), normalised_body(read) if normalise else read)
    return json.dumps({"spec": checklist.as_row(), "programs": programs.programs_row(checklist)})


def _compile(normalise: bool):
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, bodies in batches:
            yield pd.Series([compiled_body(i, b, normalise) for i, b in zip(ids, bodies, strict=True)], dtype=object)

    return run


def _checked(spec: Column) -> Column:
    """The checklist without the patterns that the JVM's compiler rejects."""

    def field(f: Column) -> Column:
        bad = f["regex"].isNotNull() & F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), f["regex"]).isNull()
        none = F.lit(None).cast("string")
        return F.when(bad, f.withField("regex", none).withField("regex_took", none).withField("regex_groups", F.array().cast("array<int>"))).otherwise(f)

    return spec.withField("fields", F.transform(spec["fields"], field))


def compiled(catalogue: DataFrame, normalise: bool = True) -> DataFrame:
    """``spec_id``, ``spec`` and ``programs`` of a catalogue ``(spec_id, body)``, bodies being JSON texts.

    Bodies that are no JSON object are left out, so their documents have an unknown checklist; of rows that repeat an
    id the one with the greatest body counts. Entries of the wrong shape are skipped, as when linting.
    """
    ship_package(catalogue.sparkSession)
    rows = catalogue.filter("spec_id IS NOT NULL").select(F.col("spec_id").cast("string").alias("spec_id"), "body")
    rows = rows.groupBy("spec_id").agg(F.max("body").alias("body"))
    rows = rows.select("spec_id", F.from_json(_compile(normalise)("spec_id", "body"), _BOTH).alias("c")).filter("c IS NOT NULL")
    return rows.select("spec_id", _checked(F.col("c.spec")).alias("spec"), F.col("c.programs").alias("programs"))


def spec_programs(spark: SparkSession, checklists: Sequence[Checklist]) -> DataFrame:
    """The same table for a few checklists at hand, as part of the plan."""
    rows = [{"spec_id": c.spec_id, "spec": c.as_row(), "programs": programs.programs_row(c)} for c in checklists]
    return literal_table(spark, rows, f"spec_id string, spec {SPEC_TYPE}, programs {programs.PROGRAMS_TYPE}")
