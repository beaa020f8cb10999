"""Uploads: admission, fingerprints, duplicates and queue order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import fingerprint

# Upload limit of 30 MiB.
MAX_UPLOAD_BYTES = 30 * 1024 * 1024


def base_name(path):
    """Last component of a path, whichever slash it uses."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def read_uploads(spark, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder with their size; the content is only read where a later step asks for it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("filename"), F.col("length").alias("n_bytes"), "content",
        F.when(F.lower("path").endswith(".pdf"), "application/pdf").otherwise("application/octet-stream").alias("mime"),
    )


def admit_uploads(uploads: DataFrame, specs: DataFrame, max_bytes: int | None = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add ``accepted`` and ``reason`` (NULL when accepted); the file name loses its folders.

    ``uploads(…, filename, mime, n_bytes, project_id, schema_key, version_label)`` and
    ``specs(project_id, schema_key, version_label, status)``, unique per label. The join is an
    ordinary left join: a catalogue below the broadcast threshold is broadcast, a larger one is not.
    Uploads above ``max_bytes`` are rejected; None admits any size.
    """
    known = specs.select("project_id", "schema_key", "version_label", F.col("status").alias("spec_status"))
    is_pdf = F.lower(F.coalesce("mime", F.lit(""))).contains("pdf") | F.lower("filename").endswith(".pdf")
    reason = (
        F.when(F.col("spec_status").isNull(), "unknown_checklist")
        .when(F.col("spec_status") != "active", "inactive_checklist")
        .when(~is_pdf, "not_pdf")
        .when(F.lit(False) if max_bytes is None else F.col("n_bytes") > max_bytes, "too_large")
    )
    joined = uploads.join(known, ["project_id", "schema_key", "version_label"], "left")
    return joined.select(
        *[c for c in uploads.columns if c != "filename"], base_name(F.col("filename")).alias("filename"),
        reason.isNull().alias("accepted"), reason.alias("reason"),
    )


def with_fingerprint(df: DataFrame, content: str) -> DataFrame:
    return df.withColumn("content_hash", fingerprint(F.col(content)))


def duplicate_uploads(df: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of equal content. Counts combine on the map side, so a text copied a million times is cheap."""
    return (
        with_fingerprint(df, content)
        .groupBy("content_hash")
        .agg(F.count("*").alias("copies"), F.min(key).alias("first_id"))
        .filter("copies > 1")
    )


def dedupe_queue(df: DataFrame, keys: list[str], arrival: str, name: str = "filename") -> DataFrame:
    """First arrival per key among PDF files: a ``min_by``, not a window, so a hot key stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    pdfs = df.filter(F.lower(name).endswith(".pdf"))
    return pdfs.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("r")).select(*keys, "r.*")
