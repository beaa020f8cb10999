"""Exact deduplication of arriving texts by a stream with disk-backed keyed state.

Fingerprints of arriving rows (digest of the normalised text, stable identifier, content locator) form a log. A
streaming aggregation over the log keeps one state row for each digest, without watermark and so without expiry: how
many rows it has, and identifier and locator of the row that stays. The state lies in RocksDB and is saved to the
shared folder with every batch, so a restarted query goes on where the last one ended. Rows that hit a state row of
others are checked byte by byte against the content at the kept locator, which is read again where it lies in a file of
an earlier call. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.session import shared_folder

from .common import keyed_join, spread_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: State on disk, without the megabytes that every store would set aside in advance.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests of repeated texts up to this number (about 40 bytes each) may be broadcast to find their rows.
FEW_DIGESTS = 500_000


def normalised(text: str | Column) -> Column:
    """The text with A-Z in lower case; null counts as empty."""
    return F.coalesce(F.translate(text, UPPER, LOWER), F.lit(""))


def fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``digest`` (SHA-256, binary) and ``locator`` (file, row) of every row.

    Rows that are equal in key and digest are told apart by the locator only.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(F.col(key).alias("key"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"), place.alias("locator"))


def run_stream(spark: SparkSession, log: str, schema, state: str, out: str) -> None:
    """Bring the keyed state up to date with all files of the log, and write the changed state rows of each batch.

    A batch that is repeated after a failure replaces its own folder. The stream ends when the log is read.
    """
    # The row that stays: the largest key, then the largest locator; a null key is the smallest.
    best = F.max(F.struct(F.col("key"), F.col("locator")))
    kept = spark.readStream.schema(schema).parquet(log).groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("kept"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = kept.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def latest(spark: SparkSession, out: str, key_type: str) -> DataFrame:
    """``digest``, ``group_size``, ``kept`` as of the last batch that changed each digest."""
    schema = f"digest binary, group_size long, kept struct<key: {key_type}, locator: struct<file: string, row: long>>, batch long"
    rows = spark.read.schema(schema).parquet(out)
    return rows.groupBy("digest").agg(F.max_by(F.struct("group_size", "kept"), "batch").alias("s")).select("digest", "s.group_size", "s.kept")


def deduplicate(
    df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, read: Callable[[list[str]], DataFrame] | None = None
) -> DataFrame:
    """``key``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row of a file-based ``df``.

    Texts are equal when they agree after lower-casing A-Z; null counts as empty. The row with the largest key
    stays; among rows that repeat its key the one that lies last in the files. Null keys are smallest. An empty
    table gives no rows. ``folder`` keeps log and state between calls over new files, in any order of keys; by default
    a new one. The result then has the rows of all calls. Files of earlier calls must still be there: ``read`` (Parquet
    by default) opens those that hold the kept rows of repeated digests. Equal digests of different texts raise an
    error, found by comparing all bytes of every repeated text.
    """
    spark = df.sparkSession
    earlier = known(spark, folder, dict(df.dtypes)[key]) if folder else None
    folder = folder or shared_folder(spark, "exact")
    log = fingerprints(df, key, text)
    log.write.mode("append").parquet(f"{folder}/log")
    schema = log.schema
    seen = spark.read.schema(schema).parquet(f"{folder}/log")
    run_stream(spark, f"{folder}/log", schema, f"{folder}/state", f"{folder}/kept")
    kept = written(latest(spark, f"{folder}/kept", schema["key"].dataType.simpleString()), "exact-kept") if not seen.isEmpty() else None
    if kept is None:
        return seen.select(F.col("key").alias(key), F.col("key").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    repeated = kept.filter("group_size > 1")
    if earlier is not None:
        old = earlier.join(fingerprints(df, key, text).select("digest").distinct(), "digest", "left_semi")
        check_earlier(df, written(old, "exact-earlier"), text, read or (lambda files: spark.read.parquet(*files)))
    check_bytes(df, repeated, text, whole=earlier is None)
    rows = keyed_join(seen, kept, "digest", "inner")
    stays = F.col("kept.locator").eqNullSafe(F.col("locator"))
    return rows.select(F.col("key").alias(key), F.col("kept.key").alias("keep_id"), "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def known(spark: SparkSession, folder: str, key_type: str) -> DataFrame | None:
    """State of the earlier calls with this folder, written apart; None before the first."""
    try:
        return written(latest(spark, f"{folder}/kept", key_type), "exact-known")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def contents(df: DataFrame, text: str) -> DataFrame:
    """``content``, ``at`` (file, row) and ``digest`` of every row of a file-based frame."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = df.select(normalised(text).alias("content"), place.alias("at"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))


def compare(copies: DataFrame, originals: DataFrame) -> None:
    """Raise an error unless every copy (``digest``, ``group_size``, ``content``, ``at``) has its ``original``'s bytes."""
    same = spread_join(copies, originals, "digest", "group_size", F.col("at"))
    found = same.filter(~F.col("content").eqNullSafe(F.col("original"))).select(F.col("original").isNull().alias("gone")).first()
    if found is not None:
        raise ValueError("the kept text of a digest is not at its locator" if found["gone"] else "two different texts share a SHA-256 digest")


def check_earlier(df: DataFrame, old: DataFrame, text: str, read: Callable[[list[str]], DataFrame]) -> None:
    """Compare the rows of ``df`` with the kept texts of earlier calls, read at their locators from their own files."""
    files = [r[0] for r in old.select("kept.locator.file").distinct().collect()]
    if not files:
        return
    places = old.select(F.col("kept.locator").alias("at"), "digest")
    originals = contents(read(files), text).withColumnRenamed("content", "original").drop("digest").join(places, "at").select("digest", "original")
    counted = contents(df, text).select("digest").groupBy("digest").agg(F.count("*").alias("group_size"))
    sized = written(counted.join(places.select("digest"), "digest"), "exact-sizes")
    copies = contents(df, text).join(sized, "digest").select("digest", "group_size", "content", "at")
    compare(copies, sized.join(originals, "digest", "left").select("digest", "group_size", "original"))


def check_bytes(df: DataFrame, repeated: DataFrame, text: str, whole: bool = True) -> None:
    """Compare all bytes of every repeated text with the text at the kept locator; differing bytes raise an error.

    The kept text goes to more tasks the more copies it has, and each copy to one of them. Unless ``df`` is the
    ``whole`` of the files, digests whose kept row lies elsewhere are left to ``check_earlier``.
    """
    digests = repeated.select("digest", "kept.locator", "group_size")
    if digests.count() <= FEW_DIGESTS:
        digests = F.broadcast(digests)
    hits = contents(df, text).join(digests, "digest")
    stays = F.col("at").eqNullSafe(F.col("locator"))
    originals = hits.filter(stays).select("digest", "group_size", F.col("content").alias("original"))
    copies = hits.filter(~stays).select("digest", "group_size", "content", "at")
    if not whole:
        originals = written(originals, "exact-originals")
        copies = copies.join(originals.select("digest"), "digest", "left_semi")
    compare(copies, originals)
