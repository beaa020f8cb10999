"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source that shall give ``t`` words out of ``s`` takes all its documents
``floor(t / s)`` times and once more those whose hash lies below a threshold. The threshold is found without sorting:
words are summed by source and bucket of the hash; the running sums name the one bucket in which the budget ends, and
only that bucket is summed again in finer buckets, until a single hash is left. A larger budget only raises the
threshold, so mixes of different budgets are nested. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bits of the hash, and bits that each level of buckets resolves.
HASH_BITS = 60
LEVEL_BITS = 10

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: str) -> Column:
    """Hash of ``HASH_BITS`` bits of a key as text; null counts as the empty text."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source: str) -> Column:
    """A text that is never null and differs for every source."""
    return F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source)))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Budget of every source, from one row ``(source, key, source_size)`` for each.

    Sources in order of their code points, null last, weigh ``weights`` over and over. They share ``share`` times all
    words; a target above ``cap`` times its source's size stops there and the excess goes to the others by weight
    until none is above. That is one water level: the sources with the smallest cap for their weight fill up first.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy("full_at", "place")
    rows = sizes.select("source", "key", "source_size", place.alias("place"), weight.alias("weight")).select(
        "*", (cap * F.col("source_size")).alias("most"), (cap * F.col("source_size") / F.col("weight")).alias("full_at")
    )
    rows = rows.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("below"),
        F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    ).withColumn("level", (F.col("budget") - F.col("below")) / F.col("open"))
    # The first source that the level at its place does not fill up sets the level of all.
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(everything)
    rows = rows.withColumn("level", first["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return rows.select("source", "key", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` with ``whole`` (times that all documents are taken) and ``below`` (hash below which once more).

    ``rows`` has ``key``, ``size`` and ``hash`` of every document. Each level reads only the rows of the boundary
    bucket of each source; there are at most ``HASH_BITS / LEVEL_BITS`` levels.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    open_ = budgets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    open_ = open_.select("key", "left", F.lit(0).cast("long").alias("prefix"))
    found = None
    end = 1 << HASH_BITS
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("hash", shift)
        inside = rows.withColumn("prefix", F.shiftright("hash", shift + LEVEL_BITS)).join(open_, ["key", "prefix"])
        sums = inside.groupBy("key", bucket.alias("bucket")).agg(
            F.sum("size").alias("sum"), F.min("hash").alias("first"), F.max("hash").alias("last"), F.first("left").alias("left")
        )
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = sums.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("sum") > F.col("left")))
        edge = written(edge.withColumn("left", F.col("left") - F.col("before")), f"mix-level-{shift}")
        alone = F.col("first") == F.col("last")
        # The last hash is taken if that brings the sum nearer to the budget.
        done = edge.filter(alone).select("key", (F.col("first") + F.when(F.col("sum") / 2 <= F.col("left"), 1).otherwise(0)).alias("below"))
        found = done if found is None else found.unionByName(done)
        open_ = edge.filter(~alone).select("key", "left", F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
    # Sources without a boundary have a budget that covers all their words, or no word at all.
    return budgets.withColumn("whole", whole).join(found, "key", "left").withColumn("below", F.coalesce("below", F.lit(end)))


def mix(
    df: DataFrame, size: Column, key: str = "doc_id", source: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` of each row.

    ``copies`` says how often the mix takes the row, ``taken = copies * size``. Null sources form one source, the
    last. Rows with the same key share a hash and so their fate; a null key counts as the empty text. A source
    without words has target 0. An empty table gives an empty result. Old columns of the five names are replaced.
    Reruns agree, since the hash depends on the key alone.
    """
    names = ("size", "source_size", "target", "copies", "taken")
    columns = [c for c in (keep or df.columns) if c.lower() not in names]
    # The row travels as one value, so that no column of it can clash with those of the mix.
    base = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns] or [F.lit(0)]).alias("row"), size.cast("long").alias("size"),
        source_key(source).alias("_source"), F.col(source).alias("_name"), unit_hash(key).alias("_hash"),
    )
    # What the histograms read is written narrow; with few columns to keep, those rows serve for the result as well.
    base = base if keep is None else written(base, "mix-rows")
    rows = base.select(F.col("_source").alias("key"), "_name", "size", F.col("_hash").alias("hash"))
    rows = written(rows, "mix-rows") if keep is None else rows
    sizes = rows.groupBy("key").agg(F.first("_name").alias("source"), F.sum("size").alias("source_size"))
    budgets = written(targets(sizes, weights, share, cap).drop("source"), "mix-budgets")
    plan = written(thresholds(rows.select("key", "size", "hash"), budgets), "mix-plan").withColumnRenamed("key", "_source")
    copies = F.col("whole") + F.when((F.col("_hash") < F.col("below")) & (F.col("target") > F.col("whole") * F.col("source_size")), 1).otherwise(0)
    out = base.join(plan, "_source").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], *names)


def take(df: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: every row of ``df`` as often as ``mix`` takes it, with the columns of ``df``.

    Rows without words are taken as often as the rest of their source below the threshold; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    key, source = options.pop("key", "doc_id"), options.pop("source", "source")
    inner = df.select(row, F.col(key).alias("_id"), F.col(source).alias("_from"), size.alias("_words"))
    mixed = mix(inner, F.col("_words"), "_id", "_from", **options)
    each = mixed.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return each.select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
