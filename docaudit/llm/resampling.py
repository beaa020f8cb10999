"""Importance resampling towards a target distribution of hashed word n-grams.

How much likelier a bucket of features is in the target than in the corpus gives its gain; documents are drawn without
replacement by mean gain plus Gumbel noise. Texts are cut into segments at newlines, which no word holds. Segments that
repeat are counted first and their features extracted once: corpus counts are those of the distinct segments times their
occurrences, and a document's gain is the sum of its segments'. N-grams that reach over a newline belong to no segment
and are counted apart, from the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.arrays import let

from .common import keyed_join, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores in one bucket of the coarse histogram.
COARSE = 1_024
#: Segments up to this number may be broadcast to the documents with their gains.
FEW_SEGMENTS = 200_000


def segments(text: str) -> Column:
    """The lines of a text, A-Z lower-cased; none of a null."""
    return F.coalesce(F.split(F.translate(text, UPPER, LOWER), "\n"), F.array().cast("array<string>"))


def words(segment: str | Column) -> Column:
    return F.regexp_extract_all(segment, F.lit(WORD), F.lit(0))


def bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature.cast("binary")), F.lit(buckets)).cast("int")


def runs_of(all_words: Column, most: int, buckets: int, wanted=None) -> Column:
    """Buckets of the runs of 1 to ``most`` words, or of those for whose place and size ``wanted`` holds."""

    def of_size(size: int) -> Column:
        places = F.when(F.size(all_words) >= size, F.sequence(F.lit(1), F.size(all_words) - (size - 1))).otherwise(F.array().cast("array<int>"))
        if wanted is not None:
            places = F.filter(places, lambda i: wanted(i, size))
        return F.transform(places, lambda i: bucket(F.array_join(F.slice(all_words, i, size), " "), buckets))

    single = [F.transform(all_words, lambda w: bucket(w, buckets))] if wanted is None else []
    return F.concat(*single, *map(of_size, range(2, most + 1)))


def crossing_features(lines: Column, most: int, buckets: int) -> Column:
    """Buckets of the runs of 2 to ``most`` words of a document that do not lie within one line."""
    numbered = F.flatten(F.transform(lines, lambda s, i: F.transform(words(s), lambda w: F.struct(w.alias("w"), i.alias("at")))))

    def across(both: Column) -> Column:
        at = both.getField("at")
        return runs_of(both.getField("w"), most, buckets, lambda i, size: F.element_at(at, i) != F.element_at(at, i + (size - 1)))

    return let(numbered, across)


def digest(segment: str | Column) -> Column:
    return F.substring(F.unhex(F.sha2(segment, 256)), 1, 16)


def distinct_segments(df: DataFrame, text: str, most: int, buckets: int) -> DataFrame:
    """``seg`` (digest), ``n`` (occurrences), ``n_words`` and ``features`` (buckets) of each distinct segment that has words."""
    found = df.select(F.explode(segments(text)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    made = let(words("line"), lambda w: F.struct(F.size(w).alias("n_words"), runs_of(w, most, buckets).alias("features")))
    made = found.filter(F.col("line").rlike(WORD)).select(digest("line").alias("seg"), "n", made.alias("made"))
    return made.select("seg", "n", "made.n_words", "made.features")


def _counts(weighted: DataFrame) -> DataFrame:
    """``bucket`` and ``count`` from rows of ``n`` and ``features``."""
    return weighted.select("n", F.explode("features").alias("bucket")).groupBy("bucket").agg(F.sum("n").alias("count"))


def bucket_counts(distinct: DataFrame, crossing: DataFrame | None) -> DataFrame:
    """Features of all occurrences of the distinct segments by bucket, and those of n-grams across segments."""
    counts = _counts(distinct)
    if crossing is None:
        return counts
    return counts.unionByName(_counts(crossing.select(F.lit(1).cast("long").alias("n"), "features"))).groupBy("bucket").agg(F.sum("count").alias("count"))


def gain_table(corpus: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """``floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets))))`` of every bucket; sizes hang on ``buckets`` alone."""
    both = corpus.select("bucket", F.col("count").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("count").alias("t")))
    both = written(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resampling-counts")
    totals = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    gain = _gain(F.col("s"), F.col("t"), *totals, buckets)
    out = [both.sparkSession.range(1).select(_gain(F.lit(0), F.lit(0), *totals, buckets)).first()[0]] * buckets
    for r in both.select("bucket", gain.alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def _gain(s: Column, t: Column, all_s: int, all_t: int, buckets: int) -> Column:
    d = lambda c: c.cast("double")
    over = d(t + 1) * d(F.lit(all_s + buckets))
    return F.floor(F.lit(1000.0) * F.ln(over / (d(s + 1) * d(F.lit(all_t + buckets))))).cast("long")


def floored(total: Column, n: Column) -> Column:
    """``total / n`` rounded down, in integers; 0 for none."""
    n_or_one = F.greatest(n, F.lit(1))
    return F.when(n > 0, F.call_function("div", total - F.pmod(total, n_or_one), n_or_one)).otherwise(0).cast("long")


def noise(key: str, seed: int) -> Column:
    """Gumbel noise of a key, in floored thousandths; equal for equal keys."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def earlier(count: str, order) -> Column:
    """Sum of ``count`` over the rows before."""
    return F.coalesce(F.sum(count).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """``scored`` (``key``, ``n_features``, ``n_words``, ``weight``, ``score``) with ``rank`` of those drawn.

    Equal rows are counted instead of sorted. A histogram of scores, whose range is bounded, gives the rank before each
    score; documents are ordered only among those with their own score, and only where the draw may reach them.
    """
    rows = scored.groupBy("key", "n_features", "n_words", "weight", "score").agg(F.count("*").alias("copies"))
    rows = written(rows, "resampling-scores")
    fit = rows.filter(F.col("n_words") >= least_words)
    hist = fit.groupBy("score").agg(F.sum("copies").alias("own")).withColumn("coarse", F.floor(F.col("score") / COARSE))
    hist = written(hist, "resampling-histogram")
    coarse = hist.groupBy("coarse").agg(F.sum("own").alias("own"))
    coarse = coarse.select("coarse", earlier("own", Window.orderBy(F.desc("coarse"))).alias("earlier"))
    within = hist.select("coarse", "score", earlier("own", Window.partitionBy("coarse").orderBy(F.desc("score"))).alias("before"))
    drawn = (hist.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0] * percent) // 100
    places = within.join(coarse, "coarse").select("score", (F.col("before") + F.col("earlier")).alias("before")).filter(F.col("before") < drawn)
    places = written(places, "resampling-places")
    reached = keyed_join(fit, places, "score", "inner")
    order = Window.partitionBy("score").orderBy(F.col("key").asc_nulls_last(), "n_features", "n_words", "weight")
    reached = reached.withColumn("first", F.col("before") + earlier("copies", order) + 1)
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("place")
    reached = reached.select("key", "n_features", "weight", "score", each)
    reached = reached.select("key", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    rest = rows.filter(F.col("n_words") < least_words).unionByName(keyed_join(fit, places, "score", "left_anti").select(rows.columns))
    rest = rest.select("key", "n_features", "weight", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("place"))
    return reached.unionByName(rest.select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resample(
    df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1, buckets: int = 10_000,
    least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1; null if not drawn) of every row of ``df``.

    Features are the runs of 1 to ``most`` words of whole texts; null texts and texts without words have none and the
    weight 0. Of the rows with at least ``least_words`` words ``percent`` in a hundred are drawn, highest scores first,
    ties to smaller keys, null keys (hashed as the empty text) last; repeated rows are rows of their own and take
    following ranks. Other columns of ``df`` and ``target`` are not read, whatever their names. An empty ``df`` gives
    an empty result; an empty ``target`` gives gains from the corpus alone.
    """
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    lines = segments("text")
    parts = F.transform(F.filter(lines, lambda s: s.rlike(WORD)), lambda s: digest(s))
    across = crossing_features(lines, most, buckets) if most > 1 else F.array().cast("array<int>")
    rows = written(docs.select("row", "key", parts.alias("parts"), across.alias("features")), "resampling-rows")
    distinct = written(distinct_segments(docs, "text", most, buckets), "resampling-segments")
    aim = distinct_segments(target, f"`{text}`", most, buckets)
    reach = target.select(crossing_features(segments(f"`{text}`"), most, buckets).alias("features")) if most > 1 else None
    gains = gain_table(bucket_counts(distinct, rows if most > 1 else None), bucket_counts(aim, reach), buckets)
    # One literal: the optimizer folds it once.
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<long>")
    total = lambda features: F.aggregate(features, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table, b + 1))
    worth = distinct.select("seg", "n_words", F.size("features").alias("f"), total(F.col("features")).alias("g"))
    worth = written(worth, "resampling-gains")
    own = rows.select("row", "key", "parts", F.size("features").alias("f0"), total(F.col("features")).alias("g0"))
    met = keyed_join(own.select("row", "key", "f0", "g0", F.explode("parts").alias("seg")), worth, "seg", "inner", FEW_SEGMENTS)
    some = met.groupBy("row", "key", "f0", "g0").agg(F.sum("n_words").alias("n_words"), F.sum("f").alias("f"), F.sum("g").alias("g"))
    some = some.select("key", "n_words", (F.col("f") + F.col("f0")).alias("n_features"), (F.col("g") + F.col("g0")).alias("gain"))
    zero = F.lit(0).cast("long")
    none = own.filter(F.size("parts") == 0).select("key", zero.alias("n_words"), zero.alias("n_features"), zero.alias("gain"))
    scored = some.unionByName(none).withColumn("weight", floored(F.col("gain"), F.col("n_features")))
    scored = scored.select("key", "n_features", "n_words", "weight", (F.col("weight") + noise("key", seed)).alias("score"))
    return ranked(scored, least_words, percent).withColumnRenamed("key", key)
