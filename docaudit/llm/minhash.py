"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's sketch holds the ``SKETCH`` smallest hashes of its distinct word shingles. Documents with equal sets
form one class and only one of them goes on. Inverted lists of the retained values give candidates. Values are
ranked by how many sketches hold them; two similar sketches share a value among the rarest few of each, so only
these are listed. The smallest values of the union of two sketches estimate their similarity, and pairs that pass
are verified on their full sets. Long lists are cut into blocks, whose full sets are compared as matrices; a block
returns a spanning forest of its links and never all pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.session import ship_package

from .common import keyed_join, written
from .components import components

SHINGLE_WORDS = 5
#: Retained hashes of a document.
SKETCH = 64
#: Links need 100 * intersection >= similarity * union; this similarity unless another is asked for.
SIMILARITY = 85
#: Inverted lists up to this length give pairs, longer ones blocks of this many sets and shingles.
SHORT_LIST = 24
BLOCK_SETS = 512
BLOCK_SHINGLES = 2_000_000
#: Ids up to this number may be broadcast to find their texts.
FEW_IDS = 1_000_000

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text in UTF-8; fewer words than a shingle are one."""
    hash_word = xxhash.xxh3_64_intdigest
    words = np.array([hash_word(w) for w in text.translate(LOWER).split()] if text else [], np.uint64)
    if not len(words):
        return np.zeros(0, np.int64)
    size = min(SHINGLE_WORDS, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ words[i : i + n]) * PRIME
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def sketches(df: DataFrame, key: str, text: str) -> DataFrame:
    """``doc``, ``n`` (size of the set), ``set`` (digest of the set, null if empty) and ``sketch`` of every row."""
    ship_package(df.sparkSession)
    schema = f"doc {dict(df.dtypes)[key]}, n long, set binary, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py()) for x in b.column(1)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            smallest = [s[:SKETCH] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in smallest])]).astype(np.int32)
            values = pa.array(np.concatenate([*smallest, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offsets, values)],
                names=["doc", "n", "set", "sketch"],
            )

    return df.select(F.col(key).alias("doc"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


def full_sets(df: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """``doc`` and ``shingles`` (its whole set) of the rows of ``df`` whose key is in ``ids``."""
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    rows = df.select(F.col(key).alias("doc"), F.col(text).cast("binary").alias("text")).join(ids, "doc", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py()) for x in b.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, values)], names=["doc", "shingles"])

    return rows.mapInArrow(run, f"doc {dict(df.dtypes)[key]}, shingles array<long>")


def least_shared(similarity: int) -> int:
    """Shared values among the ``SKETCH`` smallest of a union below which a pair is dropped.

    For a pair at the limit of similarity 85 they number 54.4 on average, with a deviation of 2.9; five deviations are
    given away (40 at 85, 35 at 80).
    """
    p = similarity / 100
    return max(1, round(SKETCH * p - 5 * (SKETCH * p * (1 - p)) ** 0.5))


def whole_size(similarity: int) -> int:
    """Sets up to this size make unions of less than ``SKETCH`` with any set they can be linked to: sketches are whole sets."""
    return SKETCH * similarity // 100


def linked(shared: Column, a: Column, b: Column, similarity: int) -> Column:
    return shared * 100 >= (a + b - shared) * similarity


def rare_prefixes(reps: DataFrame, similarity: int) -> DataFrame:
    """``v``, ``doc``, ``n``: the retained values by which a document may meet similar ones.

    Two linked sets share at least ``need`` retained values, so the rarest shared one is among the ``kept - need + 1``
    rarest of either. Values that one sketch alone holds are the rarest; they need no list.
    """
    values = reps.select("doc", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    common = written(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "minhash-common")
    need = F.when(F.col("n") <= whole_size(similarity), F.ceil(F.col("n") * similarity / 100)).otherwise(F.lit(least_shared(similarity)))
    found = values.join(common, "v").groupBy("doc", "n", "kept").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("ranked"))
    length = (F.col("kept") - need + 1) - (F.col("kept") - F.size("ranked"))
    return found.select("doc", "n", F.explode(F.slice("ranked", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("r")).select("r.v", "doc", "n")


def short_list_pairs(lists: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of lists of bounded length that pass the estimate from the union of their sketches."""
    a = lists.select("v", F.col("doc").alias("a"), F.col("n").alias("na"))
    b = lists.select("v", F.col("doc").alias("b"), F.col("n").alias("nb"))
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similarity) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "v").filter(fits).select("a", "b").distinct()
    sketch = reps.select("doc", "sketch")
    both = pairs.join(sketch.select(F.col("doc").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("doc").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    # A union below SKETCH is the union of the whole sets, so the estimate is the similarity itself.
    least = F.when(F.size(union) < SKETCH, F.ceil(F.size(union) * similarity / 100)).otherwise(least_shared(similarity))
    return both.filter(shared >= least).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are linked."""
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.filter(linked(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), similarity)).select("a", "b")


def forest(ids: np.ndarray, sets: list[np.ndarray], first: int, similarity: int) -> list[tuple]:
    """Links between ``ids[:first]`` and all ``ids``, but for those that others already imply.

    Intersections of all sets are products of 0/1 matrices over slices of the shingles that two or more sets share.
    """
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    common = np.bincount(column)[column] > 1
    row, column = row[common], column[common]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    shared = np.zeros((first, len(sets)), np.float32)
    step = 4_096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        part = np.zeros((len(sets), step), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        shared += part[:first] @ part.T
    size = np.array([len(s) for s in sets])
    shared = shared.astype(np.int64)
    hit = 100 * shared >= similarity * (size[:first, None] + size[None, :] - shared)
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(first):
        for j in np.flatnonzero(hit[i]).tolist():
            x, y = find(i), find(j)
            if x != y:
                parent[y] = x
                out.append((ids[i], ids[j]))
    return out


def long_list_links(lists: DataFrame, sets: DataFrame, kind: str, similarity: int) -> DataFrame:
    """Verified links within long lists. ``lists`` has ``v``, ``doc``, ``n``, ``docs`` and ``shingles`` of the list.

    A list of m sets makes about (m / block)^2 / 2 tasks' groups of two blocks each; every pair of the list meets.
    """
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = lists.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    units = placed.select("v", "doc", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("v", "doc", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    schema = f"a {kind}, b {kind}"

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("own").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        own = t.column("own").to_numpy()
        sets = [s.values.to_numpy() for s in t.column("shingles")]
        links = forest(t.column("doc").to_pylist(), sets, int(np.searchsorted(own, own[0], side="right")), similarity)
        a, b = zip(*links, strict=True) if links else ((), ())
        doc = t.schema.field("doc").type
        return pa.table({"a": pa.array(a, doc), "b": pa.array(b, doc)})

    return units.join(sets, "doc").groupBy("v", "i", "j").applyInArrow(run, schema).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Words are runs of characters other than ASCII white space after lower-casing A-Z. Null, empty and white texts
    have no shingle and are linked with nothing; so are rows without a key, whose component is null and which stay.
    Documents are linked from a Jaccard similarity of ``similarity`` hundredths on. A component is all documents reachable by links; its smallest key stays. Rows that repeat a key and its text
    share its fate. Keys are taken to stand for one text. Candidates are complete but for a chance of about one in a
    million for a pair at the very limit of similarity; every link is verified on full sets.
    """
    kind = dict(df.dtypes)[key]
    rows = written(sketches(df, key, text), "minhash-sketches")
    usable = rows.filter("set IS NOT NULL AND doc IS NOT NULL")
    classes = usable.groupBy("set").agg(F.min("doc").alias("doc"))
    classes = written(classes, "minhash-classes")
    reps = written(usable.join(classes, ["set", "doc"]).dropDuplicates(["doc", "set"]).select("doc", "n", "sketch"), "minhash-reps")
    lists = written(rare_prefixes(reps, similarity), "minhash-lists")
    lengths = written(lists.groupBy("v").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).filter("docs > 1"), "minhash-lengths")
    listed = lists.join(lengths, "v")
    pairs = written(short_list_pairs(listed.filter(F.col("docs") <= SHORT_LIST), reps, similarity), "minhash-pairs")
    long_lists = written(listed.filter(F.col("docs") > SHORT_LIST), "minhash-long")
    ids = written(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).union(long_lists.select("doc")).distinct(), "minhash-ids")
    sets = written(full_sets(df, ids, key, text).dropDuplicates(["doc"]), "minhash-sets")
    links = written(verified(pairs, sets, similarity).unionByName(long_list_links(long_lists, sets, kind, similarity)), "minhash-links")
    roots = components(links)
    fate = classes.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("set", F.coalesce("root", "doc").alias("component"))
    fate = written(fate, "minhash-fate")
    out = keyed_join(rows.select("doc", "n", "set"), fate, "set")
    component = F.coalesce(F.when(F.col("doc").isNotNull(), F.col("component")), F.col("doc"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
