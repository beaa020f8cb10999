"""Exact top-k inner-product search with MaxScore over shards.

A dimension is a term, and a vector's component its impact. Within a shard the contribution of a term to a query's
score lies between two bounds. Terms are ordered by how far these bounds lie apart; those whose bounds together
cannot lift a vector over the current k-th score are non-essential. The postings of the essential terms are
traversed for all vectors of the shard, and the others are probed, widest first, only for vectors that are still
competitive. The best of every shard are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.session import ship_package

#: Vectors of a shard and queries of a block, about; a task holds one of each.
SHARD_ROWS = 4_096
BLOCK_QUERIES = 2_048
#: Non-essential terms that are probed before vectors are dropped again.
PROBED = 8

FOUND = "query_id long, vec_id long, score long"


def quantised(vector: str | Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component; null if the vector is null or holds a null or non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")), F.lit(False)))
    return F.when(fine, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Shard:
    """Impacts of one shard by term, and the range of each term's impacts."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.impacts = ids[order], np.asfortranarray(impacts[order])
        self.low, self.high = self.impacts.min(axis=0), self.impacts.max(axis=0)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best ids and scores but for ``own``, ties to smaller ids."""
        width = self.impacts.shape[1]
        ends = np.stack([query[:width] * self.low, query[:width] * self.high])
        most, gap = ends.max(axis=0), np.abs(ends[1] - ends[0])
        terms = np.argsort(gap, kind="stable")
        # A first k-th score from the vectors that score best by the widest terms alone.
        rows = np.flatnonzero(self.ids != own)
        if len(rows) <= k:
            return self._best(rows, self._score(rows, query, terms), k)
        head = terms[-PROBED:]
        part = self._score(rows, query, head)
        first = rows[np.argpartition(part, len(rows) - k)[-k:]]
        floor = self._score(first, query, terms).min()
        # rest[i]: what the i narrowest terms can give at most. The essential terms are the others, for the largest
        # i at which a vector with the least impact in every essential term cannot compete.
        rest = np.concatenate([[0], np.cumsum(most[terms])])
        least = ends.min(axis=0)[terms]
        reach = rest[1:] + (least.sum() - np.cumsum(least))
        split = min(int(np.searchsorted(reach >= floor, True)), width - len(head)) if width > len(head) else 0
        todo = terms[:split]
        score = part + self._score(rows, query, terms[split : width - len(head)]) if width > len(head) else part
        while True:
            alive = score + rest[len(todo)] >= floor
            rows, score = rows[alive], score[alive]
            if not len(todo):
                break
            todo, probe = todo[:-PROBED], todo[-PROBED:]
            score = score + self._score(rows, query, probe)
        return self._best(rows, score, k)

    def _score(self, rows: np.ndarray, query: np.ndarray, terms: np.ndarray) -> np.ndarray:
        return self.impacts[np.ix_(rows, terms)] @ query[terms] if len(terms) else np.zeros(len(rows), self.impacts.dtype)

    def _best(self, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    flat = column.combine_chunks()
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat.flatten().to_numpy()
    return out


def _exact(vectors: np.ndarray, queries: np.ndarray) -> type:
    """A type in which all scores are exact: floating point where they stay below 2^53, else Python integers."""
    size = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    return np.float64 if size(vectors) * size(queries) * max(1, vectors.shape[1]) < 1 << 53 else object


def search_block(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The ``k`` best vectors of one shard for each query of one block; tables of ``id`` and ``vector``."""
    out: list[list] = [[], [], []]
    if vectors.num_rows and queries.num_rows:
        width = max(int(np.diff(t.column("vector").combine_chunks().offsets.to_numpy()).max()) for t in (vectors, queries))
        v, q = (_matrix(t.column("vector"), width) for t in (vectors, queries))
        kind = _exact(v, q)
        shard = Shard(vectors.column("id").to_numpy(), v.astype(kind))
        for own, query in zip(queries.column("id").to_pylist(), q.astype(kind), strict=True):
            ids, scores = shard.search(own, query, k)
            out[0] += [own] * len(ids)
            out[1] += ids.tolist()
            out[2] += [int(s) for s in scores]
    return pa.table([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in FOUND.split(", ")])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the ``k`` largest integer inner products of each query.

    Both frames have ``id`` (long) and ``vector`` (array of long). A vector with the query's id is its own and left
    out. Ties go to the smaller id; with fewer vectors there are fewer rows. Null ids and null vectors take no part,
    shorter vectors count as filled up with zeros, and rows that repeat a query's id are one query; repeated vectors
    each take a rank. Every query meets every shard: shards and query blocks are dealt by hash, so no value is hot.
    """
    ship_package(vectors.sparkSession)
    vectors = vectors.filter("id IS NOT NULL AND vector IS NOT NULL")
    queries = queries.filter("id IS NOT NULL AND vector IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    counts = vectors.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    shards, blocks = (max(1, -(-n // size)) for n, size in zip(counts, (SHARD_ROWS, BLOCK_QUERIES), strict=True))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Vectors that share an id are dealt by content too.
    left = vectors.select("id", "vector", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    right = queries.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_block(a, b, k)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
