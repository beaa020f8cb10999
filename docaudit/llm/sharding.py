"""Sharding by a k-d tree over document metadata.

The space of a few metadata dimensions is split again and again at a weighted median along the dimension that is
widest in the node, until there are as many leaves as the target bytes ask for. A split is a point on the line
(value of the dimension, tie-breaking hash), so that one value held by a third of all rows can still be split. The
median is found by distributed histograms: bytes are summed by node and bin between the smallest and the largest
value, and only the bin in which the median lies is binned again. All nodes of a depth are split by the same jobs.
The driver sees bins and split points, whose number depends on the leaves and never on the rows. Only DataFrame
functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bins of a node in one histogram.
BINS = 1024
#: A boundary bin that holds at most this part of a leaf's bytes need not be split further.
TOLERANCE = 1 / 2000
#: Rows that are numbered by one task, about.
SLOT_ROWS = 1_000


@dataclass
class Node:
    """A leaf ``first``..``first + leaves - 1``, or a split of it: rows up to (``value``, ``tie``) go left."""

    first: int
    leaves: int
    dim: int | None = None
    value: int = 0
    tie: int = 0
    left: Node | None = None
    right: Node | None = None


def dimension(column: str, dtype: str) -> Column:
    """A long in [0, 2^40) for a metadata column: logarithm of numbers, hash of texts; null is 0."""
    c = F.col(column)
    if dtype == "string":
        return F.coalesce(F.shiftleft(F.crc32(c.cast("binary")), 8), F.lit(0)).cast("long")
    return F.coalesce((F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1) * (1 << 33)).cast("long"), F.lit(0))


def tree_column(node: Node, leaf) -> Column:
    """Expression that walks a row down the tree to ``leaf(node)``."""
    if node.dim is None:
        return leaf(node)
    v, t = F.col(f"_d{node.dim}"), F.col("_tie")
    goes_left = (v < node.value) | ((v == node.value) & (t <= node.tie))
    return F.when(goes_left, tree_column(node.left, leaf)).otherwise(tree_column(node.right, leaf))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.dim is None else _leaves(node.left) + _leaves(node.right)


def _medians(rows: DataFrame, wanted: dict[int, tuple[int, float]], tolerance: float) -> dict[int, tuple[int, int]]:
    """For each node, ``(dimension, bytes to the left)`` -> the split point ``(value, tie)``; rows have ``_node``.

    First bins of the dimension are refined and then, if one value straddles the median, bins of its ties.
    """
    top = (1 << 62) - 1
    state = {k: {"dim": d, "need": need, "value": None, "lo": None, "hi": None} for k, (d, need) in wanted.items()}
    dims = {k: F.col(f"_d{s['dim']}") for k, s in state.items()}
    done: dict[int, tuple[int, int]] = {}
    while state:
        key = F.coalesce(*[F.when(F.col("_node") == k, dims[k] if s["value"] is None else F.col("_tie")) for k, s in state.items()])
        inside = reduce(
            lambda a, b: a | b,
            [(F.col("_node") == k) & (F.lit(True) if s["value"] is None else dims[k] == s["value"]) & (F.lit(True) if s["lo"] is None else F.col("_key").between(s["lo"], s["hi"])) for k, s in state.items()],
        )
        found = rows.withColumn("_key", key).filter(inside)
        if any(s["lo"] is None for s in state.values()):
            for r in found.groupBy("_node").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect():
                if state[r["_node"]]["lo"] is None:
                    state[r["_node"]] |= {"lo": r["lo"], "hi": r["hi"]}
            continue
        # Width of a bin and lowest key by node; keys are below 2^62, so the division stays exact.
        step = F.coalesce(*[F.when(F.col("_node") == k, F.lit((s["hi"] - s["lo"]) // BINS + 1)) for k, s in state.items()])
        low = F.coalesce(*[F.when(F.col("_node") == k, F.lit(s["lo"])) for k, s in state.items()])
        bins = found.withColumn("_step", step).withColumn("_low", low).withColumn("_bin", F.expr("(_key - _low) div _step"))
        got: dict[int, list] = {}
        for r in bins.groupBy("_node", "_bin").agg(F.sum("_size").alias("sum"), F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect():
            got.setdefault(r["_node"], []).append(r)
        for k, s in list(state.items()):
            before, below = 0, None
            for r in sorted(got[k], key=lambda r: r["_bin"]):
                if before + r["sum"] > s["need"] or r is max(got[k], key=lambda r: r["_bin"]):
                    break
                before, below = before + r["sum"], r["hi"]
            s["need"] -= before
            if r["lo"] < r["hi"] and r["sum"] > tolerance:
                s |= {"lo": r["lo"], "hi": r["hi"]}
            elif r["lo"] == r["hi"] and s["value"] is None and r["sum"] > tolerance:
                s |= {"value": r["lo"], "lo": None, "hi": None}
            else:  # the whole bin goes to the nearer side
                at = r["hi"] if s["need"] * 2 >= r["sum"] else below if below is not None else r["lo"] - 1
                done[k] = (at, top) if s["value"] is None else (s["value"], at)
                del state[k]
    return done


def build(rows: DataFrame, n_dims: int, shards: int, total: int) -> Node:
    """The tree with ``shards`` leaves over rows with ``_d0``.. , ``_tie`` and ``_size``."""
    root = Node(0, shards)
    while open_ := {n.first: n for n in _leaves(root) if n.leaves > 1}:
        # A finished leaf takes no more part; its number is no key of open_.
        marked = rows.withColumn("_node", tree_column(root, lambda n: F.lit(n.first if n.leaves > 1 else None).cast("int"))).filter("_node IS NOT NULL")
        ranges = [f(f"_d{i}").alias(f"{name}{i}") for i in range(n_dims) for name, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["_node"]: r for r in marked.groupBy("_node").agg(F.sum("_size").alias("sum"), *ranges).collect()}
        if root.dim is None:
            spread = [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) for i in range(n_dims)] if stats else [1] * n_dims
        wanted = {}
        for k, n in open_.items():
            if k in stats:
                r = stats[k]
                widest = max(range(n_dims), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / spread[i], -i))
                wanted[k] = (widest, r["sum"] * (n.leaves // 2) / n.leaves)
        points = _medians(marked, wanted, TOLERANCE * total / shards) if wanted else {}
        for k, n in open_.items():
            n.dim, (n.value, n.tie) = (wanted[k][0] if k in wanted else 0), points.get(k, (0, 0))
            n.left, n.right = Node(k, n.leaves // 2), Node(k + n.leaves // 2, n.leaves - n.leaves // 2)
    return root


def numbered(rows: DataFrame, group: str, order: list[str], count: int) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2.. within each group, by pieces that hold ``SLOT_ROWS`` rows or so.

    ``count`` is the number of rows. Pieces are cut by a hash; each is numbered on its own, and running totals of
    the pieces' sizes give each its first number. No task holds a whole group.
    """
    pieces = max(1, math.ceil(count / SLOT_ROWS))
    cut = rows.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(pieces)))
    sizes = cut.groupBy(group, "_piece").agg(F.count("*").alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(*order)) - 1
    return cut.withColumn("_at", at).join(sizes.withColumn("_first", first).drop("_n"), [group, "_piece"]).withColumn("slot", F.col("_first") + F.col("_at")).drop("_at", "_first", "_piece")


def shard(
    df: DataFrame, size: Column, key: str = "doc_id", dims: tuple[str, ...] = ("n_chars", "lang", "source"),
    target_bytes: int | None = None, shards: int | None = None, keep: dict[str, Column] | None = None,
) -> DataFrame:
    """``key``, ``size``, the columns ``keep``, ``shard`` and ``slot`` of every row.

    The number of shards is given, or follows from ``target_bytes`` a shard. Shards hold nearly the same bytes. The
    key is one more dimension (by hash) and breaks ties; rows equal in key and all dimensions stay together. Null
    counts as the lowest value of a dimension. An empty table gives no rows. ``slot`` is gapless in each shard. Only
    narrow columns are written and read again by the histograms, never texts.
    """
    if (target_bytes is None) == (shards is None):
        raise ValueError("give either target_bytes or shards")
    kinds = dict(df.dtypes)
    keep = keep or {}
    axes = [dimension(c, kinds[c]) for c in dims]
    # The key's own axis is its hash; bits further down break ties between rows of one key hash.
    axes.append(F.shiftrightunsigned(F.xxhash64(F.col(key)), 24))
    rows = written(
        df.select(
            F.col(key).alias("_key_of_row"), size.cast("long").alias("_size"), *[c.alias(f"_keep_{n}") for n, c in keep.items()],
            *[a.alias(f"_d{i}") for i, a in enumerate(axes)], F.shiftrightunsigned(F.xxhash64(F.col(key), *dims), 2).alias("_tie"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    leaves = shards or max(1, math.ceil(total["bytes"] / target_bytes))
    tree = build(rows.select("_size", "_tie", *[f"_d{i}" for i in range(len(axes))]), len(axes), leaves, total["bytes"])
    placed = rows.withColumn("shard", tree_column(tree, lambda n: F.lit(n.first)).cast("int"))
    placed = placed.select("_key_of_row", "_size", *[f"_keep_{n}" for n in keep], "shard", "_tie")
    out = numbered(placed, "shard", ["_tie", "_key_of_row", *[f"_keep_{n}" for n in keep]], total["rows"] // leaves)
    return out.select(F.col("_key_of_row").alias(key), F.col("_size").alias("size"), *[F.col(f"_keep_{n}").alias(n) for n in keep], "shard", F.col("slot").cast("long").alias("slot"))
