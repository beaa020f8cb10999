"""Helpers of the training-data operators: column passes over Arrow batches, written cut points, keyed lookups."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docaudit.session import shared_folder, ship_package

#: Rows of a group that one task is dealt, and tasks of a group at most.
GROUP_ROWS = 200
SALTS = 1_000


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns of these names, whatever their case: new columns replace old ones."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def append_columns(df: DataFrame, inputs: Sequence[str], fields: list[T.StructField], fn: Callable[..., list[pa.Array]], rows: int | None = None) -> DataFrame:
    """All columns of ``df`` and those that ``fn`` makes of Arrow batches of ``inputs``; one narrow pass.

    ``rows`` cuts the batches, where the new columns take much more memory than the old ones.
    """
    ship_package(df.sparkSession)
    base = without(df, [f.name for f in fields])
    schema = T.StructType([*base.schema.fields, *fields])
    at = [base.columns.index(c) for c in inputs]
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, rows or whole.num_rows) for whole in batches for i in range(0, whole.num_rows, rows or max(1, whole.num_rows))):
            made = [x.cast(f.type) if x.type != f.type else x for x, f in zip(fn(*[b.column(i) for i in at]), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)

    return base.mapInArrow(run, schema)


#: Paths of the tables written within the innermost ``scratch``.
_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read again by whatever executor is left."""
    path = shared_folder(df.sparkSession, name)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(path: str) -> None:
    files, inner = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))
    if files.get_file_info(inner).type != pafs.FileType.NotFound:
        files.delete_dir(inner)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that a written table has replaced.

    It deletes them once the driver's JVM has collected the frames, which a driver with little to do may never do.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the given function writes: they replace the others
    and belong to the ``scratch`` around this one, if there is any.

    Nothing read after the block may hang on a deleted table.
    """
    paths: list[str] = []
    around = _SCRATCH.get()
    token = _SCRATCH.set(paths)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inside = _SCRATCH.set(around)
        try:
            return written(df, name)
        finally:
            _SCRATCH.reset(inside)

    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            _delete(path)


def spread_join(rows: DataFrame, lookup: DataFrame, on: str, size: str, spread: Column, how: str = "left") -> DataFrame:
    """Join to ``lookup`` (one row a key) where both sides know the ``size`` of each key's group of rows.

    A group goes to one task for every ``GROUP_ROWS`` of its rows, at most ``SALTS``; its lookup row is repeated as often.
    """
    tasks = F.least(F.lit(SALTS), F.ceil(F.col(size) / GROUP_ROWS)).cast("int")
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), tasks).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), tasks - 1))).drop(size)
    return left.join(right, [on, "_salt"], how).drop("_salt")


#: Rows of a written lookup up to which it may be broadcast.
FEW_ROWS = 200_000


def keyed_join(rows: DataFrame, lookup: DataFrame, on: str, how: str = "left", few: int = FEW_ROWS) -> DataFrame:
    """Join to a written ``lookup`` (one row a key): broadcast if it has few rows by count.

    Else both sides are shuffled straight into the join, and adaptive execution splits the partition of a hot key.
    """
    return rows.join(F.broadcast(lookup) if lookup.count() <= few else lookup, on, how)
