"""Grouping and de-duplication of array elements, by sorting: ``n log n`` in the array's length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, let


def each(items: Column | Sequence, body: Callable, typ: str | None = None) -> Column:
    """``transform`` of an array, or an array with an element for each item known when the query is planned.

    ``typ`` is the type of the array where there may be no item.
    """
    if isinstance(items, Column):
        return F.transform(items, body)
    return F.array(*map(body, items)) if items else F.array().cast(typ)


def any_of(items: Column | Sequence, test: Callable) -> Column:
    """``exists`` over an array or over items known when the query is planned."""
    if isinstance(items, Column):
        return F.exists(items, test)
    found = F.lit(False)
    for x in items:
        found = found | test(x)
    return found


def _sorted_keys(arr: Column, key: Callable[[Column], Column]) -> Column:
    return F.sort_array(F.transform(arr, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))


def _opens(keys: Column, k: Column, n: Column) -> Column:
    return (n == 0) | ~F.get(keys, n - 1)["k"].eqNullSafe(k["k"])


def distinct_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """First element of each key, in the original order."""

    def marked(keys: Column) -> Column:
        return F.sort_array(F.transform(keys, lambda k, n: F.struct(k["i"], _opens(keys, k, n).alias("opens"))))

    # Unlike ``transform``, ``filter`` does not copy the elements.
    return let(let(_sorted_keys(arr, key), marked), lambda marks: F.filter(arr, lambda _, i: F.get(marks, i)["opens"]))


def grouped_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """Elements of each key as an array; groups in the order of their first element."""

    def cut(keys: Column) -> Column:
        def groups(starts: Column) -> Column:
            members = F.transform(
                starts, lambda s, j: F.slice(keys, s + 1, F.coalesce(F.get(starts, j + 1), F.size(keys)) - s)["i"]
            )
            return F.transform(F.sort_array(members), lambda ix: F.transform(ix, lambda i: F.get(arr, i)))

        return let(compact(F.transform(keys, lambda k, n: F.when(_opens(keys, k, n), n))), groups)

    return let(_sorted_keys(arr, key), cut)
