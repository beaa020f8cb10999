"""Where the labels of a whole catalogue stand in a document: one automaton, one walk over each line.

A checklist of a few labels is searched label by label. A catalogue has hundreds, of which a document holds a handful;
its labels are built into one Aho-Corasick automaton a worker, so a line is read once whatever their number, and only
lines that hold a label meet that label's patterns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.functions.text import let
from docaudit.session import ship_package

from .extraction import text_lines

#: Labels that the workers are given at most; the search label by label serves larger catalogues.
MOST_LABELS = 1_000_000


def label_automaton(labels: Sequence[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for label in labels:
        if label:
            found.add_word(label, label)
    if len(found):
        found.make_automaton()
    return found


def places_of(lines: Sequence[str], automaton: ahocorasick.Automaton) -> dict[str, list[int]]:
    """Numbers of the lines that hold each label, in order; labels that stand nowhere are left out."""
    out: dict[str, list[int]] = {}
    for at, line in enumerate(lines if len(automaton) else ()):
        for label in {hit for _, hit in automaton.iter(line)}:
            out.setdefault(label, []).append(at)
    return out


def label_places(df: DataFrame, labels: Sequence[str], blocks: str = "blocks", out: str = "label_places") -> DataFrame:
    """``df`` with a map from each label (lower case, as in the compiled fields) to the numbers of the lines that hold it.

    Lines are those of ``extraction.text_lines``. Documents without blocks get an empty map.
    """
    ship_package(df.sparkSession)
    wanted = sorted(set(labels))
    rows = df.select(*[c for c in df.columns if c != out], let(F.col(blocks), lambda b: F.transform(text_lines(b), lambda x: x["low"])).alias(out))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))])
    kind = pa.map_(pa.string(), pa.list_(pa.int32()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = label_automaton(wanted)
        for b in batches:
            found = [list(places_of(x.as_py() or (), automaton).items()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=schema.names)

    # A pass of its own: a Python function could be moved into a lambda of a later column, where it cannot run.
    return rows.mapInArrow(walk, schema)


def catalogue_labels(compiled: DataFrame) -> list[str] | None:
    """Distinct labels of a compiled catalogue, or None if they are more than ``MOST_LABELS``."""
    each = compiled.select(F.explode("spec.fields").alias("f")).select(F.explode("f.labels.label").alias("label")).distinct()
    found = [r["label"] for r in each.limit(MOST_LABELS + 1).collect()]
    return found if len(found) <= MOST_LABELS else None
