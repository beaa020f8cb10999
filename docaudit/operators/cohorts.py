"""Tags and cohorts over the run history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import blank_to_null, let, strip

TAG_REQUIREMENTS = "array<struct<key:string,value:string>>"


def normalized_tags(raw: Column) -> Column:
    """JSON object or list of ``{key, value}`` to a tag map.

    Keys and values are trimmed, blank keys dropped, blank values NULL, the last repeat of a key wins. Items of a
    list that are no objects are skipped. The text is parsed once.
    """
    empty = F.array().cast(TAG_REQUIREMENTS)
    items = F.from_json(raw, "array<string>")

    def from_list(values: Column) -> Column:
        parsed = F.transform(F.filter(values, lambda x: strip(x).startswith("{")), lambda x: F.from_json(x, "struct<key:string,value:string>"))
        return F.filter(parsed, lambda p: p.isNotNull())

    # A map keeps the members of an object in the order of the text, repeats included.
    pairs = F.coalesce(F.when(strip(raw).startswith("["), let(items, from_list)).otherwise(let(F.from_json(raw, "map<string,string>"), F.map_entries)), empty)
    tidy = F.filter(
        F.transform(pairs, lambda p: F.struct(strip(p["key"]).alias("key"), blank_to_null(p["value"]).alias("value"))),
        lambda p: F.coalesce(p["key"], F.lit("")) != "",
    )

    def last_wins(ps: Column) -> Column:
        back = F.reverse(ps)
        return F.map_from_entries(
            F.filter(back, lambda p, i: F.array_position(F.transform(back, lambda q: q["key"]), p["key"]) == i + 1)
        )

    return let(tidy, last_wins)


def normalize_tags(df: DataFrame, raw: str = "raw", out: str = "attributes") -> DataFrame:
    return df.withColumn(out, normalized_tags(F.col(raw)))


def tags_match(tags: Column, requirements: Column) -> Column:
    """Every required key is present and, where a value is asked for, carries it."""

    def holds(r: Column) -> Column:
        key = strip(F.coalesce(r["key"], F.lit("")))
        present = F.array_contains(F.map_keys(tags), key)
        same = r["value"].isNull() | F.coalesce(F.try_element_at(tags, key) == strip(r["value"]), F.lit(False))
        return (key == "") | (present & same)

    return F.forall(requirements, holds)


@dataclass(frozen=True)
class Cohort:
    """A saved view of the run history."""

    id: str
    project_id: str | None = None
    schema_key: str = ""
    version_label: str = ""
    outcomes: tuple[str, ...] = ()
    tags: tuple[tuple[str, str | None], ...] = field(default=())
    threshold: float = 100.0

    def predicate(self) -> Column:
        """Plain conjunction: equalities reach the scan, the tag test runs on what is left."""
        cond = F.lit(True)
        if self.project_id:
            cond = cond & (F.col("project_id") == self.project_id)
        if self.schema_key.strip():
            cond = cond & (F.col("schema_key") == self.schema_key.strip())
        if self.version_label.strip():
            cond = cond & (F.col("version_label") == self.version_label.strip())
        if self.outcomes:
            cond = cond & F.col("outcome").isin(*self.outcomes)
        for key, wanted in self.tags:
            if not key.strip():
                continue
            tags = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
            cond = cond & F.array_contains(F.map_keys(tags), key.strip())
            if wanted is not None:
                cond = cond & (F.try_element_at(tags, F.lit(key.strip())) == wanted.strip())
        return cond


def filter_cohort(runs: DataFrame, cohort: Cohort) -> DataFrame:
    return runs.filter(cohort.predicate())


def _clamped(threshold: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), threshold.cast("double")))


def _with_rate(df: DataFrame, threshold: Column) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.col("pass_count"), F.col("total")) * 100.0, F.lit(0.0))
    return df.withColumns(
        {
            "pass_rate_pct": F.round(rate, 2),
            "pass_threshold_pct": _clamped(threshold),
            "meets_threshold": (F.col("total") > 0) & (rate >= _clamped(threshold)),
        }
    )


def _counts() -> list[Column]:
    return [
        F.count("*").alias("total"),
        *(F.count_if(F.col("outcome") == o).alias(f"{o.lower()}_count") for o in ("PASS", "FAIL", "AMBIGUOUS")),
    ]


def aggregate_outcomes(runs: DataFrame, threshold: float | Column = 100.0, by: Sequence[str] = ()) -> DataFrame:
    """Counts, pass rate and whether it meets the threshold (decided on the unrounded rate)."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return _with_rate(runs.groupBy(*by).agg(*_counts()), limit)


def evaluate_cohort(runs: DataFrame, cohort: Cohort) -> tuple[DataFrame, DataFrame]:
    """Aggregate and matching rows. Both are lazy; each prunes to the columns it needs."""
    matching = filter_cohort(runs, cohort)
    return aggregate_outcomes(matching, cohort.threshold), matching


#: Counts of one tag of a project that one task meets with the cohorts filed under it; shares of an entry at most.
ENTRY_COUNTS, MOST_SHARES = 4_096, 1_000
_ENTRY = "struct<key:string,any:boolean,value:string>"


def _entry(key: Column, value: Column) -> Column:
    """A tag with a value, or any value where that is null."""
    return F.struct(key.alias("key"), value.isNull().alias("any"), F.coalesce(value, F.lit("")).alias("value")).cast(_ENTRY)


def _no_entry() -> Column:
    return _entry(F.lit(""), F.lit(None).cast("string"))


def _either(value: Column) -> Column:
    """The value and the wildcard."""
    return F.array_distinct(F.filter(F.array(value, F.lit("")), lambda v: v.isNotNull()))


def evaluate_cohorts(runs: DataFrame, cohorts: DataFrame) -> DataFrame:
    """All saved cohorts in one job; cohorts nothing matches stay with zeros.

    ``cohorts(id, project_id, schema_key, version_label, outcomes, tags, threshold)``. Runs are first
    counted per project, checklist, version, outcome and values of those tags that some cohort of the project asks
    for; a tag that differs for every run and is asked for by none makes no counts of its own.

    An index files each cohort under the tag that it requires and the fewest counts have, with its checklist and
    version, which may be wildcards. A count looks under each of its tags that is in the index, with its own checklist
    and version and with the wildcards in their place, so it meets only cohorts that ask for that very combination.
    Entries that many counts have are dealt to shares, and their cohorts repeated for each.
    """
    asked = cohorts.select("project_id", F.explode("tags").alias("t")).groupBy("project_id").agg(F.collect_set(strip("t.key")).alias("asked"))
    runs = runs.join(asked, "project_id", "left")
    entries = F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>")))
    tags = F.sort_array(F.filter(entries, lambda e: F.coalesce(F.array_contains("asked", e["key"]), F.lit(False))))
    counted = runs.groupBy(
        F.col("project_id").alias("project"), F.col("schema_key").alias("run_key"),
        F.col("version_label").alias("run_version"), F.col("outcome").alias("run_outcome"), tags.alias("run_tags"),
    ).agg(F.count("*").alias("n"))
    with_values = F.filter("run_tags", lambda e: e["value"].isNotNull())
    own = F.concat(
        F.array(_no_entry()),
        F.transform("run_tags", lambda e: _entry(e["key"], F.lit(None).cast("string"))),
        F.transform(with_values, lambda e: _entry(e["key"], e["value"])),
    )
    listed = counted.withColumn("entry", F.explode(own))
    sizes = listed.groupBy("project", "entry").agg(F.count("*").alias("size"))

    key, version = strip(F.coalesce("schema_key", F.lit(""))), strip(F.coalesce("version_label", F.lit("")))
    c = cohorts.select(F.col("id").alias("cohort_id"), F.col("project_id").alias("project"), key.alias("key"), version.alias("version"), "outcomes", "tags", "threshold")
    required = F.filter("tags", lambda t: strip(F.coalesce(t["key"], F.lit(""))) != "")
    wanted = F.when(F.size(required) > 0, F.transform(required, lambda t: _entry(strip(t["key"]), strip(t["value"])))).otherwise(F.array(_no_entry()))
    options = c.select("cohort_id", "project", F.explode(wanted).alias("entry")).join(sizes, ["project", "entry"], "left")
    rarest = options.groupBy("cohort_id").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "entry")).alias("r"))
    shares = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARES), F.ceil(F.col("r.size") / ENTRY_COUNTS))).cast("int")
    filed = c.join(rarest.select("cohort_id", "r.entry", shares.alias("shares")), "cohort_id")

    index = filed.select("project", "entry", "shares").distinct()
    met = listed.join(index, ["project", "entry"])
    met = met.withColumn("share", F.pmod(F.xxhash64("run_key", "run_version", "run_outcome", "run_tags"), F.col("shares")).cast("int")).drop("shares")
    met = met.withColumn("key", F.explode(_either(F.col("run_key")))).withColumn("version", F.explode(_either(F.col("run_version"))))
    copies = filed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    rest = ((F.size("outcomes") == 0) | F.array_contains("outcomes", F.col("run_outcome"))) & tags_match(F.map_from_entries("run_tags"), F.col("tags"))
    sums = met.join(copies, ["project", "entry", "key", "version", "share"]).filter(rest).groupBy("cohort_id").agg(
        F.sum("n").alias("total"),
        *(
            F.sum(F.when(F.col("run_outcome") == o, F.col("n")).otherwise(0)).alias(f"{o.lower()}_count")
            for o in ("PASS", "FAIL", "AMBIGUOUS")
        ),
    )
    names = ("total", "pass_count", "fail_count", "ambiguous_count")
    kept = c.select("cohort_id", "threshold").join(sums, "cohort_id", "left").withColumns(
        {n: F.coalesce(n, F.lit(0)) for n in names}
    )
    return _with_rate(kept, F.col("threshold")).drop("threshold")


def tag_vocabulary(runs: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Distinct ``(by…, tag_key, tag_value)`` of visible runs; a key without any value keeps a NULL row.

    Long form: a key may have as many values as there are runs, so they are never put into one array.
    """
    from .runs import visible

    pairs = visible(runs).select(*by, F.explode("attributes").alias("tag_key", "tag_value"))
    return _bare_keys_last(pairs.select(*by, "tag_key", F.nullif("tag_value", F.lit("")).alias("tag_value")), [*by, "tag_key"])


def _bare_keys_last(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct pairs; a NULL value only for keys that have no other.

    Every value also marks its key's NULL row as superfluous, so one aggregation does; the marks of a key combine
    before the shuffle.
    """
    value = F.col("tag_value")
    mark = lambda v, has: F.struct(v.cast("string").alias("v"), F.lit(has).alias("has"))
    none = F.lit(None)
    marks = F.when(value.isNotNull(), F.array(mark(value, True), mark(none, True))).otherwise(F.array(mark(none, False)))
    rows = pairs.select(*keys, F.explode(marks).alias("m")).groupBy(*keys, F.col("m.v").alias("tag_value")).agg(F.bool_or("m.has").alias("has"))
    return rows.filter("tag_value is not null or not has").drop("has")


def merge_vocabularies(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two vocabularies in long form; a bare key survives only where it has no value."""
    return _bare_keys_last(a.unionByName(b), [c for c in a.columns if c != "tag_value"])
