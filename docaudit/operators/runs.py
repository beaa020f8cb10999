"""Run history: filters, pages, lifecycle, corrections, revisions, dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.text import strip
from docaudit.functions.values import strict_number

#: Rows of a history page, and recent runs of a project on the dashboard, unless asked otherwise.
PAGE_ROWS, RECENT_RUNS = 25, 8


def visible(runs: DataFrame, include_hidden: bool = False) -> DataFrame:
    """Runs neither archived nor deleted; plain column tests, pushed to the scan."""
    return runs if include_hidden else runs.filter(F.col("archived_at").isNull() & F.col("deleted_at").isNull())


def filter_runs(
    runs: DataFrame, schema_key: str | None = None, version_label: str | None = None, outcome: str | None = None,
    filename: str | None = None,
) -> DataFrame:
    """Equality filters and a case-insensitive literal substring of the file name."""
    for column, wanted in (("schema_key", schema_key), ("version_label", version_label), ("outcome", outcome)):
        if wanted:
            runs = runs.filter(F.col(column) == wanted)
    if filename and filename.strip():
        runs = runs.filter(F.lower("document_filename").contains(filename.strip().lower()))
    return runs


def page_runs(runs: DataFrame, page: int = 1, size: int = PAGE_ROWS, after: tuple | None = None) -> DataFrame:
    """``size`` runs, newest first, ties by id, from per-partition top rows; nothing is sorted whole.

    ``after`` (creation time and id of the last row seen) starts below that row: then the cost of a page does not
    grow with its depth, as it does with a page number.
    """
    size = max(size, 1)
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        runs = runs.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > last)))
    return runs.orderBy(F.desc("created_at"), F.asc("id")).offset((max(page, 1) - 1) * size).limit(size)


def count_runs(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total"))


def apply_lifecycle(runs: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """Derive the state from appended ``events(key, action, ts, seq)``; the latest effect wins.

    archive / unarchive touch ``archived_at``, delete touches ``deleted_at``, restore clears both.
    ``max_by`` combines on the map side, so a run with very many events is no hot spot.
    """
    at = F.struct("ts", "seq")
    action = F.col("action")
    on_archive, on_delete = action.isin("archive", "unarchive", "restore"), action.isin("delete", "restore")
    effects = events.filter(action.isin("archive", "unarchive", "delete", "restore")).groupBy(key).agg(
        F.max_by(F.when(action == "archive", F.col("ts")), F.when(on_archive, at)).alias("event_archived_at"),
        F.max_by(F.when(action == "delete", F.col("ts")), F.when(on_delete, at)).alias("event_deleted_at"),
        F.bool_or(on_archive).alias("archive_touched"), F.bool_or(on_delete).alias("delete_touched"),
    )
    joined = runs.join(effects, key, "left")
    return joined.withColumns(
        {
            "archived_at": F.when(F.col("archive_touched"), F.col("event_archived_at")).otherwise(F.col("archived_at")),
            "deleted_at": F.when(F.col("delete_touched"), F.col("event_deleted_at")).otherwise(F.col("deleted_at")),
        }
    ).drop("event_archived_at", "event_deleted_at", "archive_touched", "delete_touched")


def coerce_correction(raw: Column, typ: Column) -> Column:
    """``struct(num, str)`` of a typed-in correction; what does not parse stays text."""
    number = strict_number(strip(raw))
    num = F.when(typ == "number", number).when(
        typ == "integer", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double")
    )
    return F.struct(num.cast("double").alias("num"), F.when(num.isNull(), raw).alias("str"))


def corrected_values(resolved: DataFrame, corrections: DataFrame, types: dict[str, str], key: str = "run_id") -> DataFrame:
    """Upsert corrections into ``resolved(key, field, value_num, value_str)`` and keep the from/to log.

    ``corrections(key, field, raw)``; only runs that have a correction are in the result.
    """
    table = F.create_map(*(x for k, v in types.items() for x in (F.lit(k), F.lit(v))))
    typ = F.coalesce(F.try_element_at(table, F.col("field")), F.lit("string"))
    new = corrections.select(key, "field", coerce_correction(F.col("raw"), typ).alias("to"))
    touched = corrections.select(key).distinct()
    old = resolved.join(touched, key, "left_semi").select(
        key, "field", F.col("value_num").alias("from_num"), F.col("value_str").alias("from_str"), F.lit(True).alias("had")
    )
    fixed = F.col("to").isNotNull()
    return old.join(new, [key, "field"], "full_outer").select(
        key, "field",
        F.when(fixed, F.col("to.num")).otherwise(F.col("from_num")).alias("value_num"),
        F.when(fixed, F.col("to.str")).otherwise(F.col("from_str")).alias("value_str"),
        fixed.alias("corrected"), "from_num", "from_str",
    )


def correction_status(base: Column, first_evaluation: Column) -> Column:
    """After a correction the first failing or ambiguous evaluation decides, whatever the rules said."""
    return F.when(first_evaluation == "fail", "FAIL").when(first_evaluation == "ambiguous", "AMBIGUOUS").otherwise(base)


def apply_corrections(
    resolved: DataFrame, ambiguous: DataFrame, corrections: DataFrame, checklist, evaluations: DataFrame | None = None,
    group_outcomes: DataFrame | None = None, key: str = "run_id",
) -> DataFrame:
    """Status per corrected run: AMBIGUOUS while a conflict is left, else the rules on the new values.

    ``group_outcomes(key, passed)`` are the parent run's outcomes of repeating groups; corrections do
    not touch them, so a failed one still fails the run.

    All inputs become tagged rows of one table and are aggregated once per run, so there is one shuffle, and partial
    aggregates go into it. What a run collects is bounded by its checklist's fields.
    """
    from docaudit.operators import verdicts as v

    types = F.create_map(*(x for f in checklist.fields for x in (F.lit(f.name), F.lit(f.type or "string"))))
    no_text, no_number, yes = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(True)

    def tagged(df: DataFrame, tag: str, field: Column = no_text, num: Column = no_number, text: Column = no_text, at: Column | None = None) -> DataFrame:
        return df.select(
            F.col(key), F.lit(tag).alias("tag"), field.alias("field"), num.cast("double").alias("num"), text.cast("string").alias("text"),
            (F.lit(None) if at is None else at).cast("long").alias("at"),
        )

    typ = F.coalesce(F.try_element_at(types, F.col("field")), F.lit("string"))
    new = corrections.withColumn("to", coerce_correction(F.col("raw"), typ))
    rows = tagged(resolved, "old", F.col("field"), F.col("value_num")).unionByName(tagged(new, "new", F.col("field"), F.col("to.num")))
    rows = rows.unionByName(tagged(ambiguous, "open", F.col("field")))
    if evaluations is not None:
        decisive = evaluations.filter("not informative_only and evaluation in ('fail', 'ambiguous')")
        rows = rows.unionByName(tagged(decisive, "evaluation", text=F.col("evaluation"), at=F.col("ix")))
    if group_outcomes is not None:
        rows = rows.unionByName(tagged(group_outcomes.filter(~F.col("passed")), "bad group"))

    tag = F.col("tag")
    is_field = {f.name: F.col("field") == f.name for f in checklist.fields}
    of = [
        x
        for i, here in enumerate(is_field.values())
        for x in (
            F.bool_or((tag == "new") & here).alias(f"new{i}"), F.max(F.when((tag == "new") & here, F.col("num"))).alias(f"new_num{i}"),
            F.bool_or((tag == "old") & here).alias(f"old{i}"), F.max(F.when((tag == "old") & here, F.col("num"))).alias(f"old_num{i}"),
        )
    ]
    per_run = rows.groupBy(key).agg(
        F.bool_or(tag == "new").alias("touched"), F.bool_or(tag == "bad group").alias("bad_group"),
        F.collect_set(F.when(tag == "open", F.col("field"))).alias("open"), F.collect_set(F.when(tag == "new", F.col("field"))).alias("settled"),
        F.min_by(F.when(tag == "evaluation", F.col("text")), F.when(tag == "evaluation", F.col("at"))).alias("first"), *of,
    ).filter("touched")
    value = {n: F.when(F.col(f"new{i}"), F.col(f"new_num{i}")).otherwise(F.col(f"old_num{i}")) for i, n in enumerate(is_field)}
    has = {n: F.coalesce(F.col(f"new{i}"), F.lit(False)) | F.coalesce(F.col(f"old{i}"), F.lit(False)) for i, n in enumerate(is_field)}
    failing = F.col("bad_group")
    for f in checklist.fields:
        if f.required and "required" in checklist.rules:
            failing = failing | ~has[f.name]
        if f.type == "number" and "type_check" in checklist.rules:
            failing = failing | (has[f.name] & value[f.name].isNull())
        if f.type == "number" and "range_validation" in checklist.rules:
            failing = failing | ~v.within(value[f.name], F.lit(f.min), F.lit(f.max))
    for _rule, compiled in checklist.active_cross_rules():
        applies = yes
        for n in compiled.names:
            applies = applies & value[n].isNotNull()
        failing = failing | (applies & ~compiled.column(lambda n: value[n]))
    ruled = correction_status(F.when(failing, "FAIL").otherwise("PASS"), F.col("first"))
    unsettled = F.size(F.array_except("open", "settled")) > 0
    return per_run.select(key, F.when(unsettled, "AMBIGUOUS").otherwise(ruled).alias("status"))


def revisions(runs: DataFrame, corrected: DataFrame, key: str = "id") -> DataFrame:
    """Child rows of corrected runs: parent id, next revision number, the parent's hash, tags and key."""
    rest = [c for c in runs.columns if c not in (key, "outcome", "parent_run_id", "revision_number")]
    return runs.join(corrected.select(F.col("run_id").alias(key), "status"), key).select(
        F.concat(F.col(key).cast("string"), F.lit("/r"), (F.col("revision_number") + 1).cast("string")).alias("id"),
        F.col(key).alias("parent_run_id"), (F.col("revision_number") + 1).alias("revision_number"),
        F.col("status").alias("outcome"), *rest,
    )


def sub_resource(runs: DataFrame, array: str, key: str) -> DataFrame:
    """Rows of one nested array of the snapshot; only that array is read from storage."""
    return runs.select(key, F.posexplode_outer(F.col(array)).alias("ix", "item"))


def run_blocks(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    return sub_resource(runs, "snapshots.blocks", key)


def run_candidates(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    return sub_resource(runs, "snapshots.candidates", key)


def run_resolved(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    return sub_resource(runs, "snapshots.resolved_document", key)


def dashboard(runs: DataFrame, specs: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Outcome counts of a project's runs, and the checklists and versions of its catalogue, used or not.

    ``specs(by…, schema_key, version_label)``. Both sides are aggregated per project before they meet; distinct
    versions combine on the map side first.
    """
    counts = runs.groupBy(*by).agg(
        F.count("*").alias("runs"),
        *(F.count_if(F.col("outcome") == o).alias(f"{o.lower()}_count") for o in ("PASS", "FAIL", "AMBIGUOUS")),
    )
    versions = specs.select(*by, "schema_key", "version_label").distinct().groupBy(*by, "schema_key").agg(F.count("*").alias("n"))
    catalogue = versions.groupBy(*by).agg(F.count("*").alias("checklists"), F.sum("n").alias("versions"))
    names = ("runs", "pass_count", "fail_count", "ambiguous_count", "checklists", "versions")
    return counts.join(catalogue, list(by), "full_outer").select(*by, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def recent_runs(runs: DataFrame, k: int = RECENT_RUNS, by: Sequence[str] = ("project_id",), ties=None) -> DataFrame:
    """The ``k`` newest runs of each project; partial top-ks come before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("created_at"), F.asc("id") if ties is None else ties))
    return runs.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def batch_progress(queue: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``queue(status, outcome)``: counts and whether the batch is done."""
    status = F.col("status")
    done = status.isin("done", "error")
    return queue.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"),
        F.count_if((status == "done") & (F.col("outcome") == "PASS")).alias("pass_count"),
        F.count_if((status == "done") & (F.col("outcome") == "FAIL")).alias("fail_count"),
        F.count_if((status == "done") & (F.col("outcome") == "AMBIGUOUS")).alias("ambiguous_count"),
        F.count_if(status == "error").alias("error_count"), F.bool_and(done).alias("is_done"),
    )
