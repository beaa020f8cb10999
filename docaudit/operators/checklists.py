"""The checklist catalogue: versions over time, lint, normalisation, summaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docaudit.session import ship_package
from docaudit.functions.expressions import RuleSyntaxError, compile_rule
from docaudit.functions.text import compact, strip
from docaudit.plans.checklist import DEFAULT_RULES, STRATEGIES, STRATEGY_SYNONYMS

# ---- versions --------------------------------------------------------------------------------


def next_labels(specs: DataFrame, by: Sequence[str] = ("project_id", "schema_key")) -> DataFrame:
    """Next revision label per checklist: ``major.minor+1``, else ``rev-n``, else ``1.0``."""
    label = strip(F.coalesce("version_label", F.lit("")))
    pair = F.when(
        label.rlike(r"^\d+\.\d+$"),
        F.struct(
            F.substring_index(label, ".", 1).cast("long").alias("major"),
            F.substring_index(label, ".", -1).cast("long").alias("minor"),
        ),
    )
    top = F.col("top")
    return specs.groupBy(*by).agg(F.max(pair).alias("top"), F.count_if(label != "").alias("n")).select(
        *by,
        F.when(F.col("n") == 0, "1.0")
        .when(top.isNotNull(), F.concat(top["major"].cast("string"), F.lit("."), (top["minor"] + 1).cast("string")))
        .otherwise(F.concat(F.lit("rev-"), (F.col("n") + 1).cast("string")))
        .alias("next_label"),
    )


def next_in_group(df: DataFrame, by: Sequence[str], at: str, bucket: Column, out: str) -> DataFrame:
    """``lead(at)`` per group without putting a hot group into one task.

    Rows are windowed per (group, time bucket); the last row of a bucket takes the first time of the
    next non-empty bucket, from a small per-bucket aggregate. ``bucket`` must grow with ``at``.
    """
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*by, "_bucket").orderBy(at)
    firsts = rows.groupBy(*by, "_bucket").agg(F.min(at).alias("_first"))
    across = Window.partitionBy(*by).orderBy("_bucket")
    following = firsts.select(*by, "_bucket", F.lead("_first").over(across).alias("_next_bucket"))
    led = rows.withColumn("_inside", F.lead(at).over(inside)).join(following, [*by, "_bucket"])
    return led.withColumn(out, F.coalesce("_inside", "_next_bucket")).drop("_bucket", "_inside", "_next_bucket", "_first")


def version_timeline(
    specs: DataFrame, by: Sequence[str] = ("project_id", "schema_key"), bucket: Column | None = None
) -> DataFrame:
    """When each version was the active one. Publishing a version archives the one before.

    ``specs(…, created_at, archived_at, deleted_at)`` with explicit archive and delete times, one
    version per instant and checklist. Adds ``active_from``, ``active_to`` and ``status``.
    """
    months = F.date_trunc("month", "created_at") if bucket is None else bucket
    led = next_in_group(specs, by, "created_at", months, "superseded_at")
    end = F.least("superseded_at", "archived_at", "deleted_at")
    return led.withColumns(
        {
            "active_from": F.col("created_at"),
            "active_to": end,
            "status": F.when(F.col("deleted_at").isNotNull(), "deleted").when(end.isNotNull(), "archived").otherwise("active"),
        }
    )


def bind_specs(docs: DataFrame, timeline: DataFrame) -> DataFrame:
    """Checklist of each document: the named version, else the current active one of the key.

    Named and current lookups are one equi-join: the current version of a key is repeated under a
    NULL-safe empty label.
    """
    usable = timeline.select("project_id", "schema_key", "version_label", F.col("id").alias("spec_id"), "status")
    live = usable.filter("status != 'deleted'")
    current = live.filter("status = 'active'").groupBy("project_id", "schema_key").agg(
        F.max(F.struct("version_label", "spec_id", "status")).alias("c")
    ).select("project_id", "schema_key", F.lit("").alias("version_label"), "c.spec_id", "c.status")
    named = live.groupBy("project_id", "schema_key", "version_label").agg(
        F.min_by(F.struct("spec_id", "status"), F.struct(F.when(F.col("status") == "active", 0).otherwise(1), "spec_id")).alias("c")
    ).select("project_id", "schema_key", "version_label", "c.spec_id", "c.status")
    wanted = docs.withColumn("version_label", F.coalesce(strip("version_label"), F.lit("")))
    reason = F.when(F.col("spec_id").isNull(), "unknown_checklist").when(F.col("status") != "active", "inactive_checklist")
    return (
        wanted.join(named.unionByName(current), ["project_id", "schema_key", "version_label"], "left")
        .withColumn("reason", reason)
        .withColumn("spec_id", F.when(F.col("reason").isNull(), F.col("spec_id")))
        .drop("status")
    )


def bind_as_of(
    docs: DataFrame, timeline: DataFrame, at: str = "uploaded_at", by: Sequence[str] = ("project_id", "schema_key"), bucket: Callable[[Column], Column] | None = None, salts: int = 16
) -> DataFrame:
    """``docs`` with the ``spec_id`` of the version that was active when each arrived, and the ``reason`` if none was.

    Versions and documents of a checklist are merged by time and the last version is carried on; no document meets all
    versions. A version published at the very instant of a document counts. Time is cut into buckets (days by default):
    each bucket hands its last version to those after it, so a checklist's history is no single task, and the documents
    of a bucket are dealt to ``salts`` shares that all hold its few versions. Documents with a null key or time are
    ``unknown_checklist``, like those before the first version; after the end of a version and before the next they
    are ``inactive_checklist``.
    """
    bucket = bucket or (lambda t: F.date_trunc("day", t))
    end = F.least("archived_at", "deleted_at")
    version = F.struct(F.col("active_from").alias("since"), F.col("id").alias("spec_id"), end.alias("until"))
    versions = timeline.filter("active_from IS NOT NULL").select(*by, F.col("active_from").alias("_at"), version.alias("_version"), bucket(F.col("active_from")).alias("_bucket"))
    # The version that each bucket starts with: the last one of the buckets before.
    lasts = versions.groupBy(*by, "_bucket").agg(F.max("_version").alias("_last"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    arriving = docs.select(*by, F.col(at).alias("_at"), row.alias("_row"), bucket(F.col(at)).alias("_bucket"), share.alias("_share"))
    used = arriving.select(*by, "_bucket").distinct()
    steps = lasts.select(*by, "_bucket", "_last").unionByName(used.withColumn("_last", F.lit(None).cast(lasts.schema["_last"].dataType)))
    steps = steps.groupBy(*by, "_bucket").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = steps.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_version")).filter("_version IS NOT NULL")
    known = versions.select(*by, "_at", "_version", "_bucket").unionByName(start.select(*by, F.col("_bucket").alias("_at"), "_version", "_bucket"))
    known = known.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_row", F.lit(None).cast(arriving.schema["_row"].dataType))
    both = known.unionByName(arriving.withColumn("_version", F.lit(None).cast(versions.schema["_version"].dataType)))
    # A version handed over is older than any of the bucket; at one instant versions come before documents.
    order = Window.partitionBy(*by, "_bucket", "_share").orderBy("_at", F.col("_row").isNotNull(), F.col("_version")["since"])
    carried = both.withColumn("_version", F.last("_version", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_row IS NOT NULL")
    found = F.when(F.col("_at").isNotNull(), F.col("_version"))
    reason = F.when(found.isNull(), "unknown_checklist").when(F.coalesce(found["until"] <= F.col("_at"), F.lit(False)), "inactive_checklist")
    out = carried.select("_row", F.when(reason.isNull(), found["spec_id"]).alias("spec_id"), reason.alias("reason"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("spec_id", "reason")], "spec_id", "reason")


def list_versions(specs: DataFrame) -> DataFrame:
    """Live versions with their ``place`` in the catalogue's order within the checklist, oldest first; rows are not sorted.

    Places run per month of publication, and each month starts where the months before it end.
    """
    live = specs.filter("deleted_at is null").withColumn("_month", F.date_trunc("month", "created_at"))
    by = ["project_id", "schema_key"]
    sizes = live.groupBy(*by, "_month").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_month", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_month").orderBy("created_at", "id"))
    placed = live.withColumn("_inside", inside).join(sizes, [*by, "_month"])
    return placed.withColumn("place", F.col("_before") + F.col("_inside")).drop("_month", "_inside", "_before")


def grouped_versions(specs: DataFrame) -> DataFrame:
    """One row per checklist with its version count, first and latest label."""
    return specs.filter("deleted_at is null").groupBy("project_id", "schema_key").agg(
        F.count("*").alias("versions"),
        F.min_by("version_label", F.struct("created_at", "id")).alias("first_label"),
        F.max_by("version_label", F.struct("created_at", "id")).alias("latest_label"),
    )


def catalog_violations(specs: DataFrame) -> DataFrame:
    """Live rows that break the catalogue: several active versions of a key, or a label used twice."""
    live = specs.filter("deleted_at is null")
    labels = live.groupBy("project_id", "schema_key", "version_label").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active")
    )
    twice = labels.filter("n > 1").select(
        "project_id", "schema_key", "version_label", F.lit("duplicate_label").alias("violation"), "n"
    )
    actives = labels.groupBy("project_id", "schema_key").agg(F.sum("active").alias("n")).filter("n > 1").select(
        "project_id", "schema_key", F.lit(None).cast("string").alias("version_label"),
        F.lit("several_active").alias("violation"), "n",
    )
    return twice.unionByName(actives)


def dedupe_by_name(df: DataFrame, name: str = "name", order: str = "ix") -> DataFrame:
    """The last entry of each name; rows are not sorted."""
    rest = [c for c in df.columns if c != name]
    return df.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("r")).select(name, "r.*")


def seed_defaults(projects: DataFrame, specs: DataFrame, key: str = "wine_quality", label: str = "1.0") -> DataFrame:
    """Catalogue rows to add: the default checklist for every project that lacks it."""
    present = specs.filter((F.col("schema_key") == key) & (F.col("version_label") == label)).select("project_id").distinct()
    return projects.join(present, "project_id", "left_anti").select(
        "project_id", F.lit(key).alias("schema_key"), F.lit(label).alias("version_label"), F.lit("active").alias("status")
    )


# ---- lint ------------------------------------------------------------------------------------

_OBJECT = "map<string,variant>"
CONTEXT_PASSES = ("never", "when_needed", "always")
STRUCTURES = ("table", "list", "sections")
EVALUATION_TAGS = ("pass", "fail", "ambiguous")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rule_names_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Identifiers of rule texts, NULL where a text is malformed (its grammar has no built-in)."""

    def names(text: str | None) -> list[str] | None:
        try:
            return list(compile_rule(text).names) if text else []
        except RuleSyntaxError:
            return None

    for batch in texts:
        yield batch.map(names)


def _get(v: Column, path: str, typ: str) -> Column:
    return F.try_variant_get(v, path, typ)


def _present(v: Column, path: str) -> Column:
    """Set, not JSON null, not an empty object / list / text."""
    got = _get(v, path, "variant")
    text = got.cast("string")
    return F.coalesce(got.isNotNull() & ~F.is_variant_null(got) & ~text.isin("", "{}", "[]", "false", "0"), F.lit(False))


def _kind(v: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING`` … of a variant; NULL when absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _entries(v: Column, path: str) -> Column:
    return F.coalesce(F.map_entries(_get(v, path, _OBJECT)), F.array().cast("array<struct<key:string,value:variant>>"))


def _issue(cond: Column, code: str, subject: Column, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.when(
        F.coalesce(cond, F.lit(False)),
        F.struct(F.lit(code).alias("code"), subject.cast("string").alias("subject"),
                 (none if detail is None else detail.cast("string")).alias("detail")),
    )


def lint_specs(specs: DataFrame, key: str = "spec_id", body: str = "body") -> DataFrame:
    """One row per violation: ``(key, code, subject, detail)``.

    Bodies are read as VARIANT, so ill-typed parts are findings rather than errors. Rule texts go
    once through the rule compiler, distinct texts only; everything else is built in.
    """
    v = F.col("v")
    ship_package(specs.sparkSession)
    read = specs.select(key, F.try_parse_json(F.col(body)).alias("v"))
    broken = F.coalesce(_kind(v), F.lit("")) != "OBJECT"
    no_fields = _present(v, "$.fields") & (_kind(_get(v, "$.fields", "variant")) != "OBJECT")
    # A body that is no object, or whose fields are none, has that finding alone.
    fatal = read.select(key, F.inline(compact(F.array(
        _issue(broken, "body_not_object", F.lit("body")), _issue(~broken & F.coalesce(no_fields, F.lit(False)), "fields_not_object", F.lit("body")),
    ))))
    parsed = read.filter(~broken & ~F.coalesce(no_fields, F.lit(False)))
    whole = parsed.select(key, F.inline(compact(F.array(*_header_issues(v)))))
    fields = parsed.select(key, F.explode(_entries(v, "$.fields")).alias("e")).select(
        key, F.inline(compact(F.array(*_field_issues(F.col("e.key"), F.col("e.value")))))
    )
    groups = parsed.select(key, F.explode(_entries(v, "$.groups")).alias("e")).select(
        key, F.inline(compact(F.array(*_group_issues(F.col("e.key"), F.col("e.value")))))
    )
    open_ended = parsed.select(
        key, F.map_keys(F.coalesce(_get(v, "$.fields", _OBJECT), F.create_map().cast(_OBJECT))).alias("names"),
        F.explode(_entries(v, "$.open_ended")).alias("e"),
    ).select(key, F.inline(_open_ended_issues(F.col("e.key"), F.col("e.value"), F.col("names"))))
    rules = _expression_issues(parsed, key)
    return fatal.unionByName(whole).unionByName(fields).unionByName(groups).unionByName(open_ended).unionByName(rules)


def _header_issues(v: Column) -> list[Column]:
    version = F.coalesce(_get(v, "$.version", "string"), F.lit(""))
    extended = _present(v, "$.cross_field_rules") | _present(v, "$.groups")
    ext = _get(v, "$.extraction", "variant")
    context = F.lower(F.coalesce(F.nullif(_get(v, "$.extraction.context_pass", "string"), F.lit("")), F.lit("when_needed")))
    images = _get(v, "$.extraction.read_images", "variant")
    open_ended = _get(v, "$.open_ended", "variant")
    at = F.lit("body")
    return [
        _issue(extended & ~version.isin("2", "3"), "version_2_required", at),
        _issue(_present(v, "$.open_ended") & (version != "3"), "version_3_required", at),
        _issue(ext.isNotNull() & ~F.is_variant_null(ext) & (_kind(ext) != "OBJECT"), "extraction_not_object", at),
        _issue((_kind(ext) == "OBJECT") & ~context.isin(*CONTEXT_PASSES), "bad_context_pass", at, context),
        _issue(images.isNotNull() & ~F.is_variant_null(images) & (_kind(images) != "BOOLEAN"), "read_images_not_boolean", at),
        _issue(_present(v, "$.groups") & (_kind(_get(v, "$.groups", "variant")) != "OBJECT"), "groups_not_object", at),
        _issue(open_ended.isNotNull() & ~F.is_variant_null(open_ended) & (_kind(open_ended) != "OBJECT"), "open_ended_not_object", at),
    ]


def _field_issues(name: Column, f: Column) -> list[Column]:
    policy = F.replace(F.lower(strip(F.coalesce(_get(f, "$.on_ambiguity", "string"), F.lit("")))), F.lit(" "), F.lit("_"))
    role = _get(f, "$.semantic_role", "string")
    return [
        _issue(_present(f, "$.required") & ~_present(f, "$.regex_hint") & ~_present(f, "$.aliases"), "required_without_hint", name),
        _issue(_present(f, "$.rules") & (_kind(_get(f, "$.rules", "variant")) == "ARRAY"), "field_rules_unsupported", name),
        _issue((policy != "") & ~policy.isin(*STRATEGIES, *STRATEGY_SYNONYMS), "bad_on_ambiguity", name, policy),
        _issue(role.isNotNull() & (strip(role) == ""), "blank_semantic_role", name),
    ]


def _group_issues(name: Column, g: Column) -> list[Column]:
    is_object = _kind(g) == "OBJECT"
    hint = strip(F.coalesce(_get(g, "$.section_hint", "string"), F.lit("")))
    structure = F.lower(strip(F.coalesce(_get(g, "$.structure_hint", "string"), F.lit(""))))
    rows = F.coalesce(F.size(_get(g, "$.row_fields", _OBJECT)) > 0, F.lit(False))
    return [
        _issue(~is_object, "group_not_object", name),
        _issue(is_object & (hint == ""), "section_hint_required", name),
        _issue(is_object & ~rows, "row_fields_required", name),
        _issue(is_object & rows & (structure != "") & ~structure.isin(*STRUCTURES), "bad_structure_hint", name, structure),
    ]


def _open_ended_issues(name: Column, o: Column, fields: Column) -> Column:
    is_object = _kind(o) == "OBJECT"
    extract = strip(F.coalesce(_get(o, "$.extract_prompt", "string"), F.lit("")))
    evaluate = strip(F.coalesce(_get(o, "$.evaluate_prompt", "string"), F.lit("")))
    informative = _present(o, "$.informative_only")
    link = _get(o, "$.link_evidence", "variant")
    tags, deps = _get(o, "$.evaluation_tags", "variant"), _get(o, "$.depends_on_fields", "variant")
    tag_list = F.coalesce(_get(o, "$.evaluation_tags", "array<string>"), F.array().cast("array<string>"))
    dep_list = F.coalesce(_get(o, "$.depends_on_fields", "array<string>"), F.array().cast("array<string>"))
    single = [
        _issue(~is_object, "open_ended_not_object", name),
        _issue(is_object & (extract == ""), "extract_prompt_required", name),
        _issue(is_object & ~informative & (evaluate == ""), "evaluate_prompt_required", name),
        _issue(link.isNotNull() & ~F.is_variant_null(link) & (_kind(link) != "BOOLEAN"), "link_evidence_not_boolean", name),
        _issue(tags.isNotNull() & ~F.is_variant_null(tags) & (_kind(tags) != "ARRAY"), "tags_not_list", name),
        _issue(deps.isNotNull() & ~F.is_variant_null(deps) & (_kind(deps) != "ARRAY"), "depends_on_not_list", name),
    ]
    bad_tags = F.transform(tag_list, lambda t: _issue(~F.lower(strip(t)).isin(*EVALUATION_TAGS), "bad_evaluation_tag", name, t))
    bad_deps = F.transform(dep_list, lambda d: _issue(~F.array_contains(fields, d), "unknown_depends_on", name, d))
    return compact(F.concat(F.array(*single), bad_tags, bad_deps))


def _expression_issues(parsed: DataFrame, key: str) -> DataFrame:
    """Cross-field and row rules: missing or malformed text, names and listed fields that do not exist."""
    v = F.col("v")
    no_map = F.create_map().cast(_OBJECT)
    field_names = F.map_keys(F.coalesce(_get(v, "$.fields", _OBJECT), no_map))
    cross = parsed.select(key, field_names.alias("known"), F.explode(_get(v, "$.cross_field_rules", "array<variant>")).alias("r")).select(
        key, "known", F.lit("cross_field_rules").alias("owner"), "r"
    )
    row = parsed.select(key, F.explode(_entries(v, "$.groups")).alias("e")).select(
        key, F.map_keys(F.coalesce(_get(F.col("e.value"), "$.row_fields", _OBJECT), no_map)).alias("known"),
        F.concat(F.lit("groups."), F.col("e.key")).alias("owner"),
        F.explode(_get(F.col("e.value"), "$.row_rules", "array<variant>")).alias("r"),
    ).filter(F.size("known") > 0)
    r = F.col("r")
    expr = _get(r, "$.expression", "variant")
    rules = cross.unionByName(row).select(
        key, "known", "owner", r,
        F.concat(F.col("owner"), F.lit("."), F.coalesce(_get(r, "$.id", "string"), F.lit("?"))).alias("subject"),
        (_kind(r) == "OBJECT").alias("is_object"),
        F.when(_kind(expr) == "STRING", F.nullif(_get(r, "$.expression", "string"), F.lit(""))).alias("text"),
    )
    texts = rules.select("text").filter("text is not null").distinct().withColumn("names", _rule_names_udf("text"))
    checked = rules.join(texts, "text", "left")
    subject, known = F.col("subject"), F.col("known")
    listed = F.coalesce(_get(r, "$.fields", "array<string>"), F.array().cast("array<string>"))
    is_cross = F.col("owner") == "cross_field_rules"
    raw_list = _get(r, "$.fields", "variant")
    parseable = F.col("text").isNotNull() & F.col("names").isNotNull()
    unknown = F.transform(
        F.when(parseable, F.array_except("names", known)).otherwise(F.array().cast("array<string>")),
        lambda n: _issue(F.lit(True), "unknown_name", subject, n),
    )
    unlisted = F.transform(
        F.when(is_cross & parseable, F.array_except(listed, known)).otherwise(F.array().cast("array<string>")),
        lambda n: _issue(F.lit(True), "unknown_listed_field", subject, n),
    )
    single = F.array(
        _issue(~F.col("is_object"), "rule_not_object", subject),
        _issue(F.col("is_object") & F.col("text").isNull(), "expression_required", subject),
        _issue(F.col("text").isNotNull() & F.col("names").isNull(), "bad_expression", subject, F.col("text")),
        _issue(
            is_cross & parseable & raw_list.isNotNull() & ~F.is_variant_null(raw_list) & (_kind(raw_list) != "ARRAY"),
            "fields_not_list", subject,
        ),
    )
    return checked.select(key, F.inline(compact(F.concat(single, unknown, unlisted))))


# ---- normalisation ---------------------------------------------------------------------------

# Field names people use, and the canonical name each stands for, in order of precedence.
FIELD_RENAMES = {
    "document_total": "total_due",
    "total_amount": "total_due",
    "amount_due": "total_due",
    "date_emision": "issue_date",
    "fecha_emision": "issue_date",
    "date_emission": "issue_date",
    "invoice_issue_date": "issue_date",
    "date_vencimiento": "due_date",
    "fecha_vencimiento": "due_date",
    "invoice_due_date": "due_date",
}
_DATE_FORMS = r"(\d{1,2}\s+de\s+\w+\s+de\s+\d{4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
# Default aliases, pattern, policy, gap-fill flag and hint of well-known fields.
DEFAULT_HINTS = {
    "invoice_number": (
        ["Número de factura", "Numero de factura", "Invoice number"],
        r"(?i)(?:n[uú]mero\s*de\s*factura|invoice\s*number)\s*[:=\s]*([A-Z0-9]+(?:-[A-Z0-9]+)*)(?=\s|$|[^A-Z0-9-])",
        "first", None, None,
    ),
    "issue_date": (
        ["Fecha de emisión", "Fecha de emision", "Issue date", "fecha de emisión"],
        r"(?i)(?:fecha\s*de\s*emisi[oó]n|issue\s*date)\s*[:=\s]*" + _DATE_FORMS, None, True, None,
    ),
    "due_date": (
        ["Fecha de vencimiento", "Due date", "fecha de vencimiento"],
        r"(?i)(?:fecha\s*de\s*vencimiento|due\s*date)\s*[:=\s]*" + _DATE_FORMS, None, True, None,
    ),
    "total_due": (
        ["Importe por pagar", "Total due", "Amount due", "total a pagar"],
        r"(?i)(?:importe\s*por\s*pagar|total\s*due|amount\s*due)\s*[:=\s]*USD?\s*([\d,.]+)", None, None,
        "Use the amount due / importe por pagar line, not line-item subtotals or unit prices.",
    ),
    "recipient_email": (
        ["Email", "Correo", "correo electrónico"], r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", None, None,
        "Bill-to / Facturar a recipient only — ignore issuer contact emails.",
    ),
}
NO_PATTERN_HINT = (
    "Extract the unique invoice identifier using document context; do not rely on a bare alphanumeric pattern."
)
FIELD_COLUMNS = (
    "type", "required", "min", "max", "aliases", "regex_hint", "on_ambiguity", "llm_fallback", "llm_only",
    "extraction_hint",
)
PROMPT_COLUMNS = ("description", "prompt", "extraction_prompt", "task", "instruction")


def _lookup(values: dict[str, str | int], key: Column) -> Column:
    table = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(table, key)


def loose_pattern(hint: Column) -> Column:
    """A bare character class such as ``[A-Z0-9-]+`` would match everywhere."""
    h = strip(hint)
    anchored = h.rlike(r"(?i)(?:fecha|invoice|n[uú]mero|total|email|@)")
    return ~anchored & h.rlike(r"^(?:\(\?i\))?\[[^\]]+\]\+?$")


def normalize_fields(fields: DataFrame, key: str = "spec_id") -> DataFrame:
    """Repair strict field rows: equality rules become bounds or a literal pattern, names become
    canonical, and missing hints are filled.

    ``fields(key, field, <FIELD_COLUMNS>, equals)``; rows of type ``open_ended`` are left to
    :func:`normalize_open_ended`. Of several names for one field the canonical one wins, then the
    order of ``FIELD_RENAMES``: a ``min_by``.
    """
    strict = fields.filter(F.lower(F.coalesce("type", F.lit(""))) != "open_ended")
    exact = F.col("equals").try_cast("double")
    escaped = F.regexp_replace("equals", r"([^A-Za-z0-9_])", r"\\$1")
    is_num, is_str = F.col("type") == "number", (F.col("type") == "string") & F.col("equals").isNotNull()
    ruled = strict.withColumns(
        {
            "min": F.when(is_num & exact.isNotNull(), exact).otherwise(F.col("min")),
            "max": F.when(is_num & exact.isNotNull(), exact).otherwise(F.col("max")),
            "regex_hint": F.when(is_str, F.concat(F.lit("(?i)"), escaped)).otherwise(F.col("regex_hint")),
        }
    )
    order = _lookup({k: i + 1 for i, k in enumerate(FIELD_RENAMES)}, F.col("field"))
    named = ruled.withColumn("_name", F.coalesce(_lookup(FIELD_RENAMES, F.col("field")), F.col("field")))
    merged = (
        named.groupBy(key, F.col("_name").alias("field"))
        .agg(F.min_by(F.struct(*FIELD_COLUMNS), F.coalesce(order, F.lit(0))).alias("f"))
        .select(key, "field", "f.*")
    )
    return _with_hints(merged)


def _with_hints(fields: DataFrame) -> DataFrame:
    def default(pos: int, typ: str) -> Column:
        out = F.lit(None).cast(typ)
        for name, row in DEFAULT_HINTS.items():
            v = row[pos]
            lit = F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
            out = F.when(F.col("field") == name, lit.cast(typ)).otherwise(out)
        return out

    known = F.col("field").isin(*DEFAULT_HINTS)
    hint = F.coalesce(strip("regex_hint"), F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    invoice = F.col("field") == "invoice_number"
    skip = known & (
        F.coalesce("llm_only", F.lit(False))
        | (invoice & F.coalesce("llm_fallback", F.lit(False)))
        | (invoice & ~blank("extraction_hint") & blank("regex_hint"))
    )
    return fields.select(
        *[c for c in fields.columns if c not in ("aliases", "regex_hint", "on_ambiguity", "llm_fallback", "extraction_hint")],
        F.when(known & (F.coalesce(F.size("aliases"), F.lit(0)) <= 0), default(0, "array<string>"))
        .otherwise(F.col("aliases")).alias("aliases"),
        F.when(skip, F.lit(None).cast("string"))
        .when(known & ((hint == "") | loose_pattern(hint)), default(1, "string"))
        .otherwise(F.col("regex_hint")).alias("regex_hint"),
        F.when(blank("on_ambiguity"), F.coalesce(default(2, "string"), F.col("on_ambiguity")))
        .otherwise(F.col("on_ambiguity")).alias("on_ambiguity"),
        F.when(skip, F.lit(True)).otherwise(F.coalesce("llm_fallback", default(3, "boolean"))).alias("llm_fallback"),
        F.when(blank("extraction_hint") & skip, F.lit(NO_PATTERN_HINT))
        .when(blank("extraction_hint"), F.coalesce(default(4, "string"), F.col("extraction_hint")))
        .otherwise(F.col("extraction_hint")).alias("extraction_hint"),
    )


def normalize_open_ended(fields: DataFrame, open_ended: DataFrame, key: str = "spec_id") -> DataFrame:
    """Open-ended rows of both tables with a prompt and flags filled in; a moved field wins.

    ``open_ended(key, field, extract_prompt, <PROMPT_COLUMNS>, evaluate_prompt, informative_only,
    link_evidence)``; ``fields`` needs the same prompt columns.
    """
    columns = ("extract_prompt", *PROMPT_COLUMNS, "evaluate_prompt", "informative_only", "link_evidence")
    moved = fields.filter(F.lower("type") == "open_ended").select(
        key, "field", *columns, F.lit(0).alias("_rank")
    ).withColumn(
        "extract_prompt",
        F.coalesce(
            F.nullif("extract_prompt", F.lit("")), F.nullif("description", F.lit("")),
            F.concat(F.lit("Extract "), F.replace("field", F.lit("_"), F.lit(" "))),
        ),
    )
    own = open_ended.select(key, "field", *columns, F.lit(1).alias("_rank"))
    one = moved.unionByName(own).groupBy(key, "field").agg(F.min_by(F.struct(*columns), "_rank").alias("o")).select(key, "field", "o.*")
    prompt = F.coalesce(
        *(F.nullif(strip(c), F.lit("")) for c in ("extract_prompt", *PROMPT_COLUMNS)),
        F.concat(F.lit("Extract the "), strip(F.replace("field", F.lit("_"), F.lit(" "))), F.lit(" from the document.")),
    )
    no_eval = F.coalesce(strip("evaluate_prompt"), F.lit("")) == ""
    declared = F.col("informative_only")
    informative = F.when(no_eval & ((declared.isNull()) | declared), F.lit(True)).otherwise(declared)
    return one.select(
        key, "field", prompt.alias("extract_prompt"), "evaluate_prompt", informative.alias("informative_only"),
        F.coalesce("link_evidence", F.when(informative, F.lit(True))).alias("link_evidence"),
    )


def normalize_rules(rules: DataFrame, key: str = "spec_id") -> DataFrame:
    """Canonical field names inside rule texts and their field lists."""
    text = F.col("expression")
    for alias, canonical in FIELD_RENAMES.items():
        text = F.regexp_replace(text, rf"\b{re.escape(alias)}\b", canonical)
    listed = F.transform("fields", lambda n: F.coalesce(_lookup(FIELD_RENAMES, n), n))
    return rules.withColumns({"expression": text, "fields": listed})


def normalize_header(specs: DataFrame, open_ended: DataFrame, key: str = "spec_id") -> DataFrame:
    """Default rules when none are named; version 3 as soon as there is an open-ended field."""
    has_open = open_ended.select(key).distinct().withColumn("_open", F.lit(True))
    rules = F.array(*map(F.lit, DEFAULT_RULES))
    return specs.join(has_open, key, "left").select(
        *[c for c in specs.columns if c not in ("version", "rules")],
        F.when(F.col("_open"), "3").otherwise(F.col("version")).alias("version"),
        F.when(F.coalesce(F.size("rules"), F.lit(0)) <= 0, rules).otherwise(F.col("rules")).alias("rules"),
    )


def normalize_specs(specs: DataFrame, fields: DataFrame, rules: DataFrame, open_ended: DataFrame, key: str = "spec_id") -> dict[str, DataFrame]:
    """All parts of a catalogue in canonical form."""
    prompts = normalize_open_ended(fields, open_ended, key)
    return {
        "specs": normalize_header(specs, prompts, key), "fields": normalize_fields(fields, key),
        "rules": normalize_rules(rules, key), "open_ended": prompts,
    }


def summarize_specs(specs: DataFrame, fields: DataFrame, groups: DataFrame, open_ended: DataFrame, rules: DataFrame, key: str = "spec_id") -> DataFrame:
    """Counts per checklist; each part is aggregated before it is joined."""
    f = fields.groupBy(key).agg(
        F.count("*").alias("n_fields"), F.count_if("required").alias("n_required"),
        F.sum(F.greatest(F.coalesce(F.size("aliases"), F.lit(0)), F.lit(0))).alias("n_aliases"),
    )
    parts = [f] + [
        df.groupBy(key).agg(F.count("*").alias(name))
        for df, name in ((groups, "n_groups"), (open_ended, "n_open_ended"), (rules, "n_cross_rules"))
    ]
    out = specs
    for p in parts:
        out = out.join(p, key, "left")
    return out.na.fill(0, ["n_fields", "n_required", "n_aliases", "n_groups", "n_open_ended", "n_cross_rules"])


def rule_names(texts: DataFrame, column: str = "expression") -> DataFrame:
    """Identifiers per rule text; NULL for malformed ones."""
    return texts.withColumn("names", _rule_names_udf(column))

