"""Checklist catalogue over the part table seen as checklist versions and bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.operators import checklists as ops
from docaudit.operators.labels import catalogue_labels, label_places
from docaudit.plans import datasets as d
from docaudit.plans.catalogue import compiled
from docaudit.plans.validation import validate_documents
from docaudit.sources.blocks import text_blocks

from .registry import query


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Each part is a version of the checklist (brand, type), published at its own minute."""
    k = F.col("p_partkey")
    at = F.timestamp_seconds(F.lit(1577836800) + k * 60)
    return d.table(spark, sf, "part").select(
        k.alias("id"), F.col("p_brand").alias("project_id"), F.col("p_type").alias("schema_key"),
        F.when(k % 9 == 0, "draft").otherwise(F.concat(F.lit("1."), F.col("p_size").cast("string"))).alias("version_label"),
        at.alias("created_at"), F.when(k % 7 == 0, at + F.expr("INTERVAL 30 SECONDS")).alias("archived_at"),
        F.when(k % 10 == 0, at + F.expr("INTERVAL 2 DAYS")).alias("deleted_at"),
        F.when(k % 3 == 0, "active").otherwise("archived").alias("status"),
    )


VERSIONS = """versions AS (
  SELECT p_partkey AS id, p_brand AS project_id, p_type AS schema_key, CASE WHEN p_partkey % 9 = 0 THEN 'draft' ELSE '1.' || p_size END AS version_label,
    1577836800 + p_partkey * 60 AS created, CASE WHEN p_partkey % 7 = 0 THEN 1577836800 + p_partkey * 60 + 30 END AS archived,
    CASE WHEN p_partkey % 10 = 0 THEN 1577836800 + p_partkey * 60 + 172800 END AS deleted,
    CASE WHEN p_partkey % 3 = 0 THEN 'active' ELSE 'archived' END AS status FROM part),
timeline AS (SELECT *, least(lead(created) OVER (PARTITION BY project_id, schema_key ORDER BY created), archived, deleted) AS ended FROM versions),
stated AS (SELECT *, CASE WHEN deleted IS NOT NULL THEN 'deleted' WHEN ended IS NOT NULL THEN 'archived' ELSE 'active' END AS state FROM timeline)"""


@query(
    "spc01_next_labels",
    f"""WITH {VERSIONS} SELECT project_id, schema_key, CASE WHEN max(CASE WHEN version_label <> 'draft' THEN CAST(substr(version_label, 3) AS BIGINT) END) IS NULL
   THEN 'rev-' || (count(*) + 1) ELSE '1.' || (max(CASE WHEN version_label <> 'draft' THEN CAST(substr(version_label, 3) AS BIGINT) END) + 1) END AS next_label
FROM versions GROUP BY project_id, schema_key""",
)
def next_labels(spark: SparkSession, sf: str) -> DataFrame:
    return ops.next_labels(versions(spark, sf))


@query("spc02_version_timeline", f"WITH {VERSIONS} SELECT id, created AS active_from, coalesce(ended, 0) AS active_to, state AS status FROM stated")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.version_timeline(versions(spark, sf).drop("status"), bucket=F.date_trunc("hour", "created_at"))
    return rows.select(
        "id", F.unix_timestamp("active_from").alias("active_from"), F.coalesce(F.unix_timestamp("active_to"), F.lit(0).cast("long")).alias("active_to"), "status"
    )


@query(
    "spc03_bind_specs",
    f"""WITH {VERSIONS}, live AS (SELECT * FROM stated WHERE state <> 'deleted'),
named AS (SELECT project_id, schema_key, version_label, arg_min(id, CASE state WHEN 'active' THEN 0 ELSE 1000000000 END + id) AS spec_id,
   bool_or(state = 'active') AS usable FROM live GROUP BY ALL),
current AS (SELECT project_id, schema_key, id AS spec_id FROM live WHERE state = 'active'),
wanted AS (SELECT p_partkey AS doc_id, p_brand AS project_id, CASE WHEN p_partkey % 8 = 0 THEN 'NONE' ELSE p_type END AS schema_key,
   CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '1.' || (p_partkey % 50) END AS label FROM part)
SELECT doc_id, CASE WHEN label = '' THEN coalesce(c.spec_id, -1) WHEN n.usable THEN n.spec_id ELSE -1 END AS spec_id,
  CASE WHEN label = '' THEN CASE WHEN c.spec_id IS NULL THEN 'unknown_checklist' ELSE '' END WHEN n.spec_id IS NULL THEN 'unknown_checklist' WHEN n.usable THEN '' ELSE 'inactive_checklist' END AS reason
FROM wanted w LEFT JOIN named n ON w.project_id = n.project_id AND w.schema_key = n.schema_key AND w.label = n.version_label
LEFT JOIN current c ON w.project_id = c.project_id AND w.schema_key = c.schema_key""",
)
def bound(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    docs = d.table(spark, sf, "part").select(
        k.alias("doc_id"), F.col("p_brand").alias("project_id"), F.when(k % 8 == 0, "NONE").otherwise(F.col("p_type")).alias("schema_key"),
        F.when(k % 2 != 0, F.concat(F.lit(" 1."), (k % 50).cast("string"))).alias("version_label"),
    )
    rows = ops.bind_specs(docs, ops.version_timeline(versions(spark, sf).drop("status")))
    return rows.select("doc_id", F.coalesce("spec_id", F.lit(-1).cast("long")).alias("spec_id"), F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "spc03b_bind_as_of",
    f"""WITH {VERSIONS}, arrived AS (SELECT l_orderkey AS doc_id, l_linenumber AS copy, p_brand AS project_id, CASE WHEN l_orderkey % 11 = 0 THEN 'NONE' ELSE p_type END AS schema_key,
   1577836800 + (l_orderkey * 7 + l_linenumber * 131) % 30000 * 30 AS arrival FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT doc_id, copy, CASE WHEN v.id IS NULL OR least(archived, deleted) <= arrival THEN -1 ELSE v.id END AS spec_id,
   CASE WHEN v.id IS NULL THEN 'unknown_checklist' WHEN least(archived, deleted) <= arrival THEN 'inactive_checklist' ELSE '' END AS reason
FROM arrived a ASOF LEFT JOIN versions v ON a.project_id = v.project_id AND a.schema_key = v.schema_key AND a.arrival >= v.created""",
)
def bound_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as documents that arrive over ten days while parts publish versions: ties, gaps and early birds included."""
    k = F.col("l_orderkey")
    part = d.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("project_id"), "p_type")
    docs = d.table(spark, sf, "lineitem").join(part, "l_partkey").select(
        k.alias("doc_id"), F.col("l_linenumber").alias("copy"), "project_id", F.when(k % 11 == 0, "NONE").otherwise(F.col("p_type")).alias("schema_key"),
        F.timestamp_seconds(F.lit(1577836800) + (k * 7 + F.col("l_linenumber") * 131) % 30000 * 30).alias("uploaded_at"),
    )
    rows = ops.bind_as_of(docs, ops.version_timeline(versions(spark, sf).drop("status"), bucket=F.date_trunc("hour", "created_at")))
    return rows.select("doc_id", "copy", F.coalesce("spec_id", F.lit(-1).cast("long")).alias("spec_id"), F.coalesce("reason", F.lit("")).alias("reason"))


CATALOGUE_STATUS = """(SELECT doc_id, spec_id, price, size, has_size,
   CAST(NOT has_size AND v % 2 = 0 AS BIGINT) + CAST(price < 900 + v % 50 * 10 AS BIGINT) + CAST(has_size AND size > 10 + v % 41 AS BIGINT)
   + CAST(has_size AND NOT (price / size >= 20 + v % 60 AND size <> v % 50) AS BIGINT)
   + CASE WHEN v % 3 = 0 THEN CAST(doc_id % 7 < v % 9 AS BIGINT) + CAST(doc_id % 10 < v % 9 AS BIGINT) ELSE 0 END AS failed
FROM (SELECT b.doc_id, b.spec_id, b.spec_id AS v, p_retailprice AS price, p_size AS size, p_partkey % 6 <> 0 AS has_size FROM bound b JOIN part ON p_partkey = b.doc_id))"""


def catalogue_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON body for every version: bounds, rules and groups differ from one to the next."""
    v = F.col("p_partkey")
    group = F.when(v % 3 == 0, F.format_string(
        ', "groups": {"stock": {"section_hint": "Stock Rows", "structure_hint": "list", "row_fields": {"line": {"type": "number"}, "qty": {"type": "number"}}, '
        '"row_rules": [{"id": "enough", "expression": "qty >= %d", "error_message": "line {line}: {qty}"}]}}', v % 9)).otherwise("")
    body = F.format_string(
        '{"version": "2", "fields": {"price": {"type": "number", "required": true, "min": %d, "aliases": ["Price"]}, "size": {"type": "number", "required": %s, "max": %d}}, '
        '"cross_field_rules": [{"id": "per_size", "expression": "price / size >= %d AND NOT size == %d", "fields": ["price", "size"], "error_message": "{price} for {size}"}]%s}',
        F.lit(900) + v % 50 * 10, F.when(v % 2 == 0, "true").otherwise("false"), F.lit(10) + v % 41, F.lit(20) + v % 60, v % 50, group)
    return d.table(spark, sf, "part").select(v.alias("spec_id"), body.alias("body"))


@query(
    "rul14g_validate_catalogue",
    f"""WITH {VERSIONS}, live AS (SELECT * FROM stated WHERE state <> 'deleted'),
named AS (SELECT project_id, schema_key, version_label, arg_min(id, CASE state WHEN 'active' THEN 0 ELSE 1000000000 END + id) AS spec_id,
   bool_or(state = 'active') AS usable FROM live GROUP BY ALL),
current AS (SELECT project_id, schema_key, id AS spec_id FROM live WHERE state = 'active'),
wanted AS (SELECT p_partkey AS doc_id, p_brand AS project_id, CASE WHEN p_partkey % 8 = 0 THEN 'NONE' ELSE p_type END AS schema_key,
   CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '1.' || (p_partkey % 50) END AS label FROM part),
bound AS (SELECT doc_id, CASE WHEN label = '' THEN c.spec_id WHEN n.usable THEN n.spec_id END AS spec_id
FROM wanted w LEFT JOIN named n ON w.project_id = n.project_id AND w.schema_key = n.schema_key AND w.label = n.version_label
LEFT JOIN current c ON w.project_id = c.project_id AND w.schema_key = c.schema_key)
SELECT doc_id, coalesce(spec_id, -1) AS spec_id, CASE WHEN spec_id IS NULL THEN 'UNKNOWN_CHECKLIST' WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
   CASE WHEN spec_id IS NULL THEN 0 ELSE failed END AS n_failed,
   CASE WHEN spec_id IS NOT NULL AND has_size AND NOT (price / size >= 20 + spec_id % 60 AND size <> spec_id % 50)
     THEN CASE WHEN price = round(price) THEN CAST(CAST(round(price) AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END || ' for ' || size ELSE '' END AS message
FROM {CATALOGUE_STATUS}""",
)
def validated(spark: SparkSession, sf: str) -> DataFrame:
    """Part sheets bound to a version of their checklist and validated by it: catalogue, bodies and documents are tables."""
    k = F.col("p_partkey")
    text = F.concat_ws(
        "\n", F.lit("PART SHEET"), F.format_string("Price: %.2f", "p_retailprice"), F.when(k % 6 != 0, F.format_string("Size: %d", "p_size")),
        F.lit("Stock Rows"), F.format_string("1 %d", k % 7), F.format_string("2 %d", k % 10),
    )
    docs = d.table(spark, sf, "part").select(
        k.alias("doc_id"), F.col("p_brand").alias("project_id"), F.when(k % 8 == 0, "NONE").otherwise(F.col("p_type")).alias("schema_key"),
        F.when(k % 2 != 0, F.concat(F.lit("1."), (k % 50).cast("string"))).alias("version_label"), text_blocks(text).alias("blocks"),
    )
    timeline = ops.version_timeline(versions(spark, sf).drop("status"), bucket=F.date_trunc("hour", "created_at"))
    bound = ops.bind_specs(docs, timeline).select("doc_id", "blocks", F.col("spec_id").cast("string").alias("spec_id"))
    catalogue = compiled(catalogue_bodies(spark, sf))
    placed = label_places(bound, catalogue_labels(catalogue) or [])
    found = validate_documents(placed, catalogue, measurements=False, label_places="label_places", keep=["doc_id", "spec_id"])
    failed = F.filter("outcomes", lambda o: ~o["passed"])
    message = F.get(F.filter("outcomes", lambda o: (o["rule"] == "per_size") & ~o["passed"])["expected"], F.lit(0))
    return found.select(
        "doc_id", F.coalesce(F.col("spec_id").cast("long"), F.lit(-1).cast("long")).alias("spec_id"), "status",
        F.greatest(F.coalesce(F.size(failed), F.lit(0)), F.lit(0)).cast("long").alias("n_failed"), F.coalesce(message, F.lit("")).alias("message"),
    )


@query(
    "spc04_list_versions",
    f"""WITH {VERSIONS} SELECT project_id, schema_key, count(*) AS versions, arg_min(version_label, id) AS first_label, arg_max(version_label, id) AS latest_label
FROM versions WHERE deleted IS NULL GROUP BY ALL
UNION ALL SELECT project_id, schema_key, id, version_label, CAST(row_number() OVER (PARTITION BY project_id, schema_key ORDER BY created, id) AS VARCHAR) FROM versions WHERE deleted IS NULL""",
)
def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped list and flat list."""
    flat = ops.list_versions(versions(spark, sf)).select(
        "project_id", "schema_key", F.col("id").alias("versions"), F.col("version_label").alias("first_label"), F.col("place").cast("string").alias("latest_label")
    )
    return ops.grouped_versions(versions(spark, sf)).unionByName(flat)


@query(
    "spc05_catalog_violations",
    f"""WITH {VERSIONS}, live AS (SELECT * FROM versions WHERE deleted IS NULL)
SELECT project_id, schema_key, version_label, 'duplicate_label' AS violation, count(*) AS n FROM live GROUP BY project_id, schema_key, version_label HAVING count(*) > 1
UNION ALL SELECT project_id, schema_key, '', 'several_active', CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) FROM live GROUP BY project_id, schema_key HAVING count(*) FILTER (WHERE status = 'active') > 1""",
)
def violations(spark: SparkSession, sf: str) -> DataFrame:
    return ops.catalog_violations(versions(spark, sf)).withColumn("version_label", F.coalesce("version_label", F.lit("")))


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """A checklist body per part; each defect appears in a share of them."""
    k, size = F.col("p_partkey"), F.col("p_size")

    def maybe(cond, col):
        return F.when(cond, col)

    fields = F.create_map(
        F.lit("price"), F.struct(
            F.lit("number").alias("type"), F.lit(True).alias("required"), maybe(k % 2 == 0, F.array(F.lit("Price"))).alias("aliases"),
            maybe(k % 5 == 0, F.lit("whatever")).alias("on_ambiguity"), maybe(k % 7 == 0, F.lit(" ")).alias("semantic_role"),
        ),
        F.lit("size"), F.struct(
            F.lit("number").alias("type"), F.lit(False).alias("required"), F.array().cast("array<string>").alias("aliases"),
            F.lit("First Value").alias("on_ambiguity"), F.lit("x").alias("semantic_role"),
        ),
    )
    rule = F.struct(
        F.lit("r1").alias("id"),
        F.when(k % 4 == 0, "price > depth").when(k % 4 == 1, "price >").when(k % 4 == 2, F.lit(None).cast("string")).otherwise("price > size").alias("expression"),
        F.when(k % 3 == 0, F.array(F.lit("price"), F.lit("ghost"))).alias("fields"),
    )
    group = F.struct(
        F.when(size % 2 == 0, "Items").otherwise(" ").alias("section_hint"), F.when(size % 3 == 0, "grid").otherwise("List").alias("structure_hint"),
        F.create_map(F.lit("qty"), F.struct(F.lit("number").alias("type"))).alias("row_fields"),
        F.array(F.struct(F.lit("g").alias("id"), F.when(size % 5 == 0, "tax > 0").otherwise("qty > 0").alias("expression"))).alias("row_rules"),
    )
    summary = F.struct(
        F.when(k % 2 == 0, "Summarise").alias("extract_prompt"), (k % 3 == 0).alias("informative_only"),
        F.array(F.lit("pass"), F.lit("maybe")).alias("evaluation_tags"), F.array(F.lit("price"), F.lit("ghost")).alias("depends_on_fields"),
    )
    body = F.struct(
        F.when(k % 2 == 0, "2").otherwise("3").alias("version"), fields.alias("fields"), F.array(rule).alias("cross_field_rules"),
        F.create_map(F.lit("items"), group).alias("groups"), F.create_map(F.lit("sum"), summary).alias("open_ended"),
        F.struct(F.when(k % 6 == 0, "often").otherwise("never").alias("context_pass"), F.when(k % 6 == 1, "yes").alias("read_images")).alias("extraction"),
    )
    whole = F.to_json(body)
    # A few bodies are no JSON, or have a list where an object belongs.
    text = (
        F.when(k % 97 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1))
        .when(k % 97 == 1, F.lit('{"fields": ["price"], "groups": {"items": 3}}'))
        .when(k % 97 == 2, F.lit('{"version": "3", "fields": {}, "open_ended": ["sum"]}')).otherwise(whole)
    )
    return d.table(spark, sf, "part").select(k.alias("spec_id"), text.alias("body"))


@query(
    "spc06_lint_specs",
    """SELECT p_partkey AS spec_id, x.code, x.subject, x.detail FROM (SELECT *, unnest([
   {'code': CASE WHEN p_partkey % 2 = 0 THEN 'version_3_required' END, 'subject': 'body', 'detail': ''},
   {'code': CASE WHEN p_partkey % 6 = 0 THEN 'bad_context_pass' END, 'subject': 'body', 'detail': 'often'},
   {'code': CASE WHEN p_partkey % 6 = 1 THEN 'read_images_not_boolean' END, 'subject': 'body', 'detail': ''},
   {'code': CASE WHEN p_partkey % 2 <> 0 THEN 'required_without_hint' END, 'subject': 'price', 'detail': ''},
   {'code': CASE WHEN p_partkey % 5 = 0 THEN 'bad_on_ambiguity' END, 'subject': 'price', 'detail': 'whatever'},
   {'code': 'bad_on_ambiguity', 'subject': 'size', 'detail': 'first_value'},
   {'code': CASE WHEN p_partkey % 7 = 0 THEN 'blank_semantic_role' END, 'subject': 'price', 'detail': ''},
   {'code': CASE WHEN p_size % 2 <> 0 THEN 'section_hint_required' END, 'subject': 'items', 'detail': ''},
   {'code': CASE WHEN p_size % 3 = 0 THEN 'bad_structure_hint' END, 'subject': 'items', 'detail': 'grid'},
   {'code': CASE WHEN p_partkey % 2 <> 0 THEN 'extract_prompt_required' END, 'subject': 'sum', 'detail': ''},
   {'code': CASE WHEN p_partkey % 3 <> 0 THEN 'evaluate_prompt_required' END, 'subject': 'sum', 'detail': ''},
   {'code': 'bad_evaluation_tag', 'subject': 'sum', 'detail': 'maybe'}, {'code': 'unknown_depends_on', 'subject': 'sum', 'detail': 'ghost'},
   {'code': CASE WHEN p_partkey % 4 = 0 THEN 'unknown_name' END, 'subject': 'cross_field_rules.r1', 'detail': 'depth'},
   {'code': CASE WHEN p_partkey % 4 = 1 THEN 'bad_expression' END, 'subject': 'cross_field_rules.r1', 'detail': 'price >'},
   {'code': CASE WHEN p_partkey % 4 = 2 THEN 'expression_required' END, 'subject': 'cross_field_rules.r1', 'detail': ''},
   {'code': CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 IN (0, 3) THEN 'unknown_listed_field' END, 'subject': 'cross_field_rules.r1', 'detail': 'ghost'},
   {'code': CASE WHEN p_size % 5 = 0 THEN 'unknown_name' END, 'subject': 'groups.items.g', 'detail': 'tax'}]) AS x FROM part WHERE p_partkey % 97 > 2) WHERE x.code IS NOT NULL
UNION ALL SELECT p_partkey, CASE p_partkey % 97 WHEN 0 THEN 'body_not_object' WHEN 1 THEN 'fields_not_object' ELSE 'open_ended_not_object' END, 'body', '' FROM part WHERE p_partkey % 97 <= 2""",
)
def lint(spark: SparkSession, sf: str) -> DataFrame:
    return ops.lint_specs(bodies(spark, sf)).withColumn("detail", F.coalesce("detail", F.lit("")))


def field_table(spark: SparkSession, sf: str) -> DataFrame:
    """Strict and open-ended field rows, several under names that are not canonical."""
    k, size = F.col("p_partkey"), F.col("p_size")
    names = ("total_amount", "document_total", "invoice_number", "due_date", "fecha_vencimiento", "summary", "code")
    none = F.lit(None).cast("string")
    pos = F.col("pos")
    base = d.table(spark, sf, "part").select(k.alias("spec_id"), size.alias("size"), F.posexplode(F.array(*map(F.lit, names))).alias("pos", "field"))
    spec = F.col("spec_id")
    return base.select(
        "spec_id", "field", F.when(pos == 5, "open_ended").when(pos < 2, "number").otherwise("string").alias("type"), (pos < 3).alias("required"),
        F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
        F.when((pos == 0) & (spec % 2 == 0), F.array(F.lit("Sum"))).alias("aliases"),
        F.when((pos == 2) & (spec % 3 == 0), "[A-Z0-9-]+").when((pos == 2) & (spec % 3 == 1), "id:(.+)").alias("regex_hint"),
        none.alias("on_ambiguity"), F.when((pos == 2) & (spec % 5 == 0), True).alias("llm_fallback"), F.lit(None).cast("boolean").alias("llm_only"),
        none.alias("extraction_hint"), F.when(pos == 0, F.col("size").cast("string")).when(pos == 6, "a.b").alias("equals"),
        none.alias("extract_prompt"), F.when(spec % 2 == 0, "What is it about").alias("description"),
        *(none.alias(c) for c in ("prompt", "extraction_prompt", "task", "instruction", "evaluate_prompt")),
        F.lit(None).cast("boolean").alias("informative_only"), F.lit(None).cast("boolean").alias("link_evidence"),
    )


@query(
    "spc07_normalize_fields",
    """SELECT p_partkey AS spec_id, f.field, CASE f.field WHEN 'total_due' THEN -1.0::DOUBLE ELSE -1 END AS min,
   CASE f.field WHEN 'total_due' THEN 'Importe por pagar' WHEN 'invoice_number' THEN 'Número de factura' WHEN 'due_date' THEN 'Fecha de vencimiento' ELSE '' END AS alias,
   CASE f.field WHEN 'total_due' THEN 'total' WHEN 'due_date' THEN 'date' WHEN 'code' THEN 'literal' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'none' WHEN p_partkey % 3 = 1 THEN 'own' ELSE 'invoice' END END AS pattern,
   CASE WHEN f.field = 'invoice_number' THEN 'first' ELSE '' END AS on_ambiguity, f.field = 'due_date' OR (f.field = 'invoice_number' AND p_partkey % 5 = 0) AS gap_fill,
   f.field = 'total_due' OR (f.field = 'invoice_number' AND p_partkey % 5 = 0) AS hinted
FROM part CROSS JOIN (SELECT unnest(['total_due', 'invoice_number', 'due_date', 'code']) AS field) f""",
)
def normalized_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.normalize_fields(field_table(spark, sf))
    hint = F.col("regex_hint")
    pattern = (
        F.when(hint.isNull(), "none").when(hint.contains("invoice"), "invoice").when(hint.contains("vencimiento"), "date")
        .when(hint.contains("USD"), "total").when(hint == r"(?i)a\.b", "literal").otherwise("own")
    )
    return rows.select(
        "spec_id", "field", F.coalesce("min", F.lit(-1.0)).alias("min"), F.coalesce(F.get(F.col("aliases"), F.lit(0)), F.lit("")).alias("alias"), pattern.alias("pattern"),
        F.coalesce("on_ambiguity", F.lit("")).alias("on_ambiguity"), F.coalesce("llm_fallback", F.lit(False)).alias("gap_fill"),
        F.col("extraction_hint").isNotNull().alias("hinted"),
    )


def open_table(spark: SparkSession, sf: str) -> DataFrame:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    names = F.array(F.lit("summary"), F.lit("pay_terms"))
    return d.table(spark, sf, "part").filter(k % 4 == 0).select(
        k.alias("spec_id"), F.explode(names).alias("field"), none.alias("extract_prompt"), none.alias("description"), F.when(k % 8 == 0, "Terms?").alias("prompt"),
        *(none.alias(c) for c in ("extraction_prompt", "task", "instruction")), F.when(k % 12 == 0, "ok?").alias("evaluate_prompt"),
        F.when(k % 3 == 1, False).alias("informative_only"), F.lit(None).cast("boolean").alias("link_evidence"),
    )


@query(
    "spc07b_normalize_open_ended",
    """SELECT p_partkey AS spec_id, 'summary' AS field, CASE WHEN p_partkey % 2 = 0 THEN 'What is it about' ELSE 'Extract summary' END AS extract_prompt, true AS informative_only, true AS link_evidence, '3' AS version,
   'required,range_validation,type_check' AS rules FROM part
UNION ALL SELECT p_partkey, 'pay_terms', CASE WHEN p_partkey % 8 = 0 THEN 'Terms?' ELSE 'Extract the pay terms from the document.' END,
   p_partkey % 3 = 2, p_partkey % 3 = 2, '3', 'required,range_validation,type_check' FROM part WHERE p_partkey % 4 = 0""",
)
def normalized_open(spark: SparkSession, sf: str) -> DataFrame:
    specs = d.table(spark, sf, "part").select(F.col("p_partkey").alias("spec_id"), F.lit("2").alias("version"), F.array().cast("array<string>").alias("rules"))
    rules = specs.select("spec_id", F.lit("r").alias("id"), F.lit("total_amount > 0").alias("expression"), F.array(F.lit("total_amount")).alias("fields"))
    parts = ops.normalize_specs(specs, field_table(spark, sf), rules, open_table(spark, sf))
    return parts["open_ended"].join(parts["specs"], "spec_id").select(
        "spec_id", "field", "extract_prompt", F.coalesce("informative_only", F.lit(False)).alias("informative_only"),
        F.coalesce("link_evidence", F.lit(False)).alias("link_evidence"), "version", F.array_join("rules", ",").alias("rules"),
    )


@query(
    "spc07c_normalize_rules",
    "SELECT p_partkey AS spec_id, 'total_due - issue_date > total_amounts + ' || p_size AS expression, 'total_due,size' AS fields FROM part",
)
def normalized_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = d.table(spark, sf, "part").select(
        F.col("p_partkey").alias("spec_id"), F.concat(F.lit("amount_due - fecha_emision > total_amounts + "), F.col("p_size").cast("string")).alias("expression"),
        F.array(F.lit("document_total"), F.lit("size")).alias("fields"),
    )
    return ops.normalize_rules(rules).withColumn("fields", F.array_join("fields", ","))


@query(
    "spc08_summarize_specs",
    """SELECT p_partkey AS spec_id, 7::BIGINT AS n_fields, 3::BIGINT AS n_required, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_aliases,
   CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_groups, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS n_open_ended, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_cross_rules FROM part""",
)
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    specs = d.table(spark, sf, "part").select(F.col("p_partkey").alias("spec_id"))
    return ops.summarize_specs(
        specs, field_table(spark, sf), specs.filter("spec_id % 5 != 0"), open_table(spark, sf), specs.filter("spec_id % 3 = 0")
    )


@query("spc09_dedupe_by_name", "SELECT p_name AS name, max(p_partkey) AS ix, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY p_name")
def by_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ix"), F.col("p_brand").alias("brand"))
    return ops.dedupe_by_name(rows)


@query(
    "spc10_seed_defaults",
    """SELECT DISTINCT p_brand || '/' || p_size AS project_id, 'wine_quality' AS schema_key, '1.0' AS version_label, 'active' AS status FROM part p
WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_size = p.p_size AND q.p_partkey % 3 = 0)""",
)
def seeded(spark: SparkSession, sf: str) -> DataFrame:
    part, k = d.table(spark, sf, "part"), F.col("p_partkey")
    project = F.concat(F.col("p_brand"), F.lit("/"), F.col("p_size").cast("string")).alias("project_id")
    specs = part.select(
        project, F.when(k % 3 == 1, "other").otherwise("wine_quality").alias("schema_key"), F.when(k % 3 == 0, "1.0").otherwise("2.0").alias("version_label")
    )
    return ops.seed_defaults(part.select(project).distinct(), specs)
