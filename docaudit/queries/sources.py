"""Sources and sinks over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import exploding, number_text
from docaudit.operators import views
from docaudit.plans import datasets as d
from docaudit.plans.validation import validate_documents
from docaudit.sources import blocks as b
from docaudit.sources import delimited, replies, sinks, uploads
from docaudit.streaming.validate import run_rows

from .registry import query, scratch_folder
from .sql import BLOCKS, REPORT_CONTENTS, REPORT_STATUS, RUN_ROWS, RUNS


def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    doc, k = d.table(spark, sf, "documents"), F.col("doc_id")
    return doc.select(
        k, F.col("lang").alias("project_id"), F.col("source").alias("schema_key"),
        F.concat(F.lit("1."), (k % 4).cast("string")).alias("version_label"),
        F.concat(F.lit("in/"), "source", F.lit("/"), k.cast("string"), F.when(k % 7 == 0, ".txt").otherwise(".PDF")).alias("filename"),
        F.when(k % 5 == 0, "application/PDF").otherwise("application/octet-stream").alias("mime"),
        (F.col("n_chars") * 1700).alias("n_bytes"),
    )


def _upload_specs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = d.table(spark, sf, "documents").select(F.col("lang").alias("project_id"), F.col("source").alias("schema_key")).distinct()
    return pairs.withColumn("version_label", F.explode(F.array(*map(F.lit, ("1.0", "1.1", "1.2"))))).withColumn(
        "status", F.when(F.col("version_label") == "1.1", "archived").otherwise("active")
    )


@query(
    "src01_admit_uploads",
    """SELECT doc_id, doc_id || CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.PDF' END AS filename,
       reason = '' AS accepted, reason
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unknown_checklist' WHEN doc_id % 4 = 1 THEN 'inactive_checklist'
        WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'not_pdf' WHEN n_chars * 1700 > 31457280 THEN 'too_large' ELSE '' END AS reason
      FROM documents)""",
)
def admit(spark: SparkSession, sf: str) -> DataFrame:
    out = uploads.admit_uploads(_uploads(spark, sf), _upload_specs(spark, sf))
    return out.select("doc_id", "filename", "accepted", F.coalesce("reason", F.lit("")).alias("reason"))


@query("src02_with_fingerprint", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return uploads.with_fingerprint(d.table(spark, sf, "documents"), "text").select("doc_id", "content_hash")


@query(
    "src03_duplicate_uploads",
    """SELECT 'sha256:' || sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id
FROM documents GROUP BY text HAVING count(*) > 1""",
)
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return uploads.duplicate_uploads(d.table(spark, sf, "documents"), "doc_id", "text")


@query(
    "src04_dedupe_queue",
    """SELECT user_id, event_type, min(event_id) AS event_id, user_id || '_' || event_type || '.pdf' AS filename
FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, event_type""",
)
def queue(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.when(F.col("event_id") % 3 == 0, ".txt").otherwise(".pdf")
    files = d.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.concat(F.col("user_id").cast("string"), F.lit("_"), "event_type", ending).alias("filename")
    )
    return uploads.dedupe_queue(files, ["user_id", "event_type"], "event_id")


def layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Layout JSON per order: two kept texts, two that must vanish, a table, pictures and spans."""

    def prov(page: int, left, top, right, bottom, keep=None):
        box = F.struct(*(F.lit(v).cast("double").alias(k) if isinstance(v, int | float) else v.alias(k)
                         for k, v in zip("ltrb", (left, top, right, bottom))))
        item = F.struct(F.lit(page).alias("page_no"), box.alias("bbox"))
        return F.array(item) if keep is None else F.filter(F.array(item), lambda _: keep)

    def text(t, orig, label, p):
        return F.struct(t.alias("text"), orig.alias("orig"), label.alias("label"), p.alias("prov"))

    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    texts = F.array(
        text(F.format_string("Order %d", k), none, F.lit("title"), prov(1, 10, 800, 200, 790)),
        text(F.lit(""), F.concat(F.lit(" Status: "), "o_orderstatus"), F.lit(""), prov(1, 10, 780, 90, 770)),
        text(F.lit("   "), none, F.lit("text"), prov(1, 10, 760, 90, 750)),
        text(F.lit("no place"), none, F.lit("text"), prov(1, 0, 0, 0, 0, F.lit(False))),
    )
    cells = F.transform(
        "items", lambda i: F.array(i["l_linenumber"].cast("string"), F.lit(" "), F.format_string("%.0f", i["l_quantity"]))
    )
    tables = F.array(F.struct(cells.alias("data"), prov(2, 20, 500, 300, 400).alias("prov")))
    pictures = F.array(
        F.struct(F.array(F.lit("stamp")).alias("captions"), prov(1, 1, 100, 50, 60, k % 3 != 0).alias("prov")),
        F.struct(F.array().cast("array<string>").alias("captions"), prov(2, 5, 90, 40, 50).alias("prov")),
    )
    spans = F.transform(
        "items",
        lambda i, n: F.struct(
            F.format_string("%.2f", i["l_extendedprice"]).alias("text"), F.lit(9.5).alias("size"),
            F.array(
                F.struct(
                    F.lit(1).alias("page_no"),
                    F.struct((i["l_quantity"] * 10).alias("l"), (n * 12 + 10).cast("double").alias("t"),
                             (i["l_quantity"] * 10 + 40).alias("r"), (n * 12).cast("double").alias("b")).alias("bbox"),
                )
            ).alias("prov"),
        ),
    )
    pages = F.create_map(
        F.lit("1"), F.struct(F.lit(1).alias("page_no"), F.struct(F.lit(1000.0).alias("height")).alias("size")),
        F.lit("2"), F.struct(F.lit(None).cast("int").alias("page_no"), F.struct(F.lit(None).cast("double").alias("height")).alias("size")),
    )
    body = F.struct(
        texts.alias("texts"), tables.alias("tables"), pictures.alias("pictures"), spans.alias("spans"), pages.alias("pages")
    )
    return d.order_lines(spark, sf).select(k.alias("doc_id"), F.to_json(body).alias("layout"))


_TABLE_TEXT = """cells AS (SELECT l_orderkey, string_agg(l_linenumber || ' | ' || printf('%.0f', l_quantity), chr(10)
  ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount) AS text FROM lineitem GROUP BY l_orderkey)"""


@query(
    "src05_blocks_from_layout_json",
    f"""WITH {_TABLE_TEXT}
SELECT o_orderkey AS doc_id, 'b0' AS block_id, 1 AS page, 10.0::DOUBLE AS x0, 200.0::DOUBLE AS y0, 200.0::DOUBLE AS x1, 210.0::DOUBLE AS y1,
       'Order ' || o_orderkey AS text, 'title' AS section_label FROM orders
UNION ALL SELECT o_orderkey, 'b1', 1, 10.0, 220.0, 90.0, 230.0, 'Status: ' || o_orderstatus, '' FROM orders
UNION ALL SELECT o_orderkey, 'b2', 2, 20.0, 342.0, 300.0, 442.0, text, 'table' FROM orders JOIN cells ON l_orderkey = o_orderkey""",
)
def layout_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.explode_blocks(b.blocks_from_layout_json(layouts(spark, sf)))
    return rows.select(
        "doc_id", "block_id", "page", "x0", "y0", "x1", "y1", "text", F.coalesce("section_label", F.lit("")).alias("section_label")
    )


@query(
    "src06_flip_bbox",
    """SELECT l_orderkey AS doc_id, l_linenumber % 3 AS page, l_quantity AS x0, h - l_quantity * 5 AS y0, l_quantity + 30 AS x1,
       h - l_quantity * 5 + 10 AS y1
FROM (SELECT *, CASE WHEN l_linenumber % 3 = 1 THEN coalesce(800.0::DOUBLE + o_orderkey % 100, 842.0) ELSE 842.0::DOUBLE END AS h
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)""",
)
def flipped(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    boxes = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 3).alias("page"),
        q.alias("l"), (q * 5).alias("t"), (q + 30).alias("r"), (q * 5 - 10).alias("b"),
    )
    k = F.col("o_orderkey")
    pages = d.table(spark, sf, "orders").select(
        k.alias("doc_id"), F.inline(F.array(
            F.struct(F.lit(1).alias("page"), (k % 100 + 800.0).alias("height")),
            F.struct(F.lit(2).alias("page"), F.lit(None).cast("double").alias("height")),
        ))
    )
    return b.flip_bbox(boxes, pages)


@query("src07_table_cells_text", f"WITH {_TABLE_TEXT} SELECT l_orderkey AS doc_id, text FROM cells")
def cells(spark: SparkSession, sf: str) -> DataFrame:
    parsed = b.read_layout(layouts(spark, sf))
    rows = parsed.select("doc_id", b.table_cells_text(F.get(F.col("layout.tables"), F.lit(0))["data"]).alias("text"))
    return rows.filter("text != ''")


@query(
    "src08_pictures_from_layout_json",
    """SELECT o_orderkey AS doc_id, 'img0' AS picture_id, 1 AS page, 900.0::DOUBLE AS y0, 940.0::DOUBLE AS y1, 'stamp' AS caption FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'img1', 2, 752.0, 792.0, '' FROM orders""",
)
def pictures(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.pictures_from_layout_json(layouts(spark, sf))
    return rows.select("doc_id", "picture_id", "page", "y0", "y1", F.coalesce("caption", F.lit("")).alias("caption"))


@query("src09_blocks_from_text", f"WITH {BLOCKS} SELECT doc_id, block_ix, 'b' || block_ix AS block_id, text, (pos - 1) * 12.0::DOUBLE AS y0 FROM blocks")
def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.explode_blocks(b.blocks_from_text(d.table(spark, sf, "documents")))
    return rows.select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), "block_id", "text", "y0")


@query(
    "src10_spans_from_layout_json",
    """SELECT doc_id, 's' || n AS block_id, text, l_quantity * 10 AS x0, 1000 - (n * 12.0::DOUBLE + 10) AS y0, 9.5::DOUBLE AS font_size_max
FROM (SELECT l_orderkey AS doc_id, l_quantity, printf('%.2f', l_extendedprice) AS text,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount) - 1 AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
)
def span_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.spans_from_layout_json(layouts(spark, sf)).select("doc_id", F.inline(exploding(F.col("spans"))))
    return rows.select("doc_id", "block_id", "text", "x0", "y0", "font_size_max")


@query(
    "src11_read_measurements",
    "SELECT p_partkey AS sample, p_size / 10.0::DOUBLE AS ph, CAST(p_size AS BIGINT) AS quality, p_brand AS maker FROM part",
)
def measurements(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_folder(spark)
    rows = d.table(spark, sf, "part").select(
        F.col("p_partkey").alias("sample"), (F.col("p_size") / 10).alias("ph"), F.col("p_size").cast("long").alias("quality"),
        F.col("p_brand").alias("maker"),
    )
    delimited.write_measurements(rows, path)
    return delimited.read_measurements(spark, path, "sample long, ph double, quality long, maker string")


@query(
    "src12_parse_model_replies",
    """SELECT o_orderkey AS doc_id, printf('%.2f', o_totalprice) AS total, o_orderstatus AS status FROM orders WHERE o_orderkey % 4 <> 2""",
)
def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.format_string("%.2f", "o_totalprice").alias("total"), F.col("o_orderstatus").alias("status")))
    reply = (
        F.when(k % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
        .when(k % 4 == 1, body).when(k % 4 == 2, F.concat(F.lit("no json "), body))
        .otherwise(F.concat(F.lit("```\n"), body, F.lit("\n``` bye")))
    )
    rows = d.table(spark, sf, "orders").select(k.alias("doc_id"), reply.alias("reply"))
    parsed = replies.parse_model_replies(rows, "total string, status string")
    return parsed.select("doc_id", "parsed.total", "parsed.status")


@query(
    "snk01_write_runs",
    f"WITH {RUN_ROWS}",
)
def written_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole run rows, written by project and read back."""
    path = scratch_folder(spark)
    docs = d.order_texts(d.order_lines(spark, sf)).withColumn("project_id", F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")))
    sinks.write_runs(run_rows(sinks.placed(docs), d.ORDER_CHECKLIST), path, in_place=True)
    return shown_runs(sinks.read_runs(spark, path))


def block_texts() -> Column:
    return F.array_join(F.col("snapshots.blocks")["text"], "\n")


def resolved_texts() -> Column:
    """``field=value`` of the stored resolved values."""
    return F.array_join(F.transform("snapshots.resolved_document", lambda r: F.concat(r["field"], F.lit("="), F.coalesce(r["value"]["str"], number_text(r["value"]["num"])))), ",")


def conflict_texts() -> Column:
    return F.array_join(F.transform("snapshots.inconsistency_report.ambiguous_fields", lambda a: F.concat(a["field"], F.lit(":"), a["count"].cast("string"))), ",")


def shown_runs(stored: DataFrame) -> DataFrame:
    """Contents of stored run rows: text, values, conflicts and hash as they are, failures counted from the report."""
    return stored.select(
        "doc_id", "project_id", "outcome", "schema_key", "version_label", F.size(F.filter("report", lambda o: ~o["passed"])).cast("long").alias("n_failed"),
        block_texts().alias("text"), resolved_texts().alias("resolved"), "content_hash", F.element_at("snapshots.blocks", -1)["block_id"].alias("last_block"),
        conflict_texts().alias("conflicts"), F.size("attributes").alias("n_tags"), F.col("created_at").isNotNull().alias("dated"), "revision_number",
    )


@query(
    "snk02_build_snapshots",
    f"""WITH {REPORT_CONTENTS} SELECT doc_id, text, resolved, CASE WHEN has_second THEN 'total_due:2' ELSE '' END AS conflicts,
   'item_count:found,order_number:found,status:found,total_due:' || CASE WHEN has_second THEN 'ambiguous' WHEN has_total THEN 'found' ELSE 'missing' END AS fields,
   'order_number=' || doc_id || CASE WHEN has_total THEN '|total_due=' || printf('Total due: %.2f', total) ELSE '' END || CASE WHEN has_second THEN '|total_due=' || printf('Total due: %.2f', total + 100) ELSE '' END
     || '|item_count=Items: ' || n_items || '|status=Status: ' || status AS candidates
FROM verdict JOIN contents USING (doc_id)""",
)
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    snaps = sinks.build_snapshots(validate_documents(d.order_reports(spark, sf), d.ORDER_CHECKLIST, measurements=False))
    entry = F.transform("snapshots.field_candidate_map", lambda e: F.concat(e["field"], F.lit(":"), e["status"]))
    shown = F.transform("snapshots.candidates", lambda c: F.concat(c["field"], F.lit("="), F.when(c["field"] == "order_number", number_text(c["value"]["num"])).otherwise(c["evidence_text"])))
    return snaps.select(
        "doc_id", block_texts().alias("text"), resolved_texts().alias("resolved"), conflict_texts().alias("conflicts"),
        F.array_join(entry, ",").alias("fields"), F.array_join(shown, "|").alias("candidates"),
    )


@query(
    "snk03_export_runs_csv",
    f"""WITH {RUNS} SELECT '"' || project_id || ', ' || document_filename || '",' || schema_key || ',' || version_label || ',' || outcome || ','
   || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z,' || id AS line FROM runs
UNION ALL SELECT 'document_filename,schema_key,version_label,outcome,created_at,run_id'""",
)
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    """The written files read back as text; their headers count once."""
    named = d.runs(spark, sf).withColumn("document_filename", F.concat_ws(", ", "project_id", "document_filename"))
    path = scratch_folder(spark)
    sinks.export_runs_csv(named, path)
    lines, header = spark.read.text(path).withColumnRenamed("value", "line"), F.col("line").startswith("document_filename,")
    return lines.filter(~header).unionByName(lines.filter(header).distinct())


@query(
    "snk04_export_runs_json",
    f"""WITH {RUNS} SELECT id AS run_id, '{{"document_filename":"' || document_filename || '","schema_key":"' || schema_key || '","version_label":"'
   || version_label || '","outcome":"' || outcome || '","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","run_id":' || id || '}}' AS line FROM runs
UNION ALL SELECT -1, '{{"count":' || count(*) || '}}' FROM runs""",
)
def json_export(spark: SparkSession, sf: str) -> DataFrame:
    """The written lines and the summary read back as text."""
    path = scratch_folder(spark)
    sinks.export_runs_json(d.runs(spark, sf), path)
    rows = spark.read.text(f"{path}/runs").select(F.get_json_object("value", "$.run_id").cast("long").alias("run_id"), F.col("value").alias("line"))
    return rows.unionByName(spark.read.text(f"{path}/summary").select(F.lit(-1).cast("long").alias("run_id"), F.col("value").alias("line")))


FIELD_ROWS_SQL = f"""{REPORT_STATUS},
amount AS (SELECT doc_id, CASE WHEN total = floor(total) THEN CAST(CAST(total AS BIGINT) AS VARCHAR) ELSE CAST(total AS VARCHAR) END AS t1,
             CASE WHEN second = floor(second) THEN CAST(CAST(second AS BIGINT) AS VARCHAR) ELSE CAST(second AS VARCHAR) END AS t2 FROM rep),
field_rows AS (
  SELECT doc_id AS run_id, 'order_number' AS field, 'number · required · 1 aliases' AS expected, CAST(doc_id AS VARCHAR) AS extracted,
         'resolved' AS status FROM verdict
  UNION ALL SELECT doc_id, 'total_due', 'number · required · 0 – 300000 · 2 aliases',
         CASE WHEN has_second THEN t1 || ' SEP ' || t2 WHEN has_total THEN t1 ELSE '—' END,
         CASE WHEN has_second THEN 'ambiguous' WHEN NOT has_total OR total > 300000 OR n_items = 0 OR total / n_items > 200000 THEN 'failed'
              ELSE 'resolved' END FROM verdict JOIN amount USING (doc_id)
  UNION ALL SELECT doc_id, 'status', 'string · required · 1 aliases', status, 'resolved' FROM verdict
  UNION ALL SELECT doc_id, 'item_count', 'number · optional · 1 aliases', CAST(n_items AS VARCHAR), 'resolved' FROM verdict)"""


def order_field_rows(spark: SparkSession, sf: str) -> DataFrame:
    results = validate_documents(d.order_reports(spark, sf), d.ORDER_CHECKLIST, measurements=False)
    return views.field_rows(results, d.ORDER_CHECKLIST)


@query(
    "snk05_export_field_rows",
    f"""WITH {FIELD_ROWS_SQL} SELECT run_id, field, expected, replace(extracted, ' SEP ', ' | ') AS extracted,
   CASE status WHEN 'resolved' THEN 'Resolved' WHEN 'ambiguous' THEN 'Ambiguous' WHEN 'failed' THEN 'Rule failed' END AS status FROM field_rows""",
)
def field_export(spark: SparkSession, sf: str) -> DataFrame:
    """The written files, read back."""
    path = scratch_folder(spark)
    sinks.export_field_rows(order_field_rows(spark, sf), path)
    return spark.read.schema("run_id long, field string, expected string, extracted string, status string").option("header", True).option("escape", '"').csv(path)


@query(
    "snk05b_export_run_json",
    f"""WITH {REPORT_CONTENTS} SELECT doc_id AS run_id, 'p' || (doc_id % 3) AS project_id, outcome, resolved,
   CASE WHEN has_second THEN 'total_due:' || printf('Total due: %.2f', total) || '@b2,' || printf('Total due: %.2f', total + 100) || '@b3' ELSE '' END AS conflicts,
   CASE WHEN has_second THEN '' ELSE 'b1' || CASE WHEN has_total THEN ',b2' ELSE '' END || ',b' || status_ix || ',b' || (status_ix + 1) END AS evidence,
   CASE WHEN outcome = 'AMBIGUOUS' THEN 0 ELSE CAST(NOT has_total AS BIGINT) + CAST(has_total AND total > 300000 AS BIGINT) + CAST(has_total AND (n_items = 0 OR total / n_items > 200000) AS BIGINT) + CAST(n_items = 0 AS BIGINT) + n_bad END AS n_failed,
   'item_count,order_number,status,total_due' AS fields
FROM verdict JOIN contents USING (doc_id)""",
)
def run_json_export(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object a run, written and read back."""
    docs = d.order_reports(spark, sf).withColumn("project_id", F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")))
    results = validate_documents(docs, d.ORDER_CHECKLIST, measurements=False, keep=("doc_id", "project_id"))
    path = scratch_folder(spark)
    sinks.export_run_json(sinks.run_json(results, views.field_row_array(d.ORDER_CHECKLIST), meta=("project_id",)), path)
    body = (
        "run_id long, project_id string, outcome string, resolved_values array<struct<field:string,value:string,evidence:struct<block_id:string>>>, "
        "ambiguous_fields array<struct<field:string,candidates:array<struct<value:string,evidence:string,block_id:string>>>>, "
        "field_rule_outcomes array<struct<passed:boolean>>, fields array<struct<field:string,status:string>>"
    )
    conflict = F.transform("ambiguous_fields", lambda a: F.concat(a["field"], F.lit(":"), F.array_join(F.transform(a["candidates"], lambda c: F.concat(c["evidence"], F.lit("@"), c["block_id"])), ",")))
    return spark.read.schema(body).json(path).select(
        "run_id", "project_id", "outcome", F.array_join(F.transform("resolved_values", lambda r: F.concat(r["field"], F.lit("="), r["value"])), ",").alias("resolved"),
        F.array_join(conflict, ";").alias("conflicts"), F.array_join(F.col("resolved_values")["evidence"]["block_id"], ",").alias("evidence"),
        F.size(F.filter("field_rule_outcomes", lambda o: ~o["passed"])).cast("long").alias("n_failed"), F.array_join(F.col("fields")["field"], ",").alias("fields"),
    )


@query(
    "snk06_audit_summary",
    f"""WITH {RUNS} SELECT 'outcome' AS part, project_id, outcome AS name, count(*) AS n FROM runs GROUP BY project_id, outcome
UNION ALL SELECT 'latest', project_id, document_filename, id
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k FROM runs) WHERE k <= 25""",
)
def audit(spark: SparkSession, sf: str) -> DataFrame:
    counts, latest = sinks.audit_summary(d.runs(spark, sf))
    return counts.select(F.lit("outcome").alias("part"), "project_id", F.col("outcome").alias("name"), "n").unionByName(
        latest.select(F.lit("latest").alias("part"), "project_id", F.col("document_filename").alias("name"), F.col("id").alias("n"))
    )
