"""Mapping, conflicts, resolution and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import exploding, field_key, let
from docaudit.functions.values import canonical, value
from docaudit.operators import evidence, extraction, mapping
from docaudit.plans import datasets as d
from docaudit.plans.checklist import Checklist, literal_table, spec_column
from docaudit.plans.validation import field_rows_of, validate_documents
from docaudit.sources.blocks import text_blocks

from .blocks import item_spans
from .registry import query
from .sql import BLOCKS, REPORT_STATUS, REPORTS, SPANS

EVENT_FIELDS = ("page_view", "click", "checkout", "signup", "never_seen")


def event_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Events as candidates of one document per user: numbers, and texts for purchases."""
    k = F.col("event_id")
    is_text = F.col("event_type") == "purchase"
    return d.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), k.alias("cand_ix"),
        F.when(F.col("event_type") == "view", "Page-View").when(is_text, "Check Out").otherwise(F.col("event_type")).alias("field"),
        F.when(~is_text, F.floor(F.col("value") / 400).cast("double")).alias("value_num"),
        F.when(is_text, F.when(k % 2 == 0, " Two  Words").otherwise("two words")).alias("value_str"),
        F.element_at(F.array(*map(F.lit, ("regex", "layout", "llm", "vision"))), (k % 4 + 1).cast("int")).alias("source"),
        (k % 10 / 10).alias("confidence"),
        F.concat(F.when(k % 5 == 0, "s").otherwise("b"), (k % 50).cast("string")).alias("block_id"),
        (k % 3).cast("int").alias("page"),
    )


def event_fields(spark: SparkSession) -> DataFrame:
    rows = [("page_view", [], True, "number", False), ("click", ["SIGNUP"], False, "number", False),
            ("checkout", ["check_out"], True, "string", True), ("signup", [], False, "date", False), ("never_seen", [], True, "date", False)]
    names = ("field", "aliases", "required", "type", "llm_fallback")
    return literal_table(
        spark, [dict(zip(names, r)) for r in rows],
        "field string, aliases array<string>, required boolean, type string, llm_fallback boolean",
    )


_CANDS = """cands AS (
  SELECT user_id AS doc_id, event_id AS cand_ix, event_type, CASE WHEN event_type <> 'purchase' THEN floor(value / 400) END AS value_num,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN ' Two  Words' ELSE 'two words' END END AS value_str
  FROM events),
mapped AS (
  SELECT *, unnest(CASE event_type WHEN 'view' THEN ['page_view'] WHEN 'click' THEN ['click'] WHEN 'signup' THEN ['click', 'signup']
     WHEN 'purchase' THEN ['checkout'] ELSE [] END) AS schema_field FROM cands),
heads AS (
  SELECT doc_id, schema_field, arg_min(value_num, cand_ix) FILTER (WHERE value_num IS NOT NULL) AS hn, arg_min(value_str, cand_ix) AS hs FROM mapped GROUP BY ALL),
stats AS (
  SELECT doc_id, schema_field, count(*) AS n, bool_or(coalesce(abs(value_num - hn) > 0.001, value_str <> hs)) AS differs
  FROM mapped JOIN heads USING (doc_id, schema_field) GROUP BY ALL),
field_map AS (
  SELECT u.doc_id, f.field, CASE WHEN n IS NULL THEN 'missing' WHEN differs THEN 'ambiguous' ELSE 'found' END AS status, coalesce(n, 0) AS n_candidates
  FROM (SELECT DISTINCT user_id AS doc_id FROM events) u
  CROSS JOIN (SELECT unnest(['page_view', 'click', 'checkout', 'signup', 'never_seen']) AS field) f
  LEFT JOIN stats ON stats.doc_id = u.doc_id AND schema_field = field)"""


@query("map01_norm_field", "SELECT p_partkey AS id, replace(replace(lower(p_name || '-' || p_type || ' X'), ' ', '_'), '-', '_') AS name FROM part")
def norm(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("-"), "p_type", F.lit(" X"))
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), field_key(raw).alias("name"))


@query("map02_map_candidates", f"WITH {_CANDS} SELECT doc_id, cand_ix, schema_field FROM mapped")
def mapped(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.map_candidates(event_candidates(spark, sf), event_fields(spark)).select("doc_id", "cand_ix", "schema_field")


def event_field_map(spark: SparkSession, sf: str) -> DataFrame:
    m = mapping.map_candidates(event_candidates(spark, sf), event_fields(spark))
    docs = d.table(spark, sf, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return mapping.classify_fields(m, EVENT_FIELDS, docs)


@query("map03_classify_fields", f"WITH {_CANDS} SELECT doc_id, field, status, n_candidates FROM field_map")
def classified(spark: SparkSession, sf: str) -> DataFrame:
    return event_field_map(spark, sf)


@query(
    "map04_inconsistencies",
    f"""WITH {_CANDS} SELECT doc_id, bool_or(status = 'ambiguous') AS has_ambiguity, CAST(count(*) FILTER (WHERE status = 'ambiguous') AS BIGINT) AS n_ambiguous,
   coalesce(string_agg(field || ':' || n_candidates, ',' ORDER BY field) FILTER (WHERE status = 'ambiguous'), '') AS fields FROM field_map GROUP BY doc_id""",
)
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = mapping.inconsistencies(event_field_map(spark, sf))
    text = F.transform("ambiguous_fields", lambda a: F.concat(a["field"], F.lit(":"), a["n_candidates"].cast("string")))
    return rows.select("doc_id", "has_ambiguity", "n_ambiguous", F.array_join(text, ",").alias("fields"))


@query("map05_unmatched", f"WITH {_CANDS} SELECT doc_id, cand_ix FROM cands WHERE event_type = 'error'")
def unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.unmatched(event_candidates(spark, sf), event_fields(spark)).select("doc_id", "cand_ix")


@query(
    "map06_canonical_value",
    """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'INV-' || o_orderkey WHEN 1 THEN o_orderkey || ' de mayo de 2024'
   WHEN 2 THEN o_orderpriority || ' x' WHEN 3 THEN 'Ab' || o_orderkey ELSE '' END AS str,
   CASE WHEN o_orderkey % 5 = 4 THEN o_totalprice END AS num FROM orders WHERE o_orderkey % 5 <> 1 OR o_orderkey < 100
UNION ALL SELECT o_orderkey, right(CAST(o_orderkey AS VARCHAR), 2) || ' de mayo de 2024', NULL FROM orders WHERE o_orderkey % 5 = 1 AND o_orderkey >= 100""",
)
def canonical_values(spark: SparkSession, sf: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    field = F.element_at(F.array(*map(F.lit, ("invoice_number", "fecha_emision", "note", "my_invoice_number", "total"))), (k + 1).cast("int"))
    text = (
        F.when(k == 0, F.concat(F.lit(" INV-"), key, F.lit("Total due 7")))
        .when(k == 1, F.concat(F.lit("el "), key, F.lit("  de MAYO de 2024 Lima")))
        .when(k == 2, F.concat(F.lit("  "), "o_orderpriority", F.lit(" \t x ")))
        .when(k == 3, F.concat(F.lit("Ab"), key, F.lit(" x")))
    )
    v = canonical(field, value(F.when(k == 4, F.col("o_totalprice")), text))
    rows = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), v.alias("v"))
    return rows.select("id", F.coalesce("v.str", F.lit("")).alias("str"), "v.num")


@query(
    "map07_dedupe_candidates",
    f"""WITH {_CANDS} SELECT doc_id, min(cand_ix) AS cand_ix FROM cands
GROUP BY doc_id, event_type, value_num, regexp_replace(lower(trim(value_str)), '\\s+', ' ', 'g'),
         CASE WHEN cand_ix % 5 = 0 THEN 's' ELSE 'b' END || (cand_ix % 50)""",
)
def deduped(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.dedupe_candidates(event_candidates(spark, sf)).select("doc_id", "cand_ix")


def settled(spark: SparkSession, sf: str, policy: str | None = None) -> DataFrame:
    body = {k: dict(v) for k, v in d.ORDER_CHECKLIST.body["fields"].items()}
    if policy:
        body["total_due"]["on_ambiguity"] = policy
    spec = Checklist.from_body("order_report", {**d.ORDER_CHECKLIST.body, "fields": body})
    return validate_documents(d.order_reports(spark, sf), spec, measurements=False)


@query(
    "map08_reconcile",
    f"""WITH {REPORTS} SELECT doc_id, 'order_number' AS field, 'found' AS status, 1::BIGINT AS n_candidates FROM rep
UNION ALL SELECT doc_id, 'total_due', CASE WHEN has_second THEN 'ambiguous' WHEN has_total THEN 'found' ELSE 'missing' END,
   CASE WHEN has_second THEN 2 WHEN has_total THEN 1 ELSE 0 END FROM rep
UNION ALL SELECT doc_id, 'status', 'found', 1 FROM rep UNION ALL SELECT doc_id, 'item_count', 'found', 1 FROM rep""",
)
def reconciled(spark: SparkSession, sf: str) -> DataFrame:
    return field_rows_of(settled(spark, sf))


@query(
    "map08b_reconcile_spellings",
    """WITH p AS (SELECT p_partkey AS doc_id, p_partkey % 27 + 1 AS day, p_partkey % 3 = 0 AS twice, p_partkey % 4 = 0 AS other FROM part)
SELECT doc_id, CASE WHEN other THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN other THEN 2 + CAST(twice AS BIGINT) ELSE 1 END AS n_candidates,
   lower(day || ' de marzo de 2031') AS first_value, twice FROM p""",
)
def reconciled_spellings(spark: SparkSession, sf: str) -> DataFrame:
    """One date in two spellings is one value; another date is a conflict."""
    spec = Checklist.from_body("dated", {"fields": {"issue_date": {"type": "date", "required": True}}})
    k = F.col("p_partkey")
    day = (k % 27 + 1).cast("int")
    text = F.concat_ws(
        "\n", F.format_string("Issue date: %d de marzo de 2031", day), F.when(k % 3 == 0, F.format_string("ISSUE DATE %d de  Marzo de  2031.", day)),
        F.when(k % 4 == 0, F.format_string("Issue date %d de abril de 2031", day)),
    )
    docs = d.table(spark, sf, "part").select(k.alias("doc_id"), text_blocks(text).alias("blocks"), (k % 3 == 0).alias("twice"))
    found = validate_documents(docs, spec, measurements=False, keep=("doc_id", "twice"))
    entry = F.get("field_map", F.lit(0))
    return found.select(
        "doc_id", entry["status"].alias("status"), F.size(entry["candidates"]).cast("long").alias("n_candidates"),
        F.lower(F.get(entry["candidates"], F.lit(0))["value"]["str"]).alias("first_value"), "twice",
    )


@query(
    "map09_apply_policies",
    f"""WITH {REPORTS} SELECT doc_id, CASE WHEN has_second THEN second ELSE total END AS last_total, total AS first_total FROM rep WHERE has_total""",
)
def policies(spark: SparkSession, sf: str) -> DataFrame:
    fields = spec_column(d.ORDER_CHECKLIST)["fields"]

    def by(strategy: str):
        return lambda m: F.get(
            F.filter(mapping.with_policies(m, F.transform(fields, lambda f: f.withField("strategy", F.lit(strategy)))), lambda e: e["field"] == "total_due"),
            F.lit(0),
        )["candidates"]

    def both(b):
        cands = let(let(fields, lambda fs: extraction.ensemble(b, fs, False)), mapping.deduped)
        return let(
            let(cands, lambda cs: mapping.field_map(cs, fields)),
            lambda m: F.struct(
                F.get(let(m, by("last")), F.lit(0))["value"]["num"].alias("last_total"),
                F.get(let(m, by("first")), F.lit(0))["value"]["num"].alias("first_total"),
            ),
        )

    # A filter above the projection would be pushed below it and compute everything a second time.
    stated = let(let(F.col("blocks"), both), lambda t: F.when(t["first_total"].isNotNull(), F.array(t)))
    return d.order_reports(spark, sf).select("doc_id", F.inline(exploding(stated)))


@query(
    "map10_resolve",
    """SELECT user_id AS doc_id, event_type AS name, arg_min(event_id, printf('%d %.1f %012d %012d', event_id % 4, 1 - event_id % 10 / 10.0,
     CASE WHEN event_id % 5 = 0 THEN 1000000000 ELSE event_id % 50 END, event_id)) AS cand_ix FROM events GROUP BY ALL""",
)
def resolved(spark: SparkSession, sf: str) -> DataFrame:
    names = F.when(F.col("field") == "Page-View", "view").when(F.col("field") == "Check Out", "purchase").otherwise(F.col("field"))
    return mapping.resolve(event_candidates(spark, sf)).select("doc_id", names.alias("name"), "cand_ix")


@query(
    "map11_evidence",
    f"""WITH {REPORT_STATUS} SELECT doc_id, 'total_due' AS field, printf('Total due: %.2f', total) AS text, 'b2' AS block_id, 24.0::DOUBLE AS y0 FROM verdict WHERE has_total AND NOT has_second
UNION ALL SELECT doc_id, 'status', 'Status: ' || status, 'b' || status_ix, status_ix * 12.0::DOUBLE FROM verdict WHERE NOT has_second
UNION ALL SELECT doc_id, 'order_number', 'Order number: ' || doc_id, 'b1', 12.0::DOUBLE FROM verdict WHERE NOT has_second
UNION ALL SELECT doc_id, 'item_count', 'Items: ' || n_items, 'b' || (status_ix + 1), (status_ix + 1) * 12.0::DOUBLE FROM verdict WHERE NOT has_second""",
)
def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = settled(spark, sf).select("doc_id", F.inline(exploding(F.col("resolved"))))
    return rows.select("doc_id", "field", "evidence.text", "evidence.block_id", "evidence.y0")


@query(
    "map12_missing_required",
    f"""WITH {_CANDS} SELECT doc_id, field, 'required' AS kind FROM field_map WHERE status = 'missing' AND field IN ('page_view', 'checkout', 'never_seen')
UNION ALL SELECT doc_id, field, 'gap_fill' FROM field_map WHERE status = 'missing' AND field IN ('checkout', 'signup', 'never_seen')""",
)
def missing(spark: SparkSession, sf: str) -> DataFrame:
    entries, fields = event_field_map(spark, sf), event_fields(spark)
    required = mapping.missing_required(entries, fields).select("doc_id", "field", F.lit("required").alias("kind"))
    return required.unionByName(mapping.gapfill_targets(entries, fields).select("doc_id", "field", F.lit("gap_fill").alias("kind")))


@query(
    "map13_plan_contextual",
    f"""WITH {REPORTS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'item_count,order_number,status,total_due'
   ELSE 'status' || CASE WHEN has_second OR NOT has_total THEN ',total_due' ELSE '' END END AS wanted FROM rep""",
)
def contextual_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Never, always, or where needed: missing and conflicting fields, not those that one pattern alone has read."""
    modes = ("never", "always", "when_needed")
    specs = [spec_column(Checklist.from_body(m, d.ORDER_CHECKLIST.body | {"extraction": {"context_pass": m}})) for m in modes]

    def plan(spec):
        return let(F.col("blocks"), lambda b: let(
            let(spec["fields"], lambda fs: extraction.schema_regex(b, fs)),
            lambda cs: let(mapping.field_map(cs, spec["fields"]), lambda m: mapping.contextual_fields(m, cs, spec)),
        ))

    by_mode = F.when(F.col("doc_id") % 3 == 0, plan(specs[0])).when(F.col("doc_id") % 3 == 1, plan(specs[1])).otherwise(plan(specs[2]))
    return d.order_reports(spark, sf).select("doc_id", F.array_join(by_mode, ",").alias("wanted"))


_QUOTES = f"""{BLOCKS}, picked AS (SELECT doc_id, arg_max(text, block_ix) AS last_text FROM blocks GROUP BY doc_id),
needle AS (SELECT doc_id, lower(left(last_text, 30)) AS raw, regexp_replace(trim(lower(left(last_text, 30)), ' ' || chr(9)), '\\s+', ' ', 'g') AS q FROM picked),
hay AS (SELECT doc_id, block_ix, regexp_replace(lower(text), '\\s+', ' ', 'g') AS h, text FROM blocks)"""


@query(
    "map14_anchor_evidence",
    f"""WITH {_QUOTES} SELECT doc_id, CASE WHEN bool_or(block_ix = 0 AND length(q) >= 4 AND contains(h, q)) THEN 'b0'
   ELSE coalesce('b' || min(block_ix) FILTER (WHERE length(q) >= 4 AND contains(h, q)), 'b0') END AS block_id
FROM hay JOIN needle USING (doc_id) GROUP BY doc_id""",
)
def anchored(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.document_blocks(spark, sf, deal=True).filter(F.size("blocks") > 0).withColumns(
        {"cited": F.lit("b0"), "quote": F.left(F.element_at("blocks", -1)["text"], F.lit(30)), "value_text": F.lit("")}
    )
    return evidence.anchor_evidence(docs).select("doc_id", "block_id")


@query(
    "map15_apply_verdicts",
    f"""WITH {REPORTS} SELECT doc_id, 'status' AS field, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'found' END AS status FROM rep
UNION ALL SELECT doc_id, 'total_due', CASE WHEN has_second THEN 'ambiguous' WHEN has_total THEN 'found' ELSE 'missing' END FROM rep""",
)
def judged(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = F.when(
        F.col("doc_id") % 3 == 0, F.map_from_arrays(F.array(F.lit("status"), F.lit("total_due")), F.array(F.lit(False), F.lit(False)))
    ).otherwise(F.map_from_arrays(F.array(F.lit("status")), F.array(F.lit(True))))
    docs = d.order_reports(spark, sf).withColumn("approved", verdicts)
    rows = field_rows_of(validate_documents(docs, d.ORDER_CHECKLIST, measurements=False, judge_verdicts="approved"))
    return rows.filter("field in ('status', 'total_due')").select("doc_id", "field", "status")


def span_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One wide candidate per order line, to be tightened to the span that carries its amount."""
    wide = F.transform(
        "blocks",
        lambda b: F.struct(
            F.lit("amount").alias("field"), value(b["text"].cast("double")).alias("value"), F.lit("layout").alias("source"),
            F.lit(0.6).alias("confidence"), b["block_ix"].alias("block_ix"), b["block_id"].alias("block_id"), b["page"].alias("page"),
            F.concat(F.lit("Price: "), b["text"]).alias("evidence_text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
            F.lit(600.0).alias("x1"), F.lit(12.0).alias("y1"), F.lit(None).cast("string").alias("section_label"),
        ),
    ).cast(extraction.CANDIDATES_TYPE)
    return item_spans(spark, sf).select("doc_id", F.col("blocks").alias("spans"), wide.alias("candidates"))


@query(
    "map16_tighten_bbox",
    f"""WITH {SPANS}, num AS (SELECT *, CASE WHEN CAST(text AS DOUBLE) = floor(CAST(text AS DOUBLE)) THEN CAST(CAST(CAST(text AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(text AS DOUBLE) AS VARCHAR) END AS v FROM spans),
hits AS (SELECT c.doc_id, c.block_ix, (s.x1 - s.x0) * (s.y1 - s.y0) AS area, s.x0
  FROM num c JOIN spans s ON s.doc_id = c.doc_id AND s.page = c.page AND (contains(s.text, c.text) OR contains(s.text, c.v))),
best AS (SELECT doc_id, block_ix, min(area) AS area FROM hits WHERE area > 0 GROUP BY ALL)
SELECT doc_id, block_ix, CASE WHEN area < 7200 * 0.92::DOUBLE THEN round(area, 6) ELSE 7200 END AS area FROM best""",
)
def tightened(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence.tighten_bbox(span_candidates(spark, sf)).select("doc_id", F.inline(exploding(F.col("candidates"))))
    area = F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 6)
    return rows.select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), area.alias("area"))


@query(
    "map17_evidence_snippets",
    f"""WITH {BLOCKS}, q AS (SELECT doc_id, lower(trim(left(arg_max(text, block_ix), 12), ' ')) AS quote FROM blocks GROUP BY doc_id),
hits AS (SELECT b.doc_id, block_ix, text, row_number() OVER (PARTITION BY b.doc_id ORDER BY block_ix) - 1 AS snippet_ix
  FROM blocks b JOIN q ON q.doc_id = b.doc_id AND contains(lower(text), quote) AND length(quote) >= 8)
SELECT doc_id, snippet_ix, 'b' || block_ix AS block_id, text FROM hits""",
)
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.document_blocks(spark, sf).filter(F.size("blocks") > 0).withColumn("quote", F.left(F.element_at("blocks", -1)["text"], F.lit(12)))
    rows = evidence.evidence_snippets(docs)
    return rows.select("doc_id", F.col("snippet_ix").cast("long").alias("snippet_ix"), "block_id", "text")


@query(
    "map18_realign",
    f"""WITH {SPANS}, m AS (SELECT c.doc_id, c.block_ix, min(s.block_ix) AS hit FROM spans c JOIN spans s ON s.doc_id = c.doc_id AND contains(s.text, c.text) GROUP BY ALL)
SELECT m.doc_id, m.block_ix, CASE WHEN h.x1 > h.x0 AND (h.x1 - h.x0) * (h.y1 - h.y0) < 7200 THEN 's' || hit ELSE 's' || m.block_ix END AS block_id
FROM m JOIN spans h ON h.doc_id = m.doc_id AND h.block_ix = hit""",
)
def realigned(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.transform("candidates", lambda c: c.withField("evidence_text", F.format_string("%.2f", c["value"]["num"])))
    docs = span_candidates(spark, sf).withColumn("candidates", plain).withColumnRenamed("spans", "blocks")
    rows = evidence.realign(docs).select("doc_id", F.posexplode(exploding(F.col("candidates"))).alias("ix", "c"))
    return rows.select("doc_id", F.col("ix").cast("long").alias("block_ix"), "c.block_id")


