"""Rules, verdicts and the whole validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.expressions import interpolate_numbers, rule_column, rule_names
from docaudit.operators import verdicts
from docaudit.plans import datasets as d
from docaudit.plans import validation as v
from docaudit.plans.checklist import Checklist, spec_column
from docaudit.functions.text import let

from .fields import settled
from docaudit.sources.blocks import text_blocks
from docaudit.sources.replies import parse_model_replies

from .registry import query
from .sql import REPORT_STATUS, REPORTS

PART_CHECKLIST = Checklist.from_body(
    "part_sheet",
    {
        "version": "2",
        "fields": {
            "price": {"type": "number", "required": True, "min": 950, "max": 1800},
            "size": {"type": "number", "required": True, "min": 10},
            "note": {"type": "string", "required": True},
            "brand": {"type": "number"},
        },
        "cross_field_rules": [
            {"id": "price_for_size", "expression": "price / size >= 30 AND NOT size == 7", "fields": ["price", "size"],
             "error_message": "{price} for size {size} ({other})"},
            {"id": "misuse", "expression": "(price > size) == 1"},
            {"id": "unknown", "expression": "price > depth"},
        ],
    },
)


def part_values(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as resolved values: prices are always there, sizes mostly, the brand is a text."""
    k = F.col("p_partkey")
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def row(field, num, text):
        return F.struct(F.lit(field).alias("field"), num.alias("value_num"), text.alias("value_str"))

    rows = F.filter(
        F.array(
            row("price", F.col("p_retailprice"), none_s),
            row("size", F.when(k % 6 != 0, F.col("p_size").cast("double")), none_s),
            row("note", none_d, F.when(k % 5 != 0, F.col("p_name"))), row("brand", none_d, F.col("p_brand")),
        ),
        lambda r: r["value_num"].isNotNull() | r["value_str"].isNotNull(),
    )
    return d.table(spark, sf, "part").select(k.alias("doc_id"), F.inline(rows))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"))


_REQUIRED = """SELECT p_partkey AS doc_id, f.field, 'required' AS rule,
   CASE f.field WHEN 'size' THEN p_partkey % 6 <> 0 WHEN 'note' THEN p_partkey % 5 <> 0 ELSE true END AS passed
FROM part CROSS JOIN (SELECT unnest(['price', 'size', 'note']) AS field) f"""
_TYPE = """SELECT p_partkey AS doc_id, f.field, 'type_check' AS rule, f.field <> 'brand' AS passed
FROM part CROSS JOIN (SELECT unnest(['price', 'size', 'brand']) AS field) f WHERE f.field <> 'size' OR p_partkey % 6 <> 0"""
_RANGE = """SELECT p_partkey AS doc_id, 'price' AS field, 'range_validation' AS rule, p_retailprice + 1e-9 >= 950 AND p_retailprice - 1e-9 <= 1800 AS passed,
   '[950, 1800]' AS expected FROM part
UNION ALL SELECT p_partkey, 'size', 'range_validation', p_size >= 10, '[10]' FROM part WHERE p_partkey % 6 <> 0"""


@query("rul01_required", _REQUIRED)
def required(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.rule_required(part_values(spark, sf), parts(spark, sf), PART_CHECKLIST)


@query("rul02_type_check", _TYPE)
def types(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.rule_type(part_values(spark, sf), PART_CHECKLIST)


@query("rul03_range_validation", _RANGE)
def ranges(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.rule_range(part_values(spark, sf), PART_CHECKLIST)


_CROSS = """SELECT p_partkey AS doc_id, 'price' AS field, 'price_for_size' AS rule, ok AS passed,
   CASE WHEN ok THEN 'price / size >= 30 AND NOT size == 7' ELSE price || ' for size ' || p_size || ' ({other})' END AS expected
FROM (SELECT *, p_retailprice / p_size + 1e-12 >= 30 AND p_size <> 7 AS ok,
        CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS price FROM part) WHERE p_partkey % 6 <> 0
UNION ALL SELECT p_partkey, 'price', 'misuse', false, 'Cross-field rule misuse failed' FROM part WHERE p_partkey % 6 <> 0"""


def wide_parts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return d.table(spark, sf, "part").select(
        k.alias("doc_id"), F.col("p_retailprice").alias("price"), F.when(k % 6 != 0, F.col("p_size").cast("double")).alias("size")
    )


@query("rul04_cross_field_rules", _CROSS)
def cross(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.rule_cross_field(wide_parts(spark, sf), PART_CHECKLIST, "doc_id")


LINE_RULES = {
    "a": "price >= qty * 900 OR tax < 0.05 AND NOT disc > 0.05",
    "b": "price / (tax * 100) > 5000 OR qty > 0",
    "c": "-qty + 50 == 25 OR +qty != 26.0",
    "d": "qty + tax",
    "e": "disc <= .05 and tax >= disc",
}


@query(
    "rul05_rule_column",
    """SELECT l_orderkey AS doc_id, l_linenumber AS line,
   l_extendedprice + 1e-12 >= l_quantity * 900 OR (l_tax < 0.05::DOUBLE AND NOT l_discount > 0.05::DOUBLE) AS a, l_tax <> 0 AS b,
   abs(-l_quantity + 50 - 25) <= 1e-9 OR abs(l_quantity - 26) > 1e-9 AS c, false AS d,
   l_discount <= 0.05::DOUBLE + 1e-12 AND l_tax + 1e-12 >= l_discount AS e, 'disc,price,qty,tax' AS names FROM lineitem""",
)
def rule_columns(spark: SparkSession, sf: str) -> DataFrame:
    wide = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"),
    )
    return wide.select(
        "doc_id", "line", *(rule_column(text).alias(k) for k, text in LINE_RULES.items()),
        F.lit(",".join(rule_names(LINE_RULES["a"]))).alias("names"),
    )


@query(
    "rul06_interpolate",
    """SELECT p_partkey AS doc_id, 'Price ' || CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END
   || ' of ' || p_size || ' {kept} {}' AS message FROM part""",
)
def messages(spark: SparkSession, sf: str) -> DataFrame:
    text = interpolate_numbers("Price {price} of {size} {kept} {}", {"price": F.col("p_retailprice"), "size": F.col("p_size")})
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("message"))


@query(
    "rul07_merge_evidence",
    f"""WITH {REPORT_STATUS} SELECT doc_id, 'total_due=b2,item_count=b' || (status_ix + 1) AS proof FROM verdict
WHERE outcome <> 'AMBIGUOUS' AND has_total""",
)
def merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.outcome_rows(settled(spark, sf)).filter("rule = 'total_per_item'")
    text = F.transform("evidence", lambda e: F.concat_ws("=", e["field"], e["evidence"]["block_id"]))
    return rows.select("doc_id", F.array_join(text, ",").alias("proof"))


@query(
    "rul08_ledger",
    f"""WITH o AS (SELECT doc_id, field, rule, passed FROM ({_REQUIRED}) UNION ALL SELECT doc_id, field, rule, passed FROM ({_TYPE})
   UNION ALL SELECT doc_id, field, rule, passed FROM ({_RANGE}) UNION ALL SELECT doc_id, field, rule, passed FROM ({_CROSS}))
SELECT doc_id, field, rule, passed, row_number() OVER (PARTITION BY doc_id ORDER BY field,
   CASE rule WHEN 'required' THEN 0 WHEN 'type_check' THEN 1 WHEN 'range_validation' THEN 2 ELSE 9 END,
   CASE rule WHEN 'price_for_size' THEN 0 ELSE 1 END) - 1 AS pos FROM o""",
)
def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger of each part, in ledger order."""
    rows = part_values(spark, sf).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value_num", "value_str")))).alias("m"))
    names = [f.name for f in PART_CHECKLIST.fields]
    none = F.lit(None).cast(verdicts.EVIDENCE_TYPE)

    def one(name):
        got = F.try_element_at("m", F.lit(name))
        val = F.struct(got["value_num"].alias("num"), got["value_str"].alias("str"))
        return F.when(got.isNotNull(), F.struct(F.lit(name).alias("field"), val.alias("value"), none.alias("evidence")))

    docs = parts(spark, sf).join(rows, "doc_id").select("doc_id", F.array(*map(one, names)).alias("resolved"))
    spec = spec_column(PART_CHECKLIST)
    outs = let(F.col("resolved"), lambda r: F.concat(
        let(spec["fields"], lambda fs: verdicts.field_outcomes(r, fs, spec["rules"])), verdicts.cross_field_outcomes(r, PART_CHECKLIST)))
    out = docs.select("doc_id", F.posexplode(let(outs, verdicts.sorted_ledger)).alias("pos", "o"))
    return out.select("doc_id", "o.field", "o.rule", "o.passed", F.col("pos").cast("long").alias("pos"))


def part_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    vals = part_values(spark, sf)
    cols = ("doc_id", "field", "rule", "passed")
    return (
        verdicts.rule_required(vals, parts(spark, sf), PART_CHECKLIST).select(*cols)
        .unionByName(verdicts.rule_type(vals, PART_CHECKLIST).filter("field != 'brand'").select(*cols))
        .unionByName(verdicts.rule_range(vals, PART_CHECKLIST).select(*cols))
    )


_BAD = """CAST(p_partkey % 6 = 0 AS BIGINT) + CAST(p_partkey % 5 = 0 AS BIGINT) + CAST(p_retailprice < 950 OR p_retailprice > 1800 AS BIGINT)
   + CAST(p_partkey % 6 <> 0 AND p_size < 10 AS BIGINT)"""


@query("rul09_verdicts", f"SELECT p_partkey AS doc_id, CASE WHEN {_BAD} = 0 THEN 'PASS' ELSE 'FAIL' END AS status, {_BAD} AS n_failed FROM part")
def verdict_rows(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.verdicts(part_outcomes(spark, sf), parts(spark, sf))


@query(
    "rul10_document_verdicts",
    f"SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 8 = 0 THEN 'AMBIGUOUS' WHEN {_BAD} = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM part",
)
def short_circuit(spark: SparkSession, sf: str) -> DataFrame:
    docs = parts(spark, sf)
    entries = docs.select("doc_id", F.explode(F.array(F.lit("price"), F.lit("size"))).alias("field")).withColumn(
        "status", F.when(F.col("doc_id") % 8 == 0, "ambiguous").otherwise("found")
    )
    return verdicts.document_verdicts(part_outcomes(spark, sf), entries, docs)


def event_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as open-ended evaluations of the order with the same number as their user."""
    kind = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "ambiguous").otherwise("pass")
    return d.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("ix"), kind.alias("evaluation"), (F.col("event_id") % 4 == 0).alias("informative_only")
    )


_EVALS = """evals AS (SELECT user_id AS doc_id, event_id AS ix, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'ambiguous' ELSE 'pass' END AS e FROM events WHERE event_id % 4 <> 0),
firsts AS (SELECT doc_id, arg_min(e, ix) AS first_hit, bool_or(e = 'fail') AS any_fail FROM evals WHERE e <> 'pass' GROUP BY doc_id)"""


@query(
    "rul11_merge_evaluations",
    f"""WITH {_EVALS}, base AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'AMBIGUOUS' END AS status FROM orders)
SELECT doc_id, CASE WHEN status = 'PASS' AND first_hit = 'ambiguous' THEN 'AMBIGUOUS' WHEN any_fail THEN 'FAIL' ELSE status END AS status
FROM base LEFT JOIN firsts USING (doc_id)""",
)
def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    base = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("AMBIGUOUS").alias("status"),
    )
    return verdicts.merge_evaluations(base, event_evaluations(spark, sf))


OPEN_CHECKLIST = Checklist.from_body(
    "open", {"version": "3", "fields": {}, "open_ended": {
        "click": {"extract_prompt": "x", "evaluate_prompt": "ok?", "evaluation_tags": ["pass"]},
        "view": {"extract_prompt": "x", "informative_only": True}, "purchase": {"extract_prompt": "x", "evaluate_prompt": "ok?"},
        "signup": {"extract_prompt": "x"}}},
)


@query(
    "rul12_normalize_evaluations",
    """SELECT event_id AS doc_id, event_type AS field, CASE WHEN event_type IN ('view', 'signup') THEN '' WHEN event_id % 3 = 0 THEN 'pass' WHEN event_id % 3 = 1 THEN 'fail' ELSE 'ambiguous' END AS evaluation,
   event_type = 'view' AS informative_only FROM events WHERE event_type <> 'error'""",
)
def evaluation_tags(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.element_at(F.array(F.lit(" PASS "), F.lit("Fail"), F.lit("no idea")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = d.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("field"), tag.alias("evaluation"))
    return verdicts.normalize_evaluations(rows, OPEN_CHECKLIST).withColumn("evaluation", F.coalesce("evaluation", F.lit("")))


LOST_CHECKLIST = Checklist.from_body(
    "lost", {"version": "3", "fields": {}, "open_ended": {
        "tone": {"extract_prompt": "x", "evaluate_prompt": "calm?"}, "ending": {"extract_prompt": "x", "evaluate_prompt": "whole?"}}},
)


@query(
    "rul12b_lost_replies",
    """WITH s AS (SELECT doc_id, unnest(['tone', 'ending']) AS field FROM documents),
e AS (SELECT doc_id, bool_or(doc_id % 5 = 0 AND field = 'tone' AND doc_id % 3 <> 0) AS failed, bool_or(doc_id % 3 = 0 OR field = 'ending' AND doc_id % 4 = 0) AS unclear FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN failed THEN 'FAIL' WHEN unclear THEN 'AMBIGUOUS' ELSE 'PASS' END AS status FROM e""",
)
def lost_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the documents has unreadable replies and others lack one: no field may count as clean for want of a reply."""
    k = F.col("doc_id")
    docs = d.table(spark, sf, "documents").select("doc_id", F.lit("PASS").alias("status"))
    asked = docs.select("doc_id", F.explode(F.array(F.lit("tone"), F.lit("ending"))).alias("field")).filter((F.col("field") != "ending") | (k % 4 != 0))
    tag = F.when((k % 5 == 0) & (F.col("field") == "tone"), "fail").otherwise("pass")
    raw = F.when(k % 3 == 0, "no json at all").otherwise(F.concat(F.lit('{"evaluation": "'), tag, F.lit('"}')))
    replies = parse_model_replies(asked.withColumn("reply", raw), "evaluation string").select("doc_id", "field", "parsed.evaluation")
    evaluations = verdicts.normalize_evaluations(replies, LOST_CHECKLIST, documents=docs)
    order = F.when(F.col("evaluation") == "fail", 0).otherwise(1)
    return verdicts.merge_evaluations(docs, evaluations.withColumn("ix", order))


@query("rul13_needs_retry", f"SELECT p_partkey AS doc_id FROM part WHERE ({_BAD}) > 0 AND (p_partkey % 6 = 0 OR p_partkey % 5 = 0)")
def retry(spark: SparkSession, sf: str) -> DataFrame:
    outs = part_outcomes(spark, sf)
    missing = parts(spark, sf).filter("doc_id % 6 = 0")
    return verdicts.needs_retry(verdicts.verdicts(outs, parts(spark, sf)), outs, missing).select("doc_id")


@query("rul14_validate_documents", f"WITH {REPORT_STATUS} SELECT doc_id, outcome AS status, CASE WHEN outcome = 'AMBIGUOUS' THEN 0 ELSE CAST(NOT has_total AS BIGINT) + CAST(has_total AND total > 300000 AS BIGINT) + CAST(has_total AND (n_items = 0 OR total / n_items > 200000) AS BIGINT) + CAST(n_items = 0 AS BIGINT) + n_bad END AS n_failed FROM verdict")
def validate(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: rendered orders to verdicts."""
    results = v.validate_documents(d.order_reports(spark, sf), d.ORDER_CHECKLIST)
    failed = F.size(F.filter("outcomes", lambda o: ~o["passed"])).cast("long")
    return results.select("doc_id", "status", failed.alias("n_failed"))


@query(
    "rul14b_validate_with_retry",
    f"""WITH {REPORTS} SELECT doc_id, CASE WHEN has_second THEN 'AMBIGUOUS' WHEN has_total AND total <= 300000 THEN 'PASS'
   WHEN NOT has_total AND doc_id % 2 = 0 AND total <= 300000 THEN 'PASS' ELSE 'FAIL' END AS status FROM rep""",
)
def validate_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a total get it from a page reply (every second one has it)."""
    plain = Checklist.from_body("order_plain", {"fields": d.ORDER_CHECKLIST.body["fields"], "rules": ["required", "range_validation"]})
    orders = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.map_from_arrays(
        F.array(F.lit("total_due")), F.array(F.when(F.col("o_orderkey") % 2 == 0, F.format_string("%.2f", "o_totalprice")))).alias("pages"))
    docs = d.order_reports(spark, sf).join(orders, "doc_id")
    return v.validate_documents(docs, plain, measurements=False, page_replies="pages").select("doc_id", "status")


@query(
    "rul14c_validate_several_checklists",
    f"""WITH {REPORT_STATUS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN outcome WHEN has_second THEN 'AMBIGUOUS'
   WHEN NOT has_total THEN 'FAIL' ELSE 'PASS' END AS status FROM verdict""",
)
def validate_several(spark: SparkSession, sf: str) -> DataFrame:
    """Two checklists in one pass over the documents."""
    loose = Checklist.from_body("loose", {"fields": {k: {x: y for x, y in f.items() if x not in ("min", "max")} for k, f in d.ORDER_CHECKLIST.body["fields"].items()}, "rules": ["required"]})
    docs = d.order_reports(spark, sf).withColumn("spec_id", F.when(F.col("doc_id") % 2 == 0, "order_report").otherwise("loose"))
    return v.validate_documents(docs, [d.ORDER_CHECKLIST, loose], measurements=False).select("doc_id", "status")


@query(
    "rul14f_unknown_checklists",
    f"""WITH {REPORT_STATUS} SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'UNKNOWN_CHECKLIST' ELSE outcome END AS status FROM verdict""",
)
def validate_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the documents names no checklist and a third an unknown one: each still has its row."""
    k = F.col("doc_id")
    docs = d.order_reports(spark, sf).withColumn("spec_id", F.when(k % 3 == 0, "order_report").when(k % 3 == 1, "no such checklist"))
    return v.validate_documents(docs, [d.ORDER_CHECKLIST], measurements=False).select("doc_id", "status")


@query(
    "rul14d_validate_sparse_pages",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n < 60 THEN 'AMBIGUOUS' ELSE 'PASS' END AS status
FROM (SELECT doc_id, length('Shelf: ' || doc_id) + CASE WHEN doc_id % 3 = 0 THEN length(repeat('dust ', 20)) - 1 ELSE 0 END AS n FROM documents)""",
)
def validate_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Page replies that disagree are read where a document has hardly any text, and only there."""
    shelf = Checklist.from_body("shelf", {"fields": {"shelf": {"type": "number", "required": True}}})
    k = F.col("doc_id")
    text = F.concat_ws("\n", F.concat(F.lit("Shelf: "), k.cast("string")), F.when(k % 3 == 0, F.repeat(F.lit("dust "), 20)))
    docs = d.table(spark, sf, "documents").select(
        "doc_id", text_blocks(text).alias("blocks"),
        F.when(k % 2 == 0, F.create_map(F.lit("shelf"), (k + 7).cast("string"))).alias("pages"),
    )
    return v.validate_documents(docs, shelf, page_replies="pages").select("doc_id", "status")


@query(
    "rul14e_validate_normalised",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'FAIL' WHEN doc_id % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM documents""",
)
def validate_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """A body with a synonym, without hints, and with an equality rule, read as the catalogue would store it."""
    raw = Checklist.from_body("raw", {
        "version": "2",
        "fields": {"amount_due": {"type": "number", "required": True}, "copies": {"type": "number", "required": True, "rules": [{"rule_name": "equals", "value": 2}]}},
        "cross_field_rules": [{"id": "positive", "expression": "amount_due > 0", "fields": ["amount_due"]}],
    })
    k = F.col("doc_id")
    text = F.concat_ws("\n", F.concat(F.lit("Importe por pagar: USD "), F.when(k % 5 == 0, "0").otherwise("12.50")), F.concat(F.lit("Copies: "), F.when(k % 7 == 0, "3").otherwise("2")))
    docs = d.table(spark, sf, "documents").select("doc_id", text_blocks(text).alias("blocks"))
    return v.validate_documents(docs, raw).select("doc_id", "status")
