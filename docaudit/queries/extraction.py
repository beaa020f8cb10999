"""Extraction over rendered orders, prose documents and rendered measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import let
from docaudit.functions.values import coerce
from docaudit.operators import extraction as ops
from docaudit.operators import mapping
from docaudit.operators.labels import label_places
from docaudit.plans import datasets as d
from docaudit.plans.checklist import Checklist, spec_column
from docaudit.sources.blocks import text_blocks

from .registry import query
from .sql import BLOCKS, REPORTS

EMAIL_CHECKLIST = Checklist.from_body("contact", {"fields": {"contact_email": {"type": "string"}}})
DATE_CHECKLIST = Checklist.from_body(
    "dates", {"fields": {"invoice_issue_date": {"type": "date"}, "due_date": {"type": "date", "aliases": ["Fecha de vencimiento"]}}}
)
# Spanish month names, January first.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"


def shown(cands: DataFrame) -> DataFrame:
    """Comparable columns of a candidate table."""
    return cands.select(
        "doc_id", F.col("cand_ix").cast("long").alias("cand_ix"), "field", "value_num", F.coalesce("value_str", F.lit("")).alias("value_str"),
        "source", "confidence", F.col("block_ix").cast("long").alias("block_ix"), "evidence_text",
    )


@query(
    "ext01_extract_regex",
    f"""WITH {REPORTS}, c AS (
  SELECT doc_id, 0 AS f, 0 AS m, 'order_number' AS field, CAST(doc_id AS DOUBLE) AS value_num, 1 AS block_ix, 'Order number: ' || doc_id AS evidence_text FROM rep
  UNION ALL SELECT doc_id, 1, 0, 'total_due', total, 2, printf('Total due: %.2f', total) FROM rep WHERE has_total
  UNION ALL SELECT doc_id, 1, 1, 'total_due', second, 3, printf('Total due: %.2f', second) FROM rep WHERE has_second
  UNION ALL SELECT doc_id, 2, 0, 'item_count', n_items, status_ix + 1, 'Items: ' || n_items FROM rep)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f, m) - 1 AS cand_ix, field, value_num, '' AS value_str, 'regex' AS source,
  0.9::DOUBLE AS confidence, CAST(block_ix AS BIGINT) AS block_ix, evidence_text FROM c""",
)
def regex(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ops.extract_regex(d.order_reports(spark, sf), d.ORDER_CHECKLIST))


LICENCE_CHECKLIST = Checklist.from_body(
    "licence",
    {"fields": {
        "licence": {"type": "string", "regex_hint": r"under (?:the )?(CC BY-NC)?"},
        "release": {"type": "string", "regex_hint": r"[Vv]ersion \d{,2}"},
        "stop": {"type": "string", "regex_hint": r"Licens[[e]d"},
        "broken": {"type": "string", "regex_hint": r"(*under"},
    }},
)


@query(
    "ext01b_extract_odd_patterns",
    f"""WITH {BLOCKS}, hits AS (
  SELECT doc_id, block_ix, 0 AS f, 'licence' AS field, CASE WHEN contains(text, 'under CC BY-NC') AND position('under CC BY-NC' IN text) = position('under ' IN text) THEN 'CC BY-NC'
      ELSE trim(regexp_extract(text, 'under (?:the )?')) END AS value_str FROM blocks WHERE contains(text, 'under ')
  UNION ALL SELECT doc_id, block_ix, 1, 'release', regexp_extract(text, '[Vv]ersion [0-9]{{0,2}}') FROM blocks WHERE regexp_matches(text, '[Vv]ersion ')
  UNION ALL SELECT doc_id, block_ix, 2, 'stop', regexp_extract(text, 'Licens[\\[e]d') FROM blocks WHERE regexp_matches(text, 'Licens[\\[e]d'))
SELECT doc_id, block_ix, field, trim(value_str) AS value_str FROM hits""",
)
def odd_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """An optional group, an open lower bound, a bracket in a class, and a pattern that compiles nowhere."""
    rows = ops.extract_regex(d.document_blocks(spark, sf), LICENCE_CHECKLIST)
    return rows.select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), "field", "value_str")


@query(
    "ext02_guard_totals",
    """SELECT l_orderkey AS doc_id, l_linenumber AS line, l_extendedprice AS amount FROM lineitem WHERE l_linenumber % 4 NOT IN (1, 2)""",
)
def guard(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("l_linenumber") % 4
    text = (
        F.when(kind == 0, "Amount due after subtotal").when(kind == 1, "SUBTOTAL of the page")
        .when(kind == 2, "Precio de venta").otherwise("Grand total")
    )
    cands = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("amount"),
        F.concat_ws(" ", text, F.col("l_quantity").cast("string")).alias("block_text"),
    )
    return ops.guard_totals(cands).drop("block_text")


@query(
    "ext03_coerce_value",
    """SELECT p_partkey AS id, CASE WHEN p_size % 3 <> 0 THEN NULL WHEN p_partkey % 6 = 0 THEN CAST(printf('%.2f', p_retailprice) AS DOUBLE)
      WHEN p_partkey % 6 = 1 THEN p_size::DOUBLE WHEN p_partkey % 6 = 5 THEN p_size + 0.5::DOUBLE END AS num,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE t END AS str
FROM (SELECT *, trim(CASE p_partkey % 6 WHEN 0 THEN 'USD ' || printf('%.2f', p_retailprice) || ' net of 7' WHEN 1 THEN p_size || ' kg'
        WHEN 2 THEN '1.' || p_size || '.3' WHEN 3 THEN '.' WHEN 4 THEN '   ' ELSE repeat(p_name || ' ', 60) || p_size || '.5' END) AS t FROM part)""",
)
def coerced(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    raw = (
        F.when(k == 0, F.format_string("USD %.2f net of 7", "p_retailprice"))
        .when(k == 1, F.concat(size, F.lit(" kg"))).when(k == 2, F.concat(F.lit("1."), size, F.lit(".3")))
        .when(k == 3, ".").when(k == 4, "   ")
        .otherwise(F.concat(F.expr("repeat(p_name || ' ', 60)"), size, F.lit(".5")))
    )
    typ = F.element_at(F.array(F.lit("number"), F.lit("date"), F.lit("string")), F.col("p_size") % 3 + 1)
    rows = d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), coerce(raw, typ).alias("v"))
    return rows.select("id", "v.num", F.coalesce("v.str", F.lit("")).alias("str"))


@query(
    "ext04_extract_spanish_dates",
    f"""WITH t AS (SELECT o_orderkey AS doc_id, day(o_orderdate) || ' de ' || list_extract({_MONTHS_SQL}, CAST(month(o_orderdate) AS INT)) || ' de ' || year(o_orderdate) AS s FROM orders)
SELECT doc_id, 'invoice_issue_date' AS field, s AS value_str, 1::BIGINT AS block_ix FROM t WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'due_date', s, 2 FROM t UNION ALL SELECT doc_id, 'due_date', s, 2 FROM t""",
)
def spanish_dates(spark: SparkSession, sf: str) -> DataFrame:
    when = F.col("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(when))
    date = F.concat_ws(" de ", F.dayofmonth(when).cast("string"), month, F.year(when).cast("string"))
    issue = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("FECHA DE EMISIÓN "), date)).otherwise(F.concat(F.lit("Lima, "), date))
    text = F.concat_ws("\n", F.lit("FACTURA"), issue, F.concat(F.lit("Fecha de vencimiento: "), date, F.lit(" o "), date))
    docs = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), text_blocks(text).alias("blocks"))
    rows = ops.extract_spanish_dates(docs, DATE_CHECKLIST)
    return rows.select("doc_id", "field", "value_str", F.col("block_ix").cast("long").alias("block_ix"))


@query(
    "ext05_labels_for",
    """WITH raw AS (
  SELECT p_partkey AS spec_id, field, unnest(ls) AS label, generate_subscripts(ls, 1) AS pos FROM (
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'total_due' ELSE lower(p_type) || '_size' END AS field,
      CASE WHEN p_size % 2 = 0 THEN [CASE WHEN p_size % 5 = 0 THEN 'total due' ELSE lower(p_type) || ' size' END, upper(p_name), p_name, p_type || ' SIZE']
           WHEN p_size % 5 = 0 THEN ['total due', 'importe por pagar', 'total due', 'total', 'amount due']
           ELSE [lower(p_type) || ' size'] END AS ls FROM part)),
firsts AS (SELECT spec_id, field, min(pos) AS pos, arg_min(label, pos) AS label FROM raw GROUP BY spec_id, field, lower(label))
SELECT spec_id, field, row_number() OVER (PARTITION BY spec_id ORDER BY pos) - 1 AS label_ix, label FROM firsts""",
)
def labels(spark: SparkSession, sf: str) -> DataFrame:
    aliases = F.when(
        F.col("p_size") % 2 == 0, F.array(F.upper("p_name"), F.col("p_name"), F.concat("p_type", F.lit(" SIZE ")), F.lit(" "))
    ).otherwise(F.array().cast("array<string>"))
    rows = d.table(spark, sf, "part").select(
        F.col("p_partkey").alias("spec_id"),
        F.when(F.col("p_size") % 5 == 0, "total_due").otherwise(F.concat(F.lower("p_type"), F.lit("_size"))).alias("field"),
        aliases.alias("aliases"),
    )
    return ops.label_table(rows).withColumn("label_ix", F.col("label_ix").cast("long"))


@query(
    "ext06_extract_labels",
    f"""WITH {REPORTS}, c AS (
  SELECT doc_id, 0 AS f, 'order_number' AS field, CAST(doc_id AS DOUBLE) AS value_num, '' AS value_str, 1 AS block_ix, 'Order number: ' || doc_id AS evidence_text FROM rep
  UNION ALL SELECT doc_id, 1, 'total_due', total, '', 2, printf('Total due: %.2f', total) FROM rep WHERE has_total
  UNION ALL SELECT doc_id, 2, 'status', NULL, status, status_ix, 'Status: ' || status FROM rep
  UNION ALL SELECT doc_id, 3, 'item_count', n_items, '', status_ix + 1, 'Items: ' || n_items FROM rep)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS cand_ix, field, value_num, value_str, 'layout' AS source,
  0.6::DOUBLE AS confidence, CAST(block_ix AS BIGINT) AS block_ix, evidence_text FROM c""",
)
def by_label(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ops.extract_labels(d.order_reports(spark, sf), d.ORDER_CHECKLIST))


@query(
    "ext06b_extract_many_labels",
    """WITH t AS (SELECT p_partkey AS doc_id, p_partkey % 500 AS a, p_partkey * 7 % 500 AS b, p_retailprice AS x, CAST(p_size AS DOUBLE) AS y, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS late FROM part)
SELECT doc_id, printf('lot %03d', a) AS field, x AS value_num, 1 + late AS block_ix, printf('Lot %03d: %.2f', a, x) AS evidence_text FROM t
UNION ALL SELECT doc_id, printf('lot %03d', b), y, 2 + late, printf('(lot %03d) %d', b, CAST(y AS BIGINT)) FROM t WHERE a <> b""",
)
def by_many_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A checklist of five hundred fields with a thousand labels; a document holds two of them.

    The documents are dealt out first: a small file of few row groups gives few tasks for costly work.
    """
    spec = Checklist.from_body("lots", {"fields": {f"f{i:03d}": {"type": "number", "aliases": [f"Lot {i:03d}"]} for i in range(500)}})
    k = F.col("p_partkey")
    text = F.concat_ws("\n", F.lit("LOT SHEET"), F.when(k % 3 == 0, "Lots of the warehouse"), F.format_string("Lot %03d: %.2f", k % 500, "p_retailprice"), F.format_string("(lot %03d) %d", k * 7 % 500, "p_size"))
    parts = d.table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    docs = parts.select(k.alias("doc_id"), text_blocks(text).alias("blocks"))
    placed = label_places(docs, [lb["label"] for f in spec.fields for lb in f.as_row()["labels"]])
    rows = shown(ops.extract_labels(placed, spec, places="label_places"))
    return rows.select("doc_id", F.concat(F.lit("lot "), F.substring("field", 2, 3)).alias("field"), "value_num", "block_ix", "evidence_text")


@query(
    "ext07_extract_emails",
    rf"""WITH {BLOCKS}, hits AS (
  SELECT doc_id, block_ix, regexp_extract(text, '(?i)[\pL\pM\pN\p{{Pc}}.+-]+@[\pL\pM\pN\p{{Pc}}.-]+\.[\pL\pM\pN\p{{Pc}}]+') AS m FROM blocks)
SELECT doc_id, arg_min(m, length(m) * 1000000 + block_ix) AS value_str, arg_min(block_ix, length(m) * 1000000 + block_ix) AS block_ix
FROM hits WHERE m <> '' GROUP BY doc_id""",
)
def emails(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.extract_labels(d.document_blocks(spark, sf, deal=True), EMAIL_CHECKLIST)
    return rows.select("doc_id", "value_str", F.col("block_ix").cast("long").alias("block_ix"))


def measurement_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One lab report per part, with strict and loose measurement lines."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat_ws(
        "\n", F.lit("LAB REPORT"),
        F.when(k % 4 == 0, F.format_string("Measured pH: %.1f", size / 10)).when(k % 4 == 1, F.format_string("pH level %.1f", size / 10))
        .otherwise(F.format_string("pH = %.1f", size / 10)),
        F.when(k % 5 == 0, F.format_string("The second flask showed alcohol measured at %d after cooling", size))
        .otherwise(F.format_string("Alcohol: %d.5%%", size)),
        F.when(k % 3 == 0, F.format_string("Quality panel %d of 100", size)).otherwise(F.format_string("Quality: %d", size)),
        F.lit("Stored on rack 18 behind the north door"),
    )
    return d.table(spark, sf, "part").select(k.alias("doc_id"), text_blocks(text).alias("blocks"))


@query(
    "ext08_extract_measurements",
    """SELECT p_partkey AS doc_id, 'ph' AS field, p_size / 10.0::DOUBLE AS value_num,
   CASE p_partkey % 4 WHEN 0 THEN printf('pH: %.1f', p_size / 10.0) WHEN 1 THEN printf('pH level %.1f', p_size / 10.0) ELSE printf('pH = %.1f', p_size / 10.0) END AS evidence_text FROM part
UNION ALL SELECT p_partkey, 'ph', p_size / 10.0::DOUBLE, printf('Measured pH: %.1f', p_size / 10.0) FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 'alcohol', p_size + 0.5::DOUBLE, 'Alcohol: ' || p_size || '.5%' FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'quality', p_size::DOUBLE, 'Quality: ' || p_size FROM part WHERE p_partkey % 3 <> 0""",
)
def measured(spark: SparkSession, sf: str) -> DataFrame:
    return ops.extract_measurements(measurement_docs(spark, sf)).select("doc_id", "field", "value_num", "evidence_text")


@query(
    "ext09_extract_measurement_lines",
    """SELECT p_partkey AS doc_id, 'ph' AS field, p_size / 10.0::DOUBLE AS value_num,
   CASE p_partkey % 4 WHEN 0 THEN printf('pH: %.1f', p_size / 10.0) WHEN 1 THEN printf('pH level %.1f', p_size / 10.0) ELSE printf('pH = %.1f', p_size / 10.0) END AS evidence_text
FROM part WHERE p_size > 0 AND p_size < 140 AND p_partkey % 4 <> 0
UNION ALL SELECT p_partkey, 'alcohol', p_size + 0.5::DOUBLE, 'Alcohol: ' || p_size || '.5%' FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, 'alcohol', p_size::DOUBLE, 'alcohol measured at ' || p_size FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'quality', p_size::DOUBLE, 'Quality: ' || p_size FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'quality', 100, 'Quality panel ' || p_size || ' of 100' FROM part WHERE p_partkey % 3 = 0""",
)
def measured_lines(spark: SparkSession, sf: str) -> DataFrame:
    return ops.extract_measurement_lines(measurement_docs(spark, sf)).select("doc_id", "field", "value_num", "evidence_text")


@query(
    "ext10_ensemble",
    f"""WITH {REPORTS} SELECT doc_id, 'order_number:regex' || CASE WHEN has_total THEN ',total_due:regex' ELSE '' END || CASE WHEN has_second THEN ',total_due:regex' ELSE '' END
   || ',item_count:regex,order_number:layout' || CASE WHEN has_total THEN ',total_due:layout' ELSE '' END || ',status:layout,item_count:layout' AS candidates FROM rep""",
)
def all_extractors(spark: SparkSession, sf: str) -> DataFrame:
    found = let(F.col("blocks"), lambda b: let(spec_column(d.ORDER_CHECKLIST)["fields"], lambda fs: ops.ensemble(b, fs)))
    names = F.transform(found, lambda c: F.concat(c["field"], F.lit(":"), c["source"]))
    return d.order_reports(spark, sf).select("doc_id", F.array_join(names, ",").alias("candidates"))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies per order: flat values and values with cited blocks."""
    k = F.col("doc_id")
    orders = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_orderstatus")
    total = F.when(k % 7 == 0, "unknown").otherwise(F.format_string("%,.2f", "o_totalprice"))
    none = F.lit(None).cast("string")
    entry = F.struct(
        total.alias("value"), F.when(k % 2 == 0, "b0").otherwise("b77").alias("block_id"),
        F.format_string("total  DUE: %.2f", "o_totalprice").alias("evidence_text"),
    )
    return orders.select(
        k, F.map_from_arrays(F.array(F.lit("total_due"), F.lit("status"), F.lit("other")), F.array(total, F.lit("  "), F.lit("x"))).alias("gap"),
        F.map_from_arrays(
            F.array(F.lit("total_due"), F.lit("status")),
            F.array(entry, F.struct(F.col("o_orderstatus").alias("value"), F.lit("b1").alias("block_id"), none.alias("evidence_text"))),
        ).alias("context"),
    )


@query(
    "ext11_candidates_from_replies",
    f"""WITH {REPORTS} SELECT doc_id, 'total_due' AS field, CAST(printf('%.2f', total) AS DOUBLE) AS value_num, 'llm' AS source, 0.45::DOUBLE AS confidence, 'b0' AS block_id
FROM rep WHERE NOT has_total AND doc_id % 7 <> 0""",
)
def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.order_reports(spark, sf).join(replies(spark, sf), "doc_id")
    fields = spec_column(d.ORDER_CHECKLIST)["fields"]

    def fill(blocks):
        cands = let(fields, lambda fs: ops.ensemble(blocks, fs, False))
        wanted = let(cands, lambda cs: let(mapping.field_map(cs, fields), lambda m: mapping.gapfill_fields(m, fields, True)))
        return let(wanted, lambda w: ops.reply_candidates(F.col("gap"), w, blocks))

    rows = docs.select("doc_id", F.posexplode(let(F.col("blocks"), fill)).alias("cand_ix", "c"))
    return ops.flat_candidates(rows).select("doc_id", "field", "value_num", "source", "confidence", "block_id")


@query(
    "ext12_contextual_candidates",
    f"""WITH {REPORTS} SELECT doc_id, 'total_due' AS field, CAST(printf('%.2f', total) AS DOUBLE) AS value_num, '' AS value_str,
   CASE WHEN has_total THEN 'b2' WHEN doc_id % 2 = 0 THEN 'b0' ELSE 'b77' END AS block_id FROM rep WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, 'status', NULL, status, 'b1' FROM rep""",
)
def contextual(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.order_reports(spark, sf).join(replies(spark, sf), "doc_id")
    fields = F.filter(spec_column(d.ORDER_CHECKLIST)["fields"], lambda f: f["name"].isin("total_due", "status"))
    found = let(F.col("blocks"), lambda b: let(fields, lambda w: ops.contextual_candidates(F.col("context"), w, b)))
    rows = ops.flat_candidates(docs.select("doc_id", F.posexplode(found).alias("cand_ix", "c")))
    return rows.select("doc_id", "field", "value_num", F.coalesce("value_str", F.lit("")).alias("value_str"), "block_id")


@query(
    "ext13_merge_page_replies",
    """SELECT user_id AS doc_id, event_type AS field, arg_min(CAST(event_id AS VARCHAR) || 'v', event_id) AS raw, 'vision' AS source, 0.42::DOUBLE AS confidence
FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, event_type""",
)
def page_replies(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 != 0, F.concat(F.col("event_id").cast("string"), F.lit("v")))
    pages = d.table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("page"), F.map_from_arrays(F.array("event_type"), F.array(value)).alias("fields")
    )
    return ops.merge_page_replies(pages)


@query(
    "ext14_region_roles",
    """SELECT c_custkey AS doc_id, lower(c_mktsegment) AS role, lower(c_mktsegment) AS description, 'b' || c_nationkey AS block_id FROM customer
UNION ALL SELECT c_custkey, lower(c_mktsegment), lower(c_mktsegment), 'b99' FROM customer
UNION ALL SELECT c_custkey, 'unknown', c_name, 'b1' FROM customer WHERE c_custkey % 4 <> 0""",
)
def roles(spark: SparkSession, sf: str) -> DataFrame:
    def region(role, ids, description):
        return F.struct(role.alias("role"), ids.alias("block_ids"), description.alias("description"))

    none = F.lit(None).cast("string")
    block = F.concat(F.lit("b"), F.col("c_nationkey").cast("string"))
    body = F.struct(
        F.lit("profile").alias("document_type"),
        F.array(
            region(F.lower("c_mktsegment"), F.array(block, F.lit(""), F.lit("b99")), F.lit(" ")),
            region(none, F.filter(F.array(F.lit("b1")), lambda _: F.col("c_custkey") % 4 != 0), F.col("c_name")),
        ).alias("regions"),
    )
    rows = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.to_json(body).alias("reply"))
    return ops.region_roles(rows)


