"""Repeating groups: order lines as rows of a section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import let
from docaudit.operators import groups as ops
from docaudit.plans import datasets as d
from docaudit.plans.checklist import GroupSpec, RowRule
from docaudit.sources.blocks import BLOCKS_TYPE, text_blocks

from .blocks import item_spans
from .registry import query
from .sql import REPORTS, SPANS

FIELDS = (("line", "number"), ("qty", "number"), ("price", "number"), ("discount", "number"))
RULES = (
    RowRule("unit_price", "price / qty <= 2000", "line {line}: {price} for {qty}"),
    RowRule("some_discount", "discount > 0 OR qty < 10"),
    RowRule("broken", "price >"),
    RowRule("elsewhere", "tax > 0"),
)


def spec(structure: str) -> GroupSpec:
    return GroupSpec("items", "order items", FIELDS, structure, RULES)


_ROWS = f"""WITH {REPORTS} SELECT l_orderkey AS doc_id, row_ix, f.field, CASE f.field WHEN 'line' THEN l_linenumber WHEN 'qty' THEN l_quantity
   WHEN 'price' THEN l_extendedprice ELSE l_discount END::DOUBLE AS num
FROM items CROSS JOIN (SELECT unnest(['line', 'qty', 'price', 'discount']) AS field) f"""


def numbers(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("row_ix").cast("long").alias("row_ix"), "field", "num")


@query("grp01_rows_list", _ROWS)
def list_rows(spark: SparkSession, sf: str) -> DataFrame:
    return numbers(ops.rows_table(d.order_reports(spark, sf), spec("list")))


def reports_as(spark: SparkSession, sf: str, sep: str, head: str | None = None, one_line: bool = False) -> DataFrame:
    """Item sections in another notation."""
    rows = F.transform(
        "items",
        lambda i: F.concat_ws(
            sep, i["l_linenumber"].cast("string"), F.format_string("%.0f", i["l_quantity"]),
            F.format_string("%.2f", i["l_extendedprice"]), F.format_string("%.2f", i["l_discount"]),
        ),
    )
    body = F.concat_ws(" ", F.lit("ORDER Order Items"), rows) if one_line else F.concat_ws(
        "\n", F.lit("Order Items"), F.lit(head), rows, F.lit("# remark 1 2 3")
    )
    return d.order_lines(spark, sf).select(F.col("o_orderkey").alias("doc_id"), text_blocks(body).alias("blocks"))


@query("grp02_rows_pipe", _ROWS)
def pipe_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = reports_as(spark, sf, " | ", "| Line | QTY | price | discount |")
    return numbers(ops.rows_table(docs, spec("table")))


@query(
    "grp03_cluster_baselines",
    f"""WITH RECURSIVE {SPANS}, near AS (SELECT doc_id, block_ix, page, x0, y0 / 8 AS y, row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, block_ix) AS k FROM spans),
walk AS (SELECT doc_id, block_ix, page, x0, k, y AS anchor, 0 AS row_ix FROM near WHERE k = 1
  UNION ALL SELECT n.doc_id, n.block_ix, n.page, n.x0, n.k, CASE WHEN n.page = w.page AND n.y - w.anchor <= 4 THEN w.anchor ELSE n.y END,
    w.row_ix + CASE WHEN n.page = w.page AND n.y - w.anchor <= 4 THEN 0 ELSE 1 END
  FROM walk w JOIN near n ON n.doc_id = w.doc_id AND n.k = w.k + 1)
SELECT doc_id, CAST(row_ix AS BIGINT) AS row_ix, string_agg('s' || block_ix, ',' ORDER BY x0, block_ix) AS members FROM walk GROUP BY doc_id, row_ix""",
)
def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Spans three points apart under a tolerance of four: each row ends by its first span, not by the last gap."""
    near = F.transform("blocks", lambda b: b.withField("y0", b["y0"] / 8))
    rows = let(near, lambda b: ops.baselines(b, 4.0))
    out = item_spans(spark, sf).select("doc_id", F.posexplode(rows).alias("row_ix", "r"))
    return out.select("doc_id", F.col("row_ix").cast("long").alias("row_ix"), F.array_join(F.array_sort(F.transform("r", lambda b: F.struct(b["x0"], b["block_ix"], b["block_id"])))["block_id"], ",").alias("members"))


def item_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each order line as four spans on one baseline under a section header; prices come in two parts."""

    def span(ix, n, x0, x1, text):
        y = n * 20 + 30
        return F.struct(
            ix.cast("int").alias("block_ix"), F.concat(F.lit("s"), ix.cast("string")).alias("block_id"), F.lit(1).alias("page"),
            F.lit(x0).cast("double").alias("x0"), (y + ix % 3).cast("double").alias("y0"), F.lit(x1).cast("double").alias("x1"),
            (y + 10).cast("double").alias("y1"), text.alias("text"), F.lit(None).cast("string").alias("section_label"),
            F.lit(None).cast("double").alias("font_size_max"),
        ).cast(BLOCKS_TYPE[len("array<"):-1])

    def row(i, n):
        base = n * 4 + 1
        return F.array(
            span(base, n, 0, 20, i["l_linenumber"].cast("string")), span(base + 1, n, 50, 70, F.format_string("%.0f", i["l_quantity"])),
            span(base + 2, n, 100, 140, F.format_string("%.2f", i["l_extendedprice"])), span(base + 3, n, 200, 220, F.format_string("%.2f", i["l_discount"])),
        )

    head = F.array(span(F.lit(0), F.lit(-1), 0, 60, F.lit("Order Items")))
    blocks = F.concat(head, F.flatten(F.transform("items", row)))
    return d.order_lines(spark, sf).select(F.col("o_orderkey").alias("doc_id"), blocks.alias("blocks"))


@query(
    "grp04_cells_from_spans",
    f"""WITH {SPANS}, o AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, block_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, y0 ORDER BY x0, block_ix) AS cell FROM o),
j AS (SELECT doc_id, page, y0, cell, string_agg(text, ' ' ORDER BY x0, block_ix) AS cell_text FROM c GROUP BY ALL)
SELECT doc_id, page, y0, string_agg(cell_text, '|' ORDER BY cell) AS cells FROM j GROUP BY ALL""",
)
def cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = let(F.col("blocks"), lambda b: ops.baselines(b, 4.0))
    shown = F.transform(rows, lambda r: F.struct(
        F.get(r, F.lit(0))["page"].alias("page"), F.get(r, F.lit(0))["y0"].alias("y0"), F.array_join(ops.cells(r, 12.0), "|").alias("cells")))
    return item_spans(spark, sf).select("doc_id", F.inline(shown))


@query("grp05_rows_table", _ROWS)
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return numbers(ops.rows_table(item_cells(spark, sf), spec("table")))


@query("grp06_rows_sections", _ROWS)
def section_rows(spark: SparkSession, sf: str) -> DataFrame:
    paragraphs = F.transform(
        "items",
        lambda i: F.concat_ws(
            "\n", F.concat(F.lit("Line: "), i["l_linenumber"].cast("string")), F.lit("qty: 0"), F.format_string("QTY %.0f", i["l_quantity"]),
            F.format_string("price: %.2f", i["l_extendedprice"]), F.lit("# comment"), F.format_string("Discount : %.2f", i["l_discount"]),
        ),
    )
    text = F.concat_ws("\n\n", F.lit("Order Items"), paragraphs, F.lit("Line: 1\nqty: 2"))
    docs = d.order_lines(spark, sf).select(F.col("o_orderkey").alias("doc_id"), text_blocks(text, sep="\f").alias("blocks"))
    return numbers(ops.rows_table(docs, spec("sections")))


@query("grp07_rows_glued", _ROWS)
def glued_rows(spark: SparkSession, sf: str) -> DataFrame:
    return numbers(ops.rows_table(reports_as(spark, sf, " ", one_line=True), spec("list")))


@query(
    "grp08_typed_rows",
    f"""WITH {REPORTS} SELECT l_orderkey AS doc_id, f.field, CASE f.field WHEN 'code' THEN l_linenumber::DOUBLE WHEN 'price' THEN l_extendedprice END AS num,
   CASE f.field WHEN 'name' THEN CAST(l_linenumber AS VARCHAR) || 'd' WHEN 'free' THEN 'x' || printf('%.0f', l_quantity) ELSE '' END AS str
FROM items CROSS JOIN (SELECT unnest(['code', 'name', 'free', 'price']) AS field) f WHERE l_linenumber % 2 = 0""",
)
def typed(spark: SparkSession, sf: str) -> DataFrame:
    """Header rows and rows whose number does not parse (``1d``) are dropped."""
    group = GroupSpec("items", "order items", (("code", "number"), ("name", "string"), ("free", None), ("price", "number")), "list")
    rows = F.transform(
        "items",
        lambda i: F.concat_ws(
            " ", F.concat(i["l_linenumber"].cast("string"), F.when(i["l_linenumber"] % 2 == 1, "d").otherwise("")),
            F.concat(i["l_linenumber"].cast("string"), F.lit("d")), F.concat(F.lit("x"), F.format_string("%.0f", i["l_quantity"])),
            F.format_string("%.2f", i["l_extendedprice"]),
        ),
    )
    text = F.concat_ws("\n", F.lit("Order Items"), F.lit("CODE Name free Price"), rows)
    docs = d.order_lines(spark, sf).select(F.col("o_orderkey").alias("doc_id"), text_blocks(text).alias("blocks"))
    return ops.rows_table(docs, group).select("doc_id", "field", "num", F.coalesce("str", F.lit("")).alias("str"))


@query(
    "grp09_row_rule_outcomes",
    f"""WITH {REPORTS} SELECT l_orderkey AS doc_id, 'items[' || row_ix || ']' AS field, 'unit_price' AS rule, l_extendedprice / l_quantity <= 2000 + 1e-12 AS passed,
   CASE WHEN l_extendedprice / l_quantity <= 2000 + 1e-12 THEN 'price / qty <= 2000'
        ELSE 'line ' || l_linenumber || '.0: ' || CAST(l_extendedprice AS VARCHAR) || ' for ' || CAST(l_quantity AS VARCHAR) END AS expected FROM items
UNION ALL SELECT l_orderkey, 'items[' || row_ix || ']', 'some_discount', l_discount > 0 OR l_quantity < 10,
   CASE WHEN l_discount > 0 OR l_quantity < 10 THEN 'discount > 0 OR qty < 10' ELSE 'Row rule some_discount failed' END FROM items
UNION ALL SELECT l_orderkey, 'items[' || row_ix || ']', 'broken', false, 'price >' FROM items""",
)
def rule_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ops.row_rule_outcomes(d.order_reports(spark, sf), spec("list")).select("doc_id", "field", "rule", "passed", "expected")


@query(
    "grp10_groups_not_found",
    f"WITH {REPORTS} SELECT doc_id, 'items' AS field, 'group_not_found' AS rule FROM rep WHERE n_items = 0",
)
def not_found(spark: SparkSession, sf: str) -> DataFrame:
    return ops.groups_not_found(d.order_reports(spark, sf), spec("list"))


