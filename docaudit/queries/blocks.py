"""Block enrichment over prose documents and rendered orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import exploding, let
from docaudit.operators import blocks as ops
from docaudit.plans import datasets as d
from docaudit.plans.checklist import GroupSpec
from docaudit.sources.blocks import BLOCKS_TYPE

from .registry import query
from .sql import BLOCKS, REPORTS, SPANS

ITEMS = GroupSpec("items", "order items", (("line", "number"), ("qty", "number"), ("price", "number"), ("discount", "number")), "list")


def fonted(spark: SparkSession, sf: str) -> DataFrame:
    """Prose blocks where every fifth line is set in a larger font."""
    return d.document_blocks(spark, sf, deal=True).withColumn(
        "blocks",
        F.transform("blocks", lambda b: b.withField("font_size_max", F.when(b["block_ix"] % 5 == 0, 14.0).otherwise(10.0))),
    )


def item_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as positioned spans on two pages."""
    boxes = F.transform(
        "items",
        lambda i, n: F.struct(
            n.cast("int").alias("block_ix"), F.concat(F.lit("s"), n.cast("string")).alias("block_id"),
            (i["l_linenumber"] % 2 + 1).alias("page"), (i["l_quantity"] * 10).alias("x0"),
            (i["l_linenumber"] * 12).cast("double").alias("y0"),
            (i["l_quantity"] * 10 + 20 + i["l_discount"] * 3000).alias("x1"),
            (i["l_linenumber"] * 12 + 10).cast("double").alias("y1"),
            F.format_string("%.2f", i["l_extendedprice"]).alias("text"),
            F.lit(None).cast("string").alias("section_label"), F.lit(None).cast("double").alias("font_size_max"),
        ),
    )
    return d.order_lines(spark, sf).select(F.col("o_orderkey").alias("doc_id"), boxes.cast(BLOCKS_TYPE).alias("blocks"))


@query(
    "blk01_infer_sections",
    rf"""WITH {BLOCKS},
med AS (SELECT doc_id, median(CASE WHEN block_ix % 5 = 0 THEN 14.0 ELSE 10.0 END) AS m FROM blocks GROUP BY doc_id),
marked AS (
  SELECT doc_id, block_ix, text,
    length(text) < 80 AND text NOT LIKE '%:%' AND ((CASE WHEN block_ix % 5 = 0 THEN 14.0 ELSE 10.0 END) > m + 1.5
      OR (length(text) > 2 AND regexp_full_match(text, '[\p{{L}} ]+') AND text = upper(text) AND text <> lower(text))) AS head
  FROM blocks JOIN med USING (doc_id))
SELECT doc_id, block_ix, CASE WHEN head THEN '' ELSE coalesce(
    last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ix), '') END AS section_label
FROM marked""",
)
def sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.infer_sections(fonted(spark, sf)).select("doc_id", F.inline(exploding(F.col("blocks"))))
    return rows.select(
        "doc_id", F.col("block_ix").cast("long").alias("block_ix"), F.coalesce("section_label", F.lit("")).alias("section_label")
    )


@query(
    "blk02_with_column_band",
    f"""WITH {SPANS}, wide AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page) AS w FROM spans)
SELECT doc_id, block_ix, CASE WHEN (x0 + x1) / 2 < w / 3 THEN 'left' WHEN (x0 + x1) / 2 > w / 3 * 2 THEN 'right'
   WHEN x1 - x0 > w * 0.55::DOUBLE THEN 'full' ELSE 'center' END AS column_band FROM wide""",
)
def bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops.with_column_band(item_spans(spark, sf)).select("doc_id", F.inline(exploding(F.col("blocks"))))
    return rows.select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), "column_band")


@query(
    "blk03_sparse_documents",
    f"""WITH {BLOCKS} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS text_chars,
   sum(length(text)) < 60 OR (doc_id % 10 = 0 AND sum(length(text)) < 50) AS is_sparse FROM blocks GROUP BY doc_id""",
)
def sparse(spark: SparkSession, sf: str) -> DataFrame:
    docs = d.document_blocks(spark, sf).withColumn(
        "image_pages", F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    )
    return ops.sparse_documents(docs).select("doc_id", F.col("text_chars").cast("long").alias("text_chars"), "is_sparse")


@query(
    "blk04_serialize_layout",
    f"""WITH {SPANS}, wide AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page) AS w FROM spans),
entry AS (SELECT doc_id, page, y0, x0, block_ix, '[s' || block_ix || ' p' || page || ' col='
    || CASE WHEN (x0 + x1) / 2 < w / 3 THEN 'left' WHEN (x0 + x1) / 2 > w / 3 * 2 THEN 'right' WHEN x1 - x0 > w * 0.55::DOUBLE THEN 'full' ELSE 'center' END
    || ' bbox=(' || round(x0, 1) || ',' || round(y0, 1) || ')-(' || round(x1, 1) || ',' || round(y1, 1) || ')]' || chr(10) || text || chr(10) AS line FROM wide)
SELECT o_orderkey AS doc_id, coalesce(string_agg(line, chr(10) ORDER BY page, y0, x0, block_ix), '(no text blocks)') AS layout_text
FROM orders LEFT JOIN entry ON doc_id = o_orderkey GROUP BY o_orderkey""",
)
def layout(spark: SparkSession, sf: str) -> DataFrame:
    return ops.serialize_layout(item_spans(spark, sf))


_INDEX = f"""{BLOCKS},
entry AS (SELECT doc_id, block_ix, '[b' || block_ix || ' p1] ' || text AS line FROM blocks),
idx AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY block_ix) AS index_text FROM entry GROUP BY doc_id)"""


@query("blk05_serialize_index", f"""WITH {_INDEX} SELECT d.doc_id, coalesce(index_text, '') AS index_text
FROM (SELECT DISTINCT doc_id FROM blocks) d LEFT JOIN idx USING (doc_id)""")
def index(spark: SparkSession, sf: str) -> DataFrame:
    return ops.serialize_index(d.document_blocks(spark, sf))


@query(
    "blk06_document_view",
    f"""WITH {_INDEX} SELECT doc_id, coalesce(nullif(concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10),
   CASE WHEN doc_id % 2 = 0 THEN '# Document (markdown)' || chr(10) || chr(10) || 'Source ' || source END,
   CASE WHEN doc_id % 3 = 0 THEN '# Embedded images (vision)' || chr(10) || chr(10) || 'image in ' || lang END,
   CASE WHEN index_text <> '' THEN '# Evidence block index' || chr(10) || chr(10) || index_text END), ''), '(no text blocks)') AS view
FROM documents LEFT JOIN idx USING (doc_id)""",
)
def view(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    docs = d.document_blocks(spark, sf).withColumns(
        {
            "markdown": F.when(k % 2 == 0, F.concat(F.lit(" Source "), "source")),
            "image_text": F.when(k % 3 == 0, F.concat(F.lit("image in "), "lang")).otherwise("  "),
        }
    )
    return ops.document_view(docs).select("doc_id", "view")


@query(
    "blk07_text_head",
    f"""WITH {BLOCKS} SELECT doc_id, string_agg(text, chr(10) ORDER BY block_ix) AS head
FROM blocks GROUP BY doc_id""",
)
def head(spark: SparkSession, sf: str) -> DataFrame:
    return d.document_blocks(spark, sf).select("doc_id", let(F.col("blocks"), lambda b: ops.text_head(b)).alias("head"))


@query(
    "blk08_section_blocks",
    f"""WITH {REPORTS} SELECT l_orderkey AS doc_id, status_ix + 3 + row_ix AS block_ix, text FROM items JOIN rep ON doc_id = l_orderkey
UNION ALL SELECT doc_id, status_ix + 2, 'Order Items' FROM rep WHERE n_items = 0""",
)
def section_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A report without items has no body, so the header block itself stands in."""
    rows = ops.section_blocks(d.order_reports(spark, sf), ITEMS)
    return rows.select("doc_id", F.col("block_ix").cast("long").alias("block_ix"), "text")


@query(
    "blk09_section_text",
    f"""WITH {REPORTS} SELECT doc_id, 'Order Items' || coalesce(chr(10) || string_agg(text, chr(10) ORDER BY row_ix), '') AS section_text
FROM rep LEFT JOIN items ON doc_id = l_orderkey GROUP BY doc_id""",
)
def section_blob(spark: SparkSession, sf: str) -> DataFrame:
    return ops.section_text(d.order_reports(spark, sf), ITEMS)


@query(
    "blk10_choose_granularity",
    """SELECT spec_id, CASE WHEN version = '2' AND NOT bool_or(hint IN ('list', 'sections')) AND bool_or(hint = 'table')
   THEN 'spans' ELSE 'layout' END AS granularity
FROM (SELECT p_brand || '/' || (p_partkey % 1009) AS spec_id, CAST(1 + p_partkey % 1009 % 3 AS VARCHAR) AS version,
        CASE p_size % 4 WHEN 0 THEN 'list' WHEN 1 THEN '' ELSE 'table' END AS hint FROM part) GROUP BY spec_id, version""",
)
def granularity(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 1009
    hint = F.when(F.col("p_size") % 4 == 0, "List").when(F.col("p_size") % 4 == 1, F.lit(None)).otherwise("table")
    rows = d.table(spark, sf, "part").select(
        F.concat(F.col("p_brand"), F.lit("/"), k.cast("string")).alias("spec_id"), (k % 3 + 1).cast("string").alias("version"),
        hint.alias("structure_hint"),
    )
    return ops.choose_granularity(rows)
