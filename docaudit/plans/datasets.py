"""Adapters: the driver tables seen as runs, documents and events of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.plans.checklist import Checklist
from docaudit.sources.blocks import text_blocks

ORDER_CHECKLIST = Checklist.from_body(
    "order_report",
    {
        "version": "2",
        "fields": {
            "order_number": {
                "type": "number", "required": True, "regex_hint": r"(?i)order\s*number:\s*(\d+)",
                "aliases": ["Order number"],
            },
            "total_due": {
                "type": "number", "required": True, "min": 0, "max": 300000,
                "regex_hint": r"(?i)total\s*due:\s*(?:USD\s*)?([\d.]+)", "aliases": ["Total due", "Amount due"],
            },
            "status": {"type": "string", "required": True, "aliases": ["Status"]},
            "item_count": {"type": "number", "regex_hint": r"Items:\s*(\d+)", "aliases": ["Items"]},
        },
        "rules": ["required", "range_validation", "type_check"],
        "cross_field_rules": [
            {
                "id": "total_per_item", "expression": "total_due / item_count <= 200000 OR item_count == 0",
                "fields": ["total_due", "item_count"],
                "error_message": "{total_due} over {item_count} items is too much",
            }
        ],
        "groups": {
            "items": {
                "section_hint": "Order Items", "structure_hint": "list",
                "row_fields": {
                    "line": {"type": "number"}, "qty": {"type": "number"}, "price": {"type": "number"},
                    "discount": {"type": "number"},
                },
                "row_rules": [
                    {
                        "id": "unit_price", "expression": "price / qty <= 2000",
                        "error_message": "line {line}: {price} for {qty}",
                    }
                ],
            }
        },
    },
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str, with_tags: bool = False) -> DataFrame:
    """Orders as validation runs; the customer's segment is the project."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    k = F.col("o_orderkey")
    out = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        k.alias("id"),
        F.col("c_mktsegment").alias("project_id"),
        F.col("o_orderpriority").alias("schema_key"),
        F.concat(F.lit("1."), (k % 4).cast("string")).alias("version_label"),
        F.concat(F.lit("order_"), k.cast("string"), F.lit(".pdf")).alias("document_filename"),
        F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS")
        .otherwise("AMBIGUOUS").alias("outcome"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 11 == 0, F.col("o_orderdate")).alias("archived_at"),
        F.when(k % 13 == 0, F.col("o_orderdate")).alias("deleted_at"),
        F.col("c_nationkey").cast("long").alias("nation"),
    )
    if with_tags:
        out = out.withColumn(
            "attributes",
            F.when(
                F.col("id") % 5 == 0,
                F.map_from_arrays(
                    F.array(F.lit("segment"), F.lit("nation"), F.lit("audit")),
                    F.array(F.col("project_id"), F.col("nation").cast("string"), F.lit(None).cast("string")),
                ),
            ).otherwise(
                F.map_from_arrays(
                    F.array(F.lit("segment"), F.lit("nation")),
                    F.array(F.col("project_id"), F.col("nation").cast("string")),
                )
            ),
        )
    return out


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as an array, ordered by line number: one shuffle per side.

    What follows costs processor time rather than bytes, so the shuffle keeps the session's partition
    count; left to itself, adaptive execution would merge small partitions by their size. Join and
    aggregation both reuse this partitioning.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"
    ).repartition(n, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").repartition(n, "o_orderkey")
    items = F.sort_array(
        F.collect_list(
            F.when(
                F.col("l_linenumber").isNotNull(),
                F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_discount"),
            )
        )
    )
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy("o_orderkey", "o_orderstatus", "o_totalprice")
        .agg(items.alias("items"))
    )


def order_texts(orders: DataFrame) -> DataFrame:
    """Text reports. Every 19th order lacks its total, every 17th states a second, different one."""
    k = F.col("o_orderkey")
    total = F.when(k % 19 != 0, F.format_string("Total due: %.2f", "o_totalprice"))
    second = F.when((k % 17 == 0) & (k % 19 != 0), F.format_string("Total due: %.2f", F.col("o_totalprice") + 100))
    rows = F.transform(
        "items",
        lambda i: F.format_string(
            "%d %.0f %.2f %.2f", i["l_linenumber"], i["l_quantity"], i["l_extendedprice"], i["l_discount"]
        ),
    )
    text = F.concat_ws(
        "\n",
        F.lit("ORDER REPORT"),
        F.format_string("Order number: %d", "o_orderkey"),
        total,
        second,
        F.concat(F.lit("Status: "), F.col("o_orderstatus")),
        F.format_string("Items: %d", F.size("items")),
        F.lit("Order Items"),
        rows,
    )
    return orders.select(k.alias("doc_id"), text.alias("text"))


def order_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text, blocks)`` of the rendered orders."""
    return order_texts(order_lines(spark, sf_dir)).withColumn("blocks", text_blocks(F.col("text")))


def document_blocks(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """``(doc_id, lang, source, blocks)`` of the prose documents.

    ``deal`` deals them out by key first, for work on each document that takes longer than its shuffle: files of few row
    groups give few tasks.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    if deal:
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return docs.select("doc_id", "lang", "source", text_blocks(F.col("text")).alias("blocks"))
