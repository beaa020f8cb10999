"""SQL fragments shared by the oracle texts: the driver tables in the shapes the queries use."""

RUNS = """runs AS (
  SELECT o_orderkey AS id, c_mktsegment AS project_id, o_orderpriority AS schema_key,
         '1.' || (o_orderkey % 4) AS version_label, 'order_' || o_orderkey || '.pdf' AS document_filename,
         CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'AMBIGUOUS' END AS outcome,
         o_orderdate AS created_at, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS archived_at,
         CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate END AS deleted_at, CAST(c_nationkey AS BIGINT) AS nation
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# Lines of the prose documents as blocks.
BLOCKS = r"""raw_lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
blocks AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_ix,
         trim(line, ' ' || chr(9) || chr(13)) AS text, pos
  FROM raw_lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> '')"""

# Rendered order reports: block numbers and values of every line.
REPORTS = """items AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount) - 1 AS row_ix,
         printf('%d %.0f %.2f %.2f', l_linenumber, l_quantity, l_extendedprice, l_discount) AS text
  FROM lineitem),
counted AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
rep AS (
  SELECT o_orderkey AS doc_id, o_orderstatus AS status, o_totalprice AS total,
         CAST(printf('%.2f', o_totalprice + 100) AS DOUBLE) AS second,
         o_orderkey % 19 <> 0 AS has_total, (o_orderkey % 17 = 0 AND o_orderkey % 19 <> 0) AS has_second,
         coalesce(n, 0) AS n_items,
         2 + CAST(o_orderkey % 19 <> 0 AS BIGINT) + CAST(o_orderkey % 17 = 0 AND o_orderkey % 19 <> 0 AS BIGINT) AS status_ix
  FROM orders LEFT JOIN counted ON l_orderkey = o_orderkey)"""

# Outcome of the order checklist per document.
REPORT_STATUS = (
    REPORTS
    + """,
bad_rows AS (
  SELECT l_orderkey, count(*) AS n_bad FROM lineitem WHERE l_extendedprice / l_quantity > 2000 + 1e-12 GROUP BY l_orderkey),
verdict AS (
  SELECT rep.*, coalesce(n_bad, 0) AS n_bad,
         CASE WHEN has_second THEN 'AMBIGUOUS'
              WHEN NOT has_total OR total > 300000 OR n_items = 0 OR coalesce(n_bad, 0) > 0
                   OR (n_items > 0 AND total / n_items > 200000) THEN 'FAIL'
              ELSE 'PASS' END AS outcome
  FROM rep LEFT JOIN bad_rows ON l_orderkey = doc_id)"""
)

# Whole text and resolved values of every report.
REPORT_CONTENTS = (
    REPORT_STATUS
    + """,
rows_text AS (SELECT l_orderkey, string_agg(text, chr(10) ORDER BY row_ix) AS rows FROM items GROUP BY l_orderkey),
contents AS (
  SELECT doc_id, 'ORDER REPORT' || chr(10) || 'Order number: ' || doc_id || CASE WHEN has_total THEN chr(10) || printf('Total due: %.2f', total) ELSE '' END
      || CASE WHEN has_second THEN chr(10) || printf('Total due: %.2f', total + 100) ELSE '' END || chr(10) || 'Status: ' || status || chr(10) || 'Items: ' || n_items
      || chr(10) || 'Order Items' || coalesce(chr(10) || rows, '') AS text,
    CASE WHEN has_second THEN '' ELSE 'order_number=' || doc_id || CASE WHEN has_total THEN ',total_due=' || CASE WHEN total = floor(total) THEN CAST(CAST(total AS BIGINT) AS VARCHAR) ELSE CAST(total AS VARCHAR) END ELSE '' END
      || ',status=' || status || ',item_count=' || n_items END AS resolved
  FROM verdict LEFT JOIN rows_text ON l_orderkey = doc_id)"""
)

# Run rows of the rendered orders as a sink stores them.
RUN_ROWS = (
    REPORT_CONTENTS
    + """
SELECT doc_id, 'p' || (doc_id % 3) AS project_id, outcome, 'order_report' AS schema_key, '1.0' AS version_label,
  CASE WHEN outcome = 'AMBIGUOUS' THEN 0 ELSE CAST(NOT has_total AS BIGINT) + CAST(has_total AND total > 300000 AS BIGINT) + CAST(has_total AND (n_items = 0 OR total / n_items > 200000) AS BIGINT) + CAST(n_items = 0 AS BIGINT) + n_bad END AS n_failed,
  text, resolved, 'sha256:' || sha256(text) AS content_hash, 'b' || (5 + CAST(has_total AS BIGINT) + CAST(has_second AS BIGINT) + n_items - 1) AS last_block,
  CASE WHEN has_second THEN 'total_due:2' ELSE '' END AS conflicts, 0 AS n_tags, true AS dated, 0 AS revision_number FROM verdict JOIN contents USING (doc_id)"""
)

# Order lines as positioned spans.
SPANS = """spans AS (
  SELECT l_orderkey AS doc_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_discount) - 1 AS block_ix,
         1 + l_linenumber % 2 AS page, l_quantity * 10 AS x0, l_linenumber * 12.0::DOUBLE AS y0,
         l_quantity * 10 + 20 + l_discount * 3000 AS x1, l_linenumber * 12.0::DOUBLE + 10 AS y1,
         printf('%.2f', l_extendedprice) AS text
  FROM lineitem)"""
