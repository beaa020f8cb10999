"""Run history, tags and cohorts over orders as runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions.text import number_text
from docaudit.operators import cohorts as c
from docaudit.operators import runs as ops
from docaudit.plans import datasets as d
from docaudit.plans.checklist import Checklist
from docaudit.sources import sinks

from .fields import settled
from .registry import query, scratch_folder
from .sql import REPORT_CONTENTS, RUNS


@query("run01_visible", f"WITH {RUNS} SELECT id, outcome FROM runs WHERE archived_at IS NULL AND deleted_at IS NULL")
def visible(spark: SparkSession, sf: str) -> DataFrame:
    return ops.visible(d.runs(spark, sf)).select("id", "outcome")


@query(
    "run02_filter_runs",
    f"WITH {RUNS} SELECT id, document_filename FROM runs WHERE schema_key = '1-URGENT' AND version_label = '1.1' AND outcome = 'FAIL' AND contains(lower(document_filename), 'r_1')",
)
def filtered(spark: SparkSession, sf: str) -> DataFrame:
    return ops.filter_runs(d.runs(spark, sf), "1-URGENT", "1.1", "FAIL", " R_1 ").select("id", "document_filename")


@query("run03_page_runs", f"WITH {RUNS} SELECT id, document_filename FROM runs WHERE archived_at IS NULL AND deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 500 OFFSET 1000")
def page(spark: SparkSession, sf: str) -> DataFrame:
    return ops.page_runs(ops.visible(d.runs(spark, sf)), 3, 500).select("id", "document_filename")


@query("run04_count_runs", f"WITH {RUNS} SELECT count(*) AS total FROM runs WHERE archived_at IS NULL AND deleted_at IS NULL AND outcome = 'PASS'")
def counted(spark: SparkSession, sf: str) -> DataFrame:
    return ops.count_runs(ops.filter_runs(ops.visible(d.runs(spark, sf)), outcome="PASS"))


_LIFE = """eff AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'archive' WHEN 'click' THEN 'unarchive' WHEN 'error' THEN 'delete'
   WHEN 'purchase' THEN 'restore' ELSE 'note' END AS action FROM events),
arch AS (SELECT id, arg_max(action, seq) AS a FROM eff WHERE action IN ('archive', 'unarchive', 'restore') GROUP BY id),
del AS (SELECT id, arg_max(action, seq) AS a FROM eff WHERE action IN ('delete', 'restore') GROUP BY id)"""


@query(
    "run05_apply_lifecycle",
    f"""WITH {RUNS}, {_LIFE} SELECT runs.id, CASE WHEN arch.a IS NULL THEN archived_at IS NOT NULL ELSE arch.a = 'archive' END AS archived,
   CASE WHEN del.a IS NULL THEN deleted_at IS NOT NULL ELSE del.a = 'delete' END AS deleted
FROM runs LEFT JOIN arch USING (id) LEFT JOIN del USING (id)""",
)
def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    action = (
        F.when(kind == "view", "archive").when(kind == "click", "unarchive").when(kind == "error", "delete")
        .when(kind == "purchase", "restore").otherwise("note")
    )
    events = d.table(spark, sf, "events").select(F.col("user_id").alias("id"), action.alias("action"), "ts", F.col("event_id").alias("seq"))
    out = ops.apply_lifecycle(d.runs(spark, sf), events)
    return out.select("id", F.col("archived_at").isNotNull().alias("archived"), F.col("deleted_at").isNotNull().alias("deleted"))


@query(
    "run06_coerce_correction",
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 4 <> 3 THEN p_size + 0.5::DOUBLE END
     WHEN 1 THEN CASE WHEN p_size % 4 <> 3 THEN p_size::DOUBLE END END AS num,
   CASE WHEN p_partkey % 3 <> 2 AND p_size % 4 <> 3 THEN '' WHEN p_size % 4 = 3 THEN p_size || 'd' ELSE ' ' || p_size || '.5 ' END AS str FROM part""",
)
def corrections_typed(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 4 == 3, F.concat(size, F.lit("d"))).otherwise(F.concat(F.lit(" "), size, F.lit(".5 ")))
    typ = F.element_at(F.array(F.lit("number"), F.lit("integer"), F.lit("string")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), ops.coerce_correction(raw, typ).alias("v"))
    return rows.select("id", "v.num", F.coalesce("v.str", F.lit("")).alias("str"))


PLAIN = Checklist.from_body(
    "order_plain",
    {"version": "2", "fields": {
        "total_due": {"type": "number", "required": True, "min": 0, "max": 300000}, "status": {"type": "string", "required": True},
        "item_count": {"type": "number", "required": True}},
     "cross_field_rules": [{"id": "per_item", "expression": "total_due <= 200000 * item_count"}]},
)


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Values of earlier runs: the total, if stated once, and the status of every order."""
    k = F.col("o_orderkey")
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = F.filter(
        F.array(
            F.struct(F.lit("total_due").alias("field"), F.when(k % 17 != 0, F.col("o_totalprice")).alias("value_num"), none_s.alias("value_str")),
            F.struct(F.lit("status").alias("field"), none_d.alias("value_num"), F.col("o_orderstatus").alias("value_str")),
        ),
        lambda r: r["value_num"].isNotNull() | r["value_str"].isNotNull(),
    )
    return d.table(spark, sf, "orders").select(k.alias("run_id"), F.inline(rows))


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Every third run gets its item count, every sixth also a new total (some of them unreadable)."""
    k = F.col("o_orderkey")
    raw = F.filter(
        F.array(
            F.struct(F.lit("item_count").alias("field"), F.when(k % 3 == 0, F.lit(" 1 ")).alias("raw")),
            F.struct(F.lit("total_due").alias("field"), F.when(k % 6 == 0, F.when(k % 12 == 0, "n/a").otherwise("150000")).alias("raw")),
        ),
        lambda r: r["raw"].isNotNull(),
    )
    return d.table(spark, sf, "orders").select(k.alias("run_id"), F.inline(raw))


def corrected_status(spark: SparkSession, sf: str) -> DataFrame:
    ambiguous = d.table(spark, sf, "orders").filter(F.col("o_orderkey") % 17 == 0).select(F.col("o_orderkey").alias("run_id"), F.lit("total_due").alias("field"))
    evaluations = d.table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("ix"),
        F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "ambiguous").otherwise("pass").alias("evaluation"),
        (F.col("event_id") % 4 == 0).alias("informative_only"),
    )
    return ops.apply_corrections(stored(spark, sf), ambiguous, corrections(spark, sf), PLAIN, evaluations)


_CORRECTED = """evals AS (SELECT user_id AS id, event_id AS ix, CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'ambiguous' ELSE 'pass' END AS e FROM events WHERE event_id % 4 <> 0),
firsts AS (SELECT id, arg_min(e, ix) AS first_hit FROM evals WHERE e <> 'pass' GROUP BY id),
fixed AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 6 <> 0 THEN 'AMBIGUOUS' WHEN first_hit = 'fail' THEN 'FAIL' WHEN first_hit = 'ambiguous' THEN 'AMBIGUOUS'
     WHEN o_orderkey % 12 = 0 THEN 'FAIL' WHEN o_orderkey % 6 = 0 THEN 'PASS' WHEN o_totalprice > 200000 + 1e-12 THEN 'FAIL' ELSE 'PASS' END AS status
   FROM orders LEFT JOIN firsts ON id = o_orderkey WHERE o_orderkey % 3 = 0)"""


@query("run07_apply_corrections", f"WITH {_CORRECTED} SELECT id AS run_id, status FROM fixed")
def corrected(spark: SparkSession, sf: str) -> DataFrame:
    return corrected_status(spark, sf)


@query(
    "run07b_corrected_values",
    """SELECT o_orderkey AS run_id, 'status' AS field, NULL::DOUBLE AS value_num, o_orderstatus AS value_str, false AS corrected FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'item_count', 1, '', true FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'total_due', CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN 150000 ELSE o_totalprice END,
   CASE WHEN o_orderkey % 12 = 0 THEN 'n/a' ELSE '' END, o_orderkey % 6 = 0 FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 17 <> 0 OR o_orderkey % 6 = 0)""",
)
def corrected_rows(spark: SparkSession, sf: str) -> DataFrame:
    types = {f.name: f.type for f in PLAIN.fields}
    rows = ops.corrected_values(stored(spark, sf), corrections(spark, sf), types)
    return rows.select("run_id", "field", "value_num", F.coalesce("value_str", F.lit("")).alias("value_str"), "corrected")


@query(
    "run08_revisions",
    f"""WITH {RUNS}, {_CORRECTED} SELECT runs.id || '/r1' AS id, runs.id AS parent_run_id, 1 AS revision_number, fixed.status AS outcome, schema_key, version_label
FROM runs JOIN fixed USING (id)""",
)
def revised(spark: SparkSession, sf: str) -> DataFrame:
    parents = d.runs(spark, sf).withColumns({"revision_number": F.lit(0), "parent_run_id": F.lit(None).cast("long")})
    return ops.revisions(parents, corrected_status(spark, sf)).select("id", "parent_run_id", "revision_number", "outcome", "schema_key", "version_label")


@query(
    "run09_sub_resources",
    f"""WITH {REPORT_CONTENTS}, blocks AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ix FROM contents),
values AS (SELECT doc_id, unnest(string_split(resolved, ',')) AS text, generate_subscripts(string_split(resolved, ','), 1) - 1 AS ix FROM contents)
SELECT doc_id, 'block' AS part, ix, 'b' || ix AS name, text FROM blocks
UNION ALL SELECT doc_id, 'resolved', ix, coalesce(nullif(split_part(text, '=', 1), ''), '-'), split_part(text, '=', 2) FROM values
UNION ALL SELECT doc_id, 'candidate', 0, 'order_number', 'Order number: ' || doc_id FROM verdict
UNION ALL SELECT doc_id, 'candidate', 1, 'total_due', printf('Total due: %.2f', total) FROM verdict WHERE has_total
UNION ALL SELECT doc_id, 'candidate', 2, 'total_due', printf('Total due: %.2f', total + 100) FROM verdict WHERE has_second
UNION ALL SELECT doc_id, 'candidate', status_ix - 1, 'item_count', 'Items: ' || n_items FROM verdict
UNION ALL SELECT doc_id, 'candidate', status_ix, 'status', 'Status: ' || status FROM verdict""",
)
def sub_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Stored snapshots read back part by part, with their contents; an empty part still gives its run one row."""
    path = scratch_folder(spark)
    sinks.build_snapshots(settled(spark, sf)).select("doc_id", "snapshots").write.parquet(path)
    stored_runs = spark.read.parquet(path)

    def rows(df: DataFrame, part: str, name: Column, text: Column) -> DataFrame:
        return df.select("doc_id", F.lit(part).alias("part"), F.coalesce("ix", F.lit(0)).cast("long").alias("ix"), F.coalesce(name, F.lit("-")).alias("name"), F.coalesce(text, F.lit("")).alias("text"))

    item, num = F.col("item"), F.col("item.value.num")
    shown = F.when(item["field"] == "order_number", F.concat(F.lit("Order number: "), number_text(num))).otherwise(item["evidence_text"])
    return (
        rows(ops.run_blocks(stored_runs), "block", item["block_id"], item["text"])
        .unionByName(rows(ops.run_candidates(stored_runs), "candidate", item["field"], shown))
        .unionByName(rows(ops.run_resolved(stored_runs), "resolved", item["field"], F.coalesce(item["value"]["str"], number_text(num))))
    )


@query(
    "run10_dashboard",
    f"""WITH {RUNS} SELECT project_id, count(*) AS runs, CAST(count(*) FILTER (WHERE outcome = 'PASS') AS BIGINT) AS pass_count, CAST(count(*) FILTER (WHERE outcome = 'FAIL') AS BIGINT) AS fail_count,
   CAST(count(*) FILTER (WHERE outcome = 'AMBIGUOUS') AS BIGINT) AS ambiguous_count, any_value(checklists) AS checklists, any_value(versions) AS versions
FROM runs JOIN (SELECT project_id, count(DISTINCT schema_key) + 1 AS checklists, count(DISTINCT schema_key || '/' || version_label) + 2 AS versions FROM runs GROUP BY project_id) USING (project_id)
WHERE archived_at IS NULL AND deleted_at IS NULL GROUP BY project_id
UNION ALL SELECT 'not used yet', 0, 0, 0, 0, 1, 2
UNION ALL SELECT 'latest ' || id, 0, 0, 0, 0, 0, 0 FROM (SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS k
  FROM runs WHERE archived_at IS NULL AND deleted_at IS NULL) WHERE k <= 8""",
)
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    seen = ops.visible(d.runs(spark, sf))
    zero = F.lit(0).cast("long")
    recent = ops.recent_runs(seen).select(
        F.concat(F.lit("latest "), F.col("id").cast("string")).alias("project_id"),
        *(zero.alias(n) for n in ("runs", "pass_count", "fail_count", "ambiguous_count", "checklists", "versions")),
    )
    # The catalogue holds what any run used, a checklist nobody ran in each project, and a project without runs.
    used = d.runs(spark, sf).select("project_id", "schema_key", "version_label")
    idle = d.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("project_id")).distinct()
    idle = idle.unionByName(spark.range(1).select(F.lit("not used yet").alias("project_id")))
    idle = idle.select("project_id", F.lit("idle").alias("schema_key"), F.explode(F.array(F.lit("1.0"), F.lit("1.1"))).alias("version_label"))
    return ops.dashboard(seen, used.unionByName(idle)).unionByName(recent)


@query(
    "run11_batch_progress",
    f"""WITH {RUNS}, q AS (SELECT nation, outcome, CASE WHEN id % 10 = 0 THEN 'error' WHEN id % 10 = 1 AND nation < 5 THEN 'running' ELSE 'done' END AS status FROM runs)
SELECT nation, count(*) AS total, CAST(count(*) FILTER (WHERE status <> 'running') AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE status = 'done' AND outcome = 'PASS') AS BIGINT) AS pass_count,
  CAST(count(*) FILTER (WHERE status = 'done' AND outcome = 'FAIL') AS BIGINT) AS fail_count, CAST(count(*) FILTER (WHERE status = 'done' AND outcome = 'AMBIGUOUS') AS BIGINT) AS ambiguous_count,
  CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS error_count, bool_and(status <> 'running') AS is_done FROM q GROUP BY nation""",
)
def progress(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id") % 10
    status = F.when(k == 0, "error").when((k == 1) & (F.col("nation") < 5), "running").otherwise("done")
    return ops.batch_progress(d.runs(spark, sf).withColumn("status", status), ["nation"])


# ---- tags and cohorts ------------------------------------------------------------------------


@query(
    "coh01_normalize_tags",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'k=' || json_extract_string(props, '$.k') WHEN 1 THEN 'a=2;b=' || event_type || ';c=' WHEN 2 THEN 'a=x' ELSE '' END AS tags FROM events""",
)
def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Objects and lists, blank keys, repeats (the last wins) and key-only tags."""
    k = F.col("event_id") % 4
    listed = F.concat(
        F.lit('[{"key": " a ", "value": "1"}, {"key": "", "value": "9"}, {"key": "b", "value": " '), "event_type",
        F.lit(' "}, {"key": "a", "value": "2"}, {"key": "c", "value": "  "}]'),
    )
    raw = F.when(k == 0, F.col("props")).when(k == 1, listed).when(k == 2, '{" a": "z", "a": "x", " ": "y"}')
    rows = c.normalize_tags(d.table(spark, sf, "events").select("event_id", raw.alias("raw")))
    pairs = F.transform(
        F.sort_array(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    )
    return rows.select("event_id", F.array_join(pairs, ";").alias("tags"))


@query(
    "coh02_tags_match",
    f"""WITH {RUNS} SELECT id, nation % 2 = 0 AS even_nation, id % 5 = 0 AND nation = 3 AS audit_in_3 FROM runs""",
)
def matches(spark: SparkSession, sf: str) -> DataFrame:
    def req(*pairs):
        return F.array(*(F.struct(F.lit(k).alias("key"), (v if not isinstance(v, str | None) else F.lit(v).cast("string")).alias("value")) for k, v in pairs))

    own = F.when(F.col("nation") % 2 == 0, F.concat(F.lit(" "), F.col("nation").cast("string"), F.lit(" "))).otherwise("none")
    return d.runs(spark, sf, with_tags=True).select(
        "id", c.tags_match(F.col("attributes"), req(("nation", own), ("", "x"), ("segment", None))).alias("even_nation"),
        c.tags_match(F.col("attributes"), req((" audit ", None), ("nation", "3"))).alias("audit_in_3"),
    )


COHORT = c.Cohort("urgent", None, "1-URGENT", " ", ("PASS", "FAIL"), (("audit", None), ("nation", " 4 "), (" ", "x")), 45.0)
_IN_COHORT = "schema_key = '1-URGENT' AND outcome IN ('PASS', 'FAIL') AND id % 5 = 0 AND nation = 4 AND archived_at IS NULL AND deleted_at IS NULL"
_RATE = """count(*) AS total, CAST(count(*) FILTER (WHERE outcome = 'PASS') AS BIGINT) AS pass_count, CAST(count(*) FILTER (WHERE outcome = 'FAIL') AS BIGINT) AS fail_count,
  CAST(count(*) FILTER (WHERE outcome = 'AMBIGUOUS') AS BIGINT) AS ambiguous_count, round(count(*) FILTER (WHERE outcome = 'PASS') / count(*) * 100.0::DOUBLE, 2) AS pass_rate_pct"""


@query("coh03_filter_cohort", f"WITH {RUNS} SELECT id FROM runs WHERE {_IN_COHORT}")
def cohort_rows(spark: SparkSession, sf: str) -> DataFrame:
    return c.filter_cohort(ops.visible(d.runs(spark, sf, with_tags=True)), COHORT).select("id")


@query(
    "coh04_aggregate_outcomes",
    f"""WITH {RUNS} SELECT schema_key, {_RATE}, 30.0::DOUBLE AS pass_threshold_pct, count(*) FILTER (WHERE outcome = 'PASS') / count(*) * 100.0::DOUBLE >= 30 AS meets_threshold
FROM runs WHERE archived_at IS NULL AND deleted_at IS NULL GROUP BY schema_key""",
)
def by_priority(spark: SparkSession, sf: str) -> DataFrame:
    return c.aggregate_outcomes(ops.visible(d.runs(spark, sf)), 30.0, ["schema_key"])


@query("coh05_evaluate_cohort", f"WITH {RUNS} SELECT {_RATE.replace('/ count(*)', '/ greatest(count(*), 1)')}, 45.0::DOUBLE AS pass_threshold_pct, count(*) > 0 AND count(*) FILTER (WHERE outcome = 'PASS') / greatest(count(*), 1) * 100.0::DOUBLE >= 45 AS meets_threshold FROM runs WHERE {_IN_COHORT}")
def one_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return c.evaluate_cohort(ops.visible(d.runs(spark, sf, with_tags=True)), COHORT)[0]


@query(
    "coh06_evaluate_cohorts",
    f"""WITH {RUNS}, saved AS (SELECT s.c_mktsegment || '/' || n_nationkey AS cohort_id, s.c_mktsegment AS project_id, n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '1-URGENT' ELSE 'none' END AS k,
    n_nationkey * 5.0::DOUBLE AS thr FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s),
hit AS (SELECT cohort_id, outcome FROM saved JOIN runs ON runs.project_id = saved.project_id AND (k = '' OR schema_key = k) AND nation = n_nationkey AND (n_nationkey % 2 = 0 OR outcome IN ('PASS', 'FAIL'))
   AND archived_at IS NULL AND deleted_at IS NULL),
agg AS (SELECT cohort_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'PASS') AS p, count(*) FILTER (WHERE outcome = 'FAIL') AS f, count(*) FILTER (WHERE outcome = 'AMBIGUOUS') AS a FROM hit GROUP BY cohort_id)
SELECT cohort_id, coalesce(total, 0) AS total, CAST(coalesce(p, 0) AS BIGINT) AS pass_count, CAST(coalesce(f, 0) AS BIGINT) AS fail_count, CAST(coalesce(a, 0) AS BIGINT) AS ambiguous_count,
  coalesce(round(p / total * 100.0::DOUBLE, 2), 0) AS pass_rate_pct, least(thr, 100.0) AS pass_threshold_pct, coalesce(p / total * 100.0::DOUBLE >= least(thr, 100.0), false) AS meets_threshold
FROM saved LEFT JOIN agg USING (cohort_id)""",
)
def all_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """One saved cohort per project and nation; a third of them match nothing."""
    projects = d.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("project_id")).distinct()
    n = F.col("nation")
    last = F.element_at(F.array(F.lit(""), F.lit("1-URGENT"), F.lit("none")), (n % 3 + 1).cast("int"))
    saved = projects.withColumn("nation", F.explode(F.sequence(F.lit(0), F.lit(24)))).select(
        F.concat(F.col("project_id"), F.lit("/"), n.cast("string")).alias("id"), "project_id", last.alias("schema_key"), F.lit(" ").alias("version_label"),
        F.when(n % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("PASS"), F.lit("FAIL"))).alias("outcomes"),
        F.array(F.struct(F.lit("nation").alias("key"), n.cast("string").alias("value"))).alias("tags"), (n * 5).cast("double").alias("threshold"),
    )
    return c.evaluate_cohorts(ops.visible(d.runs(spark, sf, with_tags=True)), saved)


@query(
    "coh06b_evaluate_many_cohorts",
    f"""WITH {RUNS}, held AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'BIG' ELSE project_id END AS project FROM runs WHERE archived_at IS NULL AND deleted_at IS NULL),
saved AS (SELECT n_nationkey || '-' || s.c_mktsegment || '-' || i AS cohort_id, n_nationkey AS nation, CASE WHEN i % 2 = 0 THEN 'BIG' ELSE s.c_mktsegment END AS project,
    CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN '1-URGENT' ELSE '3-MEDIUM' END AS k, CASE WHEN i % 4 < 2 THEN '' ELSE '1.' || (i % 4) END AS ver, i FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s CROSS JOIN range(8) t(i)),
hit AS (SELECT cohort_id, outcome FROM saved s JOIN held r ON r.project = s.project AND (k = '' OR schema_key = k) AND (ver = '' OR version_label = ver) AND (i = 7 OR r.nation = s.nation) AND (i % 5 <> 3 OR id % 5 = 0) AND (i % 2 = 0 OR outcome <> 'FAIL')),
agg AS (SELECT cohort_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'PASS') AS p, count(*) FILTER (WHERE outcome = 'FAIL') AS f, count(*) FILTER (WHERE outcome = 'AMBIGUOUS') AS a FROM hit GROUP BY cohort_id)
SELECT cohort_id, coalesce(total, 0) AS total, CAST(coalesce(p, 0) AS BIGINT) AS pass_count, CAST(coalesce(f, 0) AS BIGINT) AS fail_count, CAST(coalesce(a, 0) AS BIGINT) AS ambiguous_count FROM saved LEFT JOIN agg USING (cohort_id)""",
)
def many_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand cohorts; one project holds half of all runs. Some ask for a checklist, a version, two tags, or none."""
    runs = ops.visible(d.runs(spark, sf, with_tags=True)).withColumn("project_id", F.when(F.col("id") % 2 == 0, "BIG").otherwise(F.col("project_id")))
    segments = d.table(spark, sf, "customer").select("c_mktsegment").distinct()
    i, nation = F.col("i"), F.col("n_nationkey").cast("string")
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    audit = F.when(i % 5 == 3, F.array(tag(" audit ", F.lit(None)))).otherwise(F.array().cast(c.TAG_REQUIREMENTS))
    where = F.when(i != 7, F.array(tag("nation", nation))).otherwise(F.array().cast(c.TAG_REQUIREMENTS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    saved = segments.withColumn("n_nationkey", each(24)).withColumn("i", each(7)).select(
        F.concat_ws("-", nation, "c_mktsegment", i.cast("string")).alias("id"), F.when(i % 2 == 0, "BIG").otherwise(F.col("c_mktsegment")).alias("project_id"),
        F.when(i % 3 == 1, "1-URGENT").when(i % 3 == 2, " 3-MEDIUM").alias("schema_key"), F.when(i % 4 >= 2, F.concat(F.lit("1."), (i % 4).cast("string"))).otherwise(" ").alias("version_label"),
        F.when(i % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("PASS"), F.lit("AMBIGUOUS"))).alias("outcomes"), F.concat(where, audit).alias("tags"), F.lit(50.0).alias("threshold"),
    )
    return c.evaluate_cohorts(runs, saved).select("cohort_id", "total", "pass_count", "fail_count", "ambiguous_count")


_VOCAB = """seen AS (SELECT * FROM runs WHERE archived_at IS NULL AND deleted_at IS NULL),
vocab AS (SELECT DISTINCT project_id, 'segment' AS tag_key, project_id AS tag_value FROM seen
  UNION SELECT project_id, 'nation', CAST(nation AS VARCHAR) FROM seen UNION SELECT project_id, 'audit', '' FROM seen WHERE id % 5 = 0)"""


@query("coh07_tag_vocabulary", f"WITH {RUNS}, {_VOCAB} SELECT * FROM vocab")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return c.tag_vocabulary(d.runs(spark, sf, with_tags=True)).withColumn("tag_value", F.coalesce("tag_value", F.lit("")))


@query(
    "coh08_merge_vocabularies",
    f"""WITH {RUNS}, {_VOCAB}, other AS (SELECT DISTINCT c_mktsegment AS project_id, 'audit' AS tag_key, 'yes' AS tag_value FROM customer WHERE c_nationkey < 20
  UNION SELECT DISTINCT c_mktsegment, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer UNION SELECT DISTINCT c_mktsegment, 'bare', '' FROM customer)
SELECT DISTINCT * FROM (SELECT * FROM vocab WHERE tag_value <> '' UNION ALL SELECT * FROM other
  UNION ALL SELECT * FROM vocab v WHERE tag_value = '' AND NOT EXISTS (SELECT 1 FROM other o WHERE o.project_id = v.project_id AND o.tag_key = v.tag_key AND o.tag_value <> ''))""",
)
def merged(spark: SparkSession, sf: str) -> DataFrame:
    cust = d.table(spark, sf, "customer")
    project = F.col("c_mktsegment").alias("project_id")
    other = (
        cust.filter("c_nationkey < 20").select(project, F.lit("audit").alias("tag_key"), F.lit("yes").alias("tag_value"))
        .unionByName(cust.select(project, F.lit("nation").alias("tag_key"), F.col("c_nationkey").cast("string").alias("tag_value")))
        .unionByName(cust.select(project, F.lit("bare").alias("tag_key"), F.lit(None).cast("string").alias("tag_value")))
    )
    mine = c.tag_vocabulary(d.runs(spark, sf, with_tags=True))
    return c.merge_vocabularies(mine, other).withColumn("tag_value", F.coalesce("tag_value", F.lit("")))


