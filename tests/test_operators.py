"""Operators on hand-made rows."""

import os

import pytest
from pyspark.sql import functions as F

from docaudit.functions import expressions as ex
from docaudit.functions.text import let
from docaudit.operators import cohorts, evidence, extraction, groups, mapping, runs, verdicts, views
from docaudit.operators.blocks import layout_text, sectioned
from docaudit.plans.checklist import Checklist, GroupSpec, RowRule, capture_order, java_pattern, labels_for, spec_column
from docaudit.sources import delimited, replies, sinks, uploads
from docaudit.sources.blocks import BLOCKS_TYPE, blocks_from_text, text_blocks


def texts(spark, *rows):
    return blocks_from_text(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))


def blocks(spark, spans):
    """spans: (text, page, x0, y0, x1, y1[, font])"""
    rows = [(i, f"s{i}", p, float(a), float(b), float(c), float(e), t, None, (rest or [None])[0]) for i, (t, p, a, b, c, e, *rest) in enumerate(spans)]
    return spark.createDataFrame([(1, rows)], f"doc_id long, blocks {BLOCKS_TYPE}")


# ---- rule expressions


@pytest.mark.parametrize(
    "text,values,expected",
    [
        ("depth > 3 OR width <= 70", {"depth": 2.5, "width": 71.0}, False),
        ("crates <= berths", {"crates": 18.0, "berths": 19.0}, True),
        ("crates <= berths", {"crates": 20.0, "berths": 19.0}, False),
        ("NOT (speed >= 22 AND load > 8)", {"speed": 22.0, "load": 9.0}, False),
        ("not speed >= 22", {"speed": 21.5}, True),
        ("fore - aft == trim", {"fore": 1.4, "aft": 1.1, "trim": 0.3}, True),
        ("a / b > 1 OR a > 0", {"a": 1.0, "b": 0.0}, False),
        ("a > 0 AND NOT a / b > 1", {"a": 1.0, "b": 0.0}, False),
        ("1 + 2", {}, False),
        ("(a > b) == (b > a)", {"a": 1.0, "b": 2.0}, False),
        ("-a < 0 and class != 3", {"a": 1.0, "class": 4.0}, True),
    ],
)
def test_rule_semantics(spark, text, values, expected):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    assert row.select(ex.rule_column(text)).first()[0] is expected


@pytest.mark.parametrize("text", ["(a > 1", "a < b < c", "a ** 2 > 1", "a // 2 > 1", "a = 1", "f(a) > 1", "1.2.3 > a", "a > 0x10", "a b", ""])
def test_malformed_rules(text):
    with pytest.raises(ex.RuleSyntaxError):
        ex.compile_rule(text)


def test_interpolation(spark):
    col = ex.interpolate_numbers("{a} and {b} {c}", {"a": F.lit(20.0), "b": F.lit(1.5)})
    assert spark.range(1).select(col).first()[0] == "20 and 1.5 {c}"


# ---- checklists


def test_capture_order_and_patterns():
    assert capture_order(r"((a)|(b))\(x") == [1, 3, 2]
    assert capture_order(r"(?:a)(b)[(](?P<n>c)") == [2, 1]
    assert java_pattern("(unclosed") is None
    assert "(?<n>c)" in java_pattern("(?P<n>c)")


def test_labels():
    assert labels_for("total_due", []) == ["total due", "importe por pagar", "total", "amount due"]
    assert labels_for("note", ["Note", "Remark", "REMARK"]) == ["note", "Remark"]


# ---- extraction


def test_first_acceptable_match_and_bad_pattern(spark):
    spec = Checklist.from_body("s", {"fields": {
        "amount": {"type": "number", "regex_hint": r"Amount:\s*([\d.]+)"}, "broken": {"type": "number", "regex_hint": "(("},
        "pick": {"type": "string", "regex_hint": r"(?:a=(\w+)|b=(\w+))"}}})
    rows = extraction.extract_regex(texts(spark, "Amount: . Amount: 7 Amount: 8\nb=two a=one"), spec).collect()
    assert [(r.field, r.value_num, r.value_str, r.block_id) for r in rows] == [("amount", 7.0, None, "b0"), ("pick", None, "two", "b1")]


def test_label_search_stops_at_first_label(spark):
    spec = Checklist.from_body("s", {"fields": {"total": {"type": "number"}, "city": {"type": "string", "aliases": ["Town"]}}})
    rows = extraction.extract_labels(texts(spark, "Subtotal 5\nTotal: 9\nTown = Lima\nCity: Cusco"), spec).collect()
    assert [(r.field, r.value_num, r.value_str) for r in rows] == [("total", 5.0, None), ("city", None, "Cusco")]


def test_emails(spark):
    spec = Checklist.from_body("s", {"fields": {"recipient_email": {"type": "string", "semantic_role": "recipient"}, "email": {"type": "string"}}})
    rows = extraction.extract_labels(texts(spark, "From a@b.io\nBill to: long.name@example.org"), spec).collect()
    assert [(r.field, r.value_str) for r in rows] == [("recipient_email", "long.name@example.org"), ("email", "a@b.io")]


def test_usd_amount_has_no_second_try(spark):
    df = spark.createDataFrame([("USD 1,250.50 of 7",), ("USD ,",), ("1,250",), ("x",)], "t string")
    from docaudit.functions.values import parse_number

    assert [r[0] for r in df.select(parse_number(F.col("t"))).collect()] == [1250.5, None, 1250.0, None]


# ---- mapping


def cands(spark, rows):
    """rows: (field, num, str, source, confidence, block_id, page)"""
    full = [(f, (n, s), src, c, None, b, p, "", None, None, None, None, None) for f, n, s, src, c, b, p in rows]
    return spark.createDataFrame([(1, full)], f"doc_id long, candidates {extraction.CANDIDATES_TYPE}")


def test_conflict_is_relative_to_the_first_reading(spark):
    df = cands(spark, [("a", 1.0, None, "regex", 0.9, "b1", 1), ("a", 1.0009, None, "regex", 0.9, "b2", 1), ("a", 1.0011, None, "regex", 0.9, "b3", 1)])
    spec = spec_column(Checklist.from_body("s", {"fields": {"a": {"type": "number"}, "b": {"type": "number"}}}))
    status = df.select(mapping.field_map(F.col("candidates"), spec["fields"])["status"]).first()[0]
    assert status == ["ambiguous", "missing"]


@pytest.mark.parametrize("strategy,winner", [("best_match", "b9"), ("first", "b2"), ("last", "b5"), ("highest_confidence", "b5"), ("any", "b2")])
def test_strategies(spark, strategy, winner):
    df = cands(spark, [("a", 1.0, None, "layout", 0.6, "b2", 1), ("a", 2.0, None, "regex", 0.5, "b9", 1), ("a", 3.0, None, "llm", 0.99, "b5", 2)])
    assert df.select(mapping.pick(F.col("candidates"), F.lit(strategy))["block_id"]).first()[0] == winner


def test_canonical_readings_agree(spark):
    df = cands(spark, [("issue_date", None, "el 17 de Marzo  de 2031", "regex", 0.85, "b1", 1), ("issue_date", None, "17 de marzo de 2031 x", "layout", 0.6, "b2", 1)])
    spec = spec_column(Checklist.from_body("s", {"fields": {"issue_date": {"type": "date"}}}))
    e = df.select(mapping.settled_map(F.col("candidates"), spec["fields"])[0].alias("e")).first().e
    assert (e.status, e.candidates[0].value.str) == ("found", "17 de marzo de 2031")


def test_dedupe_keeps_first_and_order(spark):
    df = cands(spark, [("b", None, "X", "regex", 0.9, "b1", 1), ("a", 2.0, None, "regex", 0.9, "b1", 1), ("b", None, " x ", "layout", 0.6, "b1", 1), ("a", 2.0, None, "layout", 0.6, "b2", 1)])
    got = df.select(mapping.deduped(F.col("candidates")).alias("c")).first().c
    assert [(c.field, c.source, c.block_id) for c in got] == [("b", "regex", "b1"), ("a", "regex", "b1"), ("a", "layout", "b2")]


def test_reviewer_rejection(spark):
    df = cands(spark, [("a", 1.0, None, "layout", 0.6, "b1", 1)]).withColumn("v", F.create_map(F.lit("a"), F.lit(False)))
    spec = spec_column(Checklist.from_body("s", {"fields": {"a": {"type": "number"}}}))
    status = let(mapping.field_map(F.col("candidates"), spec["fields"]), lambda m: mapping.judged(m, spec["fields"], F.col("v"), F.lit(True)))["status"]
    assert df.select(status).first()[0] == ["missing"]


# ---- blocks


def test_sections(spark):
    df = blocks(spark, [("intro", 1, 0, 0, 9, 9, 10.0), ("Big Title", 1, 0, 20, 9, 29, 16.0), ("body", 1, 0, 40, 9, 49, 10.0), ("TERMS", 1, 0, 60, 9, 69, 10.0), ("NOTE: x", 1, 0, 80, 9, 89, 20.0)])
    assert df.select(let(F.col("blocks"), sectioned)["section_label"]).first()[0] == [None, None, "Big Title", None, "TERMS"]


def test_layout_budget_is_per_page(spark):
    df = blocks(spark, [("a" * 50, 1, 0, 0, 9, 9), ("b" * 300, 1, 0, 20, 9, 29), ("c", 1, 0, 40, 9, 49), ("d", 2, 0, 0, 9, 9)])
    text = df.select(layout_text(F.col("blocks"), 120, 200)).first()[0]
    assert "a" * 50 in text and "\nd\n" in text and "bbb" not in text and "\nc\n" not in text


# ---- groups

ROWS = GroupSpec("t", "test results", (("parameter", "string"), ("measured_value", "number"), ("lower_bound", "number"), ("upper_bound", "number")), "table",
                 (RowRule("in_range", "measured_value >= lower_bound AND measured_value <= upper_bound", "{parameter} out of range"),))


def group(structure):
    return GroupSpec(ROWS.name, ROWS.section_hint, ROWS.row_fields, structure, ROWS.row_rules)


def parameters(df, spec):
    rows = df.select(let(F.col("blocks"), lambda b: groups.group_rows(b, spec)).alias("r")).first().r
    return [(r[0].str, r[1].num) for r in rows]


@pytest.mark.parametrize(
    "structure,text,expected",
    [
        ("table", "Test Results\nparameter | Measured Value | lower_bound | upper_bound\nDilution | 105 | 0 | 100", [("Dilution", 105.0)]),
        ("list", "Test Results\nDilution 105 0 100\nWater 50 0 100\n# note 1 2 3", [("Dilution", 105.0), ("Water", 50.0)]),
        ("list", "Lab sheet Test Results GoodRow 10 0 100 BadRow 200 0 100", [("GoodRow", 10.0), ("BadRow", 200.0)]),
    ],
)
def test_group_rows(spark, structure, text, expected):
    assert parameters(texts(spark, text), group(structure)) == expected


def test_box_rows(spark):
    df = blocks(spark, [("Test Results", 1, 50, 100, 150, 110), ("Dilution", 1, 50, 200, 100, 210), ("105", 1, 130, 201, 150, 210), ("0", 1, 200, 200, 210, 210), ("100", 1, 260, 199, 280, 210)])
    assert parameters(df, ROWS) == [("Dilution", 105.0)]


def test_paragraph_rows(spark):
    spec = GroupSpec("p", "samples", (("moisture", "number"), ("ash", "number")), "sections")
    docs = spark.createDataFrame([(1, "Samples\n\nMoisture: 12\nAsh: 0.1\n\nMoisture: 15\nAsh 0.2\n\nMoisture: 1")], "doc_id long, text string")
    df = docs.select(text_blocks(F.col("text"), "\f").alias("blocks"))
    rows = df.select(let(F.col("blocks"), lambda b: groups.group_rows(b, spec)).alias("r")).first().r
    assert [(r[0].num, r[1].num) for r in rows] == [(12.0, 0.1), (15.0, 0.2)]


def test_anchored_clustering(spark):
    df = blocks(spark, [(str(y), 1, 0, y, 5, y + 1) for y in (1, 4, 5, 7, 20)] + [("p2", 2, 0, 20, 5, 21)])
    rows = df.select(groups.baselines(F.col("blocks"), 4.0).alias("r")).first().r
    assert [[b.text for b in r] for r in rows] == [["1", "4", "5"], ["7"], ["20"], ["p2"]]


def test_group_outcomes(spark):
    spec = Checklist.from_body("g", {"version": "2", "fields": {}, "groups": {"t": {
        "section_hint": "Test Results", "structure_hint": "list", "row_fields": {n: {"type": t} for n, t in ROWS.row_fields},
        "row_rules": [{"id": "in_range", "expression": ROWS.row_rules[0].expression, "error_message": "{parameter} out of range"}]}}})
    df = texts(spark, "Test Results\nGood 10 0 100\nBad 200 0 100", "nothing here")
    rows = df.select("doc_id", F.inline(verdicts.group_outcomes(F.col("blocks"), spec))).collect()
    assert [(r.doc_id, r.field, r.rule, r.passed) for r in rows] == [(0, "t[0]", "in_range", True), (0, "t[1]", "in_range", False), (1, "t", "group_not_found", False)]
    assert rows[1].expected == "Bad out of range"


# ---- verdicts and history


@pytest.mark.parametrize(
    "status,evals,expected",
    [("PASS", ["pass", "ambiguous", "fail"], "AMBIGUOUS"), ("PASS", ["fail", "ambiguous"], "FAIL"), ("AMBIGUOUS", ["ambiguous", "fail"], "FAIL"), ("FAIL", ["ambiguous"], "FAIL"), ("PASS", [], "PASS")],
)
def test_open_ended_merge(spark, status, evals, expected):
    df = spark.createDataFrame([(status, evals)], "s string, e array<string>")
    assert df.select(verdicts.merge_evaluation(F.col("s"), F.col("e"))).first()[0] == expected


def test_lifecycle(spark):
    base = spark.sql("select id, timestamp'2024-01-01' archived_at, cast(null as timestamp) deleted_at from range(4)")
    events = spark.createDataFrame([(0, "restore", 1), (1, "delete", 1), (1, "restore", 2), (2, "delete", 5), (2, "unarchive", 4)], "id long, action string, seq long")
    out = runs.apply_lifecycle(base, events.withColumn("ts", F.timestamp_seconds(F.col("seq")))).orderBy("id").collect()
    assert [(r.archived_at is not None, r.deleted_at is not None) for r in out] == [(False, False), (False, False), (False, True), (True, False)]


def test_corrections_keep_group_failures(spark):
    spec = Checklist.from_body("s", {"fields": {"a": {"type": "number", "required": True, "max": 10}}})
    resolved = spark.createDataFrame([(1, "a", 50.0, None), (2, "a", 50.0, None), (3, "a", 50.0, None)], "run_id long, field string, value_num double, value_str string")
    fixes = spark.createDataFrame([(1, "a", "5"), (2, "a", "5"), (3, "a", "50")], "run_id long, field string, raw string")
    none = resolved.select("run_id", "field").limit(0)
    bad = spark.createDataFrame([(2, False), (1, True)], "run_id long, passed boolean")
    got = runs.apply_corrections(resolved, none, fixes, spec, group_outcomes=bad).collect()
    assert {r.run_id: r.status for r in got} == {1: "PASS", 2: "FAIL", 3: "FAIL"}


def test_cohort_aggregate(spark):
    df = spark.createDataFrame([("PASS",), ("PASS",), ("FAIL",), ("AMBIGUOUS",)], "outcome string")
    r = cohorts.aggregate_outcomes(df, 75.0).first()
    assert (r.total, r.pass_count, r.fail_count, r.ambiguous_count, r.pass_rate_pct, r.meets_threshold) == (4, 2, 1, 1, 50.0, False)
    assert cohorts.aggregate_outcomes(df.limit(2), 250.0).first().meets_threshold is True
    empty = cohorts.aggregate_outcomes(df.limit(0), 0.0).first()
    assert (empty.total, empty.pass_rate_pct, empty.meets_threshold) == (0, 0.0, False)


def test_tags(spark):
    df = spark.createDataFrame([('{"batch": " Q1 ", "fixture": null, " ": "x"}',), ('[{"key":"a","value":"1"},{"key":"a","value":""}]',), ("oops",)], "raw string")
    got = [r.attributes for r in cohorts.normalize_tags(df).collect()]
    assert got == [{"batch": "Q1", "fixture": None}, {"a": None}, {}]
    first = cohorts.normalize_tags(df).limit(1)
    for tags, want in [([("batch", "Q1")], True), ([("fixture", None)], True), ([("batch", "Q2")], False), ([("fixture", "x")], False)]:
        assert (cohorts.filter_cohort(first, cohorts.Cohort("c", tags=tuple(tags))).count() == 1) is want


# ---- evidence and views


def test_anchor(spark):
    df = blocks(spark, [("header", 1, 0, 0, 9, 9), ("Total  DUE: 12.50", 1, 0, 20, 9, 29), ("Total due", 1, 0, 40, 9, 49)])

    def at(cited, quote, val):
        return df.select(evidence.anchor_block(F.col("blocks"), F.lit(cited), F.lit(quote), F.lit(val))["block_id"]).first()[0]

    assert at("s0", "total due: 12.50", "12.5") == "s1"
    assert at("s2", "total due", "12.5") == "s2"
    assert at("s0", "absent text", "zz") == "s0"
    assert at("s9", "abc", "zz") is None


def test_highlight_merge_depends_on_order(spark):
    def h(i, w, kind, field="f"):
        return (f"h{i}", 1, 0.0, 0.0, float(w), 10.0, "", kind, field, None)

    df = spark.createDataFrame([(1, [h(0, 100, "candidate"), h(1, 104, "field"), h(2, 100, "error"), h(3, 99, "block"), h(4, 50, "block"), h(5, 10, "field", None)])], f"doc_id long, highlights array<{views.HIGHLIGHT_TYPE}>")
    assert [r.id for r in views.dedupe_highlights(df).collect()] == ["h4", "h5"]


# ---- sources and sinks


def test_replies(spark):
    df = spark.createDataFrame([('```json\n{"a": "1"}\n```',), ('{"a": "2"}',), ("nope",), ("",)], "reply string")
    assert [r.parsed.a for r in replies.parse_model_replies(df, "a string").collect()] == ["1", "2"]


def test_binary_uploads(spark, tmp_path):
    for name in ("a.pdf", "b.txt"):
        (tmp_path / name).write_bytes(b"same")
    files = uploads.read_uploads(spark, str(tmp_path))
    assert {os.path.basename(r.filename): r.n_bytes for r in files.collect()} == {"a.pdf": 4, "b.txt": 4}
    assert uploads.duplicate_uploads(files, "filename", "content").first().copies == 2


def test_exports(spark, tmp_path):
    df = spark.sql("select 1 id, 'p' project_id, 'a,\"b\".pdf' document_filename, 'k' schema_key, '1.0' version_label, 'PASS' outcome, timestamp'2024-01-02 03:04:05' created_at")
    assert sinks.csv_lines(sinks.history_table(df)).first().line == '"a,""b"".pdf",k,1.0,PASS,2024-01-02T03:04:05.000000Z,1'
    sinks.export_runs_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert (back.document_filename, back.run_id) == ('a,"b".pdf', "1")
    sinks.export_runs_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "summary")).first()["count"] == 1
    sinks.write_runs(df, str(tmp_path / "runs"))
    sinks.write_runs(df, str(tmp_path / "runs"))
    assert sinks.read_runs(spark, str(tmp_path / "runs")).filter("project_id = 'p'").count() == 2
    delimited.write_measurements(df.select("id", "outcome"), str(tmp_path / "m"))
    assert delimited.read_measurements(spark, str(tmp_path / "m"), "id long, outcome string").first().outcome == "PASS"
