"""Small cases that once went wrong."""

import pytest
from pyspark.sql import functions as F

from docaudit.operators import checklists, cohorts, verdicts, views
from docaudit.operators.runs import page_runs
from docaudit.plans.checklist import Checklist, FieldSpec, java_pattern, rejected_patterns
from docaudit.plans.normalise import normalised_body
from docaudit.plans.validation import validate_documents
from docaudit.sources.blocks import blocks_from_text


def readings(spark, text, **patterns):
    spec = Checklist.from_body("p", {"fields": {k: {"type": "string", "regex_hint": p} for k, p in patterns.items()}})
    docs = blocks_from_text(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    rows = validate_documents(docs, spec).select(F.inline("candidates")).select("field", "value.str").collect()
    return rejected_patterns(spec), sorted((r[0], r[1]) for r in rows)


def test_patterns_of_the_jvm_and_optional_groups(spark):
    bad, got = readings(spark, "KEY12\nKEY7-3\nL: \n[4", optional=r"KEY\d+(?:-(\d+))?", empty_one=r"L:(\d*)", bracket=r"[[]\d{,2}", broken="(*x", behind=r"(?<=a+)b")
    assert [f for f, _ in bad] == ["broken", "behind"]
    assert got == [("bracket", "[4"), ("optional", "3"), ("optional", "KEY12")]


@pytest.mark.parametrize(("pattern", "want"), [(r"a{,3}", r"a{0,3}"), (r"\{,3}", r"\{,3}"), (r"[[a]", r"[\[a]"), (r"[]x]", r"[\]x]"), (r"[^]]", r"[^\]]"), (r"(?P<n>a)(?P=n)", r"(?<n>a)\k<n>")])
def test_patterns_are_spelt_out(pattern, want):
    assert java_pattern(pattern) == "(?Ud)" + want


@pytest.mark.parametrize(("raw", "want"), [('{"a":"1","a":"2"}', {"a": "2"}), ('[{"key":"x","value":" 1 "},7,{"key":"y"}]', {"x": "1", "y": None}), ("[3]", {}), ("{", {}), ('{" ":"1"}', {})])
def test_tags(spark, raw, want):
    assert cohorts.normalize_tags(spark.createDataFrame([(raw,)], "raw string")).first()["attributes"] == want


def test_documents_without_a_checklist_keep_their_row(spark):
    spec = Checklist.from_body("known", {"fields": {"n": {"type": "number", "aliases": ["N"]}}})
    docs = blocks_from_text(spark.createDataFrame([(1, "N: 4", "known"), (2, "N: 4", "other"), (3, "N: 4", None)], "doc_id int, text string, spec_id string"))
    got = {r.doc_id: r.status for r in validate_documents(docs, [spec]).select("doc_id", "status").collect()}
    assert got == {1: "PASS", 2: "UNKNOWN_CHECKLIST", 3: "UNKNOWN_CHECKLIST"}


def test_fields_without_a_reply_are_ambiguous(spark):
    spec = Checklist.from_body("o", {"version": "3", "fields": {}, "open_ended": {n: {"extract_prompt": "x", "evaluate_prompt": "y"} for n in ("one", "two")}})
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    replies = spark.createDataFrame([(1, "one", "pass")], "doc_id int, field string, evaluation string")
    rows = verdicts.normalize_evaluations(replies, spec, documents=docs).collect()
    assert sorted((r.doc_id, r.field, r.evaluation) for r in rows) == [(1, "one", "pass"), (1, "two", "ambiguous"), (2, "one", "ambiguous"), (2, "two", "ambiguous")]


def test_lint_of_broken_bodies(spark):
    bodies = ['{"fields": ', '{"fields": ["a"], "groups": 3}', '{"version": "3", "open_ended": ["a"]}', "[1]", None]
    rows = checklists.lint_specs(spark.createDataFrame(list(enumerate(bodies)), "spec_id int, body string")).collect()
    assert sorted((r.spec_id, r.code) for r in rows) == [(0, "body_not_object"), (1, "fields_not_object"), (2, "open_ended_not_object"), (3, "body_not_object"), (4, "body_not_object")]


def test_bounds_are_whole():
    assert views.expected_text(FieldSpec("f", "number", min=0.25, max=12345678)) == "number · optional · 0.25 – 12345678"


def test_pages_after_a_row_go_on_where_it_ended(spark):
    runs = spark.range(40).select("id", F.timestamp_seconds(F.col("id") % 7).alias("created_at"))
    first = page_runs(runs, 1, 15).collect()
    second = [r.id for r in page_runs(runs, 1, 15, after=(first[-1].created_at, first[-1].id)).collect()]
    assert second == [r.id for r in page_runs(runs, 2, 15).collect()] and len(first) == 15


def test_bodies_are_normalised_before_a_run():
    body = normalised_body({
        "fields": {"amount_due": {"type": "number"}, "code": {"type": "string", "rules": [{"rule_name": "equals", "value": "a.b"}]}, "story": {"type": "open_ended", "description": "Tell it"}},
        "cross_field_rules": [{"id": "r", "expression": "amount_due > my_amount_due", "fields": ["amount_due"]}],
        "open_ended": {"mood": {}},
    })
    assert body["version"] == "3" and body["rules"] == ["required", "range_validation", "type_check"]
    assert set(body["fields"]) == {"total_due", "code"} and body["fields"]["total_due"]["aliases"] and body["fields"]["code"]["regex_hint"] == r"(?i)a\.b"
    assert body["cross_field_rules"][0] == {"id": "r", "expression": "total_due > my_amount_due", "fields": ["total_due"]}
    assert body["open_ended"]["story"]["extract_prompt"] == "Tell it" and body["open_ended"]["mood"]["extract_prompt"] == "Extract the mood from the document."
