"""Invented reports, end to end: bounds and duplicates, cross-field rules, tickets with patterns."""

import pytest
from pyspark.sql import functions as F

from docaudit.plans.checklist import Checklist
from docaudit.plans.validation import outcome_rows, validate_documents
from docaudit.sources.blocks import blocks_from_text

# A beekeeper's jar: every jar states its moisture, weight and shade.
JAR_FIELDS = {
    "moisture": {"type": "number", "required": True, "min": 14, "max": 20, "aliases": ["Water share", "Moisture reading"],
                 "regex_hint": r"(?i)^(?:moisture|water share)\s*:\s*([\d.]+)"},
    "net_weight": {"type": "number", "required": True, "min": 250, "max": 1000, "aliases": ["Net grams"],
                   "regex_hint": r"(?i)^net (?:weight|grams)\s*:\s*([\d.]+)"},
    "shade": {"type": "number", "required": False, "min": 1, "max": 9, "aliases": ["Colour step"]},
}
JAR = Checklist.from_body("jar", {"fields": JAR_FIELDS, "rules": ["required", "range_validation", "type_check"]})
CHATTER = ["Hive stood beside the lime avenue", "Lid torque checked twice", "Shelf 31, crate 6"]
HIGH, LOW = "range_validation", "range_validation"

# Expectations follow from the bounds above: name, lines, status, failed (field, rule), ambiguous fields.
JARS = [
    ("all three", ["Moisture: 17.2", "Net weight: 480", "Shade: 4"], "PASS", [], []),
    ("shade is optional", ["Moisture: 16.1", "Net weight: 510"], "PASS", [], []),
    ("on both edges", ["Moisture: 20", "Net weight: 250"], "PASS", [], []),
    ("other names", ["Water share: 15.5", "Net grams: 700", "Colour step: 2"], "PASS", [], []),
    ("too wet", ["Moisture: 23.9", "Net weight: 480"], "FAIL", [("moisture", HIGH)], []),
    ("too dry and too heavy", ["Moisture: 9.75", "Net weight: 1300"], "FAIL", [("moisture", LOW), ("net_weight", HIGH)], []),
    ("odd shade", ["Moisture: 18", "Net weight: 333", "Shade: 12"], "FAIL", [("shade", HIGH)], []),
    ("no weight", ["Moisture: 18.4"], "FAIL", [("net_weight", "required")], []),
    ("nothing", [], "FAIL", [("moisture", "required"), ("net_weight", "required")], []),
    ("two readings", ["Moisture: 15", "Moisture: 19", "Net weight: 480"], "AMBIGUOUS", [], ["moisture"]),
    ("two names, two readings", ["Net weight: 480", "Net grams: 515", "Moisture: 17"], "AMBIGUOUS", [], ["net_weight"]),
    ("said twice alike", ["Moisture: 17", "Water share: 17", "Net weight: 480"], "PASS", [], []),
]


def documents(spark, cases, title="JAR LABEL CHECK"):
    rows = [(n, "\n".join([title, *lines])) for n, lines in cases]
    return blocks_from_text(spark.createDataFrame(rows, "doc_id string, text string"))


def summary(results):
    failed = F.transform(F.filter("outcomes", lambda o: ~o["passed"]), lambda o: F.struct(o["field"], o["rule"]))
    ambiguous = F.filter("field_map", lambda e: e["status"] == "ambiguous")["field"]
    rows = results.select("doc_id", "status", failed.alias("failed"), ambiguous.alias("ambiguous")).collect()
    return {r.doc_id: (r.status, [tuple(x) for x in r.failed], sorted(r.ambiguous)) for r in rows}


@pytest.mark.parametrize("extra", [[], CHATTER], ids=["bare", "with chatter"])
def test_jars(spark, extra):
    docs = documents(spark, [(n, lines + extra) for n, lines, *_ in JARS])
    assert summary(validate_documents(docs, JAR)) == {n: (status, failed, amb) for n, _, status, failed, amb in JARS}


def test_partitions_do_not_matter(spark):
    docs = documents(spark, [(n, lines) for n, lines, *_ in JARS])
    assert summary(validate_documents(docs.repartition(5), JAR)) == summary(validate_documents(docs.coalesce(1), JAR))


def test_failures_point_at_their_line(spark):
    docs = documents(spark, [("wet", ["Net weight: 480", "Moisture: 23.9"])])
    row = outcome_rows(validate_documents(docs, JAR)).filter("not passed").first()
    assert row.evidence[0].evidence.text == "Moisture: 23.9"


def test_values_that_differ_late_are_two_values(spark):
    spec = Checklist.from_body("story", {"fields": {"motto": {"type": "string", "required": True, "regex_hint": r"(?i)motto:\s*(.+)"}}})
    long = "bees " * 150
    docs = documents(spark, [("late", [f"Motto: {long}hum", f"Motto: {long}buzz"])])
    assert summary(validate_documents(docs, spec))["late"] == ("AMBIGUOUS", [], ["motto"])


def test_cross_field_rules(spark):
    spec = Checklist.from_body("crate", {
        "version": "2",
        "fields": JAR_FIELDS | {"jars_packed": {"type": "number"}, "jars_broken": {"type": "number"}},
        "cross_field_rules": [
            {"id": "wet_jars_are_small", "expression": "moisture < 19 OR net_weight <= 400", "fields": ["moisture", "net_weight"],
             "error_message": "{net_weight} g at {moisture} percent"},
            {"id": "broken_are_packed", "expression": "jars_broken <= jars_packed"},
        ],
    })
    docs = documents(spark, [
        ("fine", ["Moisture: 19.5", "Net weight: 380"]), ("large and wet", ["Moisture: 19.5", "Net weight: 900"]),
        ("miscounted", ["Moisture: 15", "Net weight: 900", "Jars packed: 12", "Jars broken: 13"]),
    ])
    results = validate_documents(docs, spec)
    got = summary(results)
    assert got["fine"] == ("PASS", [], [])
    assert got["large and wet"] == ("FAIL", [("moisture", "wet_jars_are_small")], [])
    assert got["miscounted"] == ("FAIL", [("jars_broken", "broken_are_packed")], [])
    row = outcome_rows(results).filter("doc_id = 'large and wet' and not passed").first()
    assert row.expected == "900 g at 19.5 percent"
    assert [e.field for e in row.evidence] == ["moisture", "net_weight"]


# A ferry ticket: patterns give the code and the fare, whatever their case.
TICKET = Checklist.from_body("ticket", {
    "version": "3",
    "fields": {
        "sailing_code": {"type": "string", "required": True, "regex_hint": r"(?i)sailing\s+(?:code|kód)\s*[:#]\s*([A-Z]{2}\d+)"},
        "fare": {"type": "number", "required": True, "min": 1, "max": 90, "regex_hint": r"(?i)fare\s+paid\s*:\s*([\d.]+)"},
    },
    "cross_field_rules": [{"id": "flat_fare", "expression": "fare == 35", "fields": ["fare"]}],
})


def test_tickets(spark):
    docs = documents(spark, [
        ("plain", ["Sailing code: QK771", "Fare paid: 35.0"]), ("shouted", ["SAILING KÓD # QK8", "FARE PAID: 35"]),
        ("dear", ["Sailing code: QK772", "Fare paid: 61"]), ("no code", ["Fare paid: 35"]),
    ], title="FERRY TICKET")
    got = summary(validate_documents(docs, TICKET))
    assert got["plain"] == got["shouted"] == ("PASS", [], [])
    assert got["dear"] == ("FAIL", [("fare", "flat_fare")], [])
    assert got["no code"] == ("FAIL", [("sailing_code", "required")], [])
