"""Catalogues as data: rules and groups of the row against those built into a plan, bindings, cohorts, labels."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docaudit.functions.expressions import PROGRAM_TYPE, RuleSyntaxError, compile_rule, rule_program, run_program
from docaudit.operators import checklists, cohorts, evidence, labels
from docaudit.plans import datasets as d
from docaudit.plans.catalogue import compiled
from docaudit.plans.checklist import Checklist
from docaudit.plans.validation import validate_documents
from docaudit.sources.blocks import blocks_from_text

from .test_plans import plan

RULES = [
    "a > b", "a / b >= 2", "NOT a == 3 AND b < 4", "a / b > 1 OR a > 0", "-a + 2 * (b - 1) <= 4", "(a > b) == 1", "a + b", "a != b OR NOT b >= a",
    "+a == a", "a == b / 0", "1 < 2",
]


def test_programs_agree_with_columns(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(-3, 5)), float(rng.choice([0, 1, 2, 5]))) for _ in range(30)]
    df = spark.createDataFrame(rows, "a double, b double")
    for text in RULES:
        steps = F.from_json(F.lit(json.dumps(rule_program(text)[1])), PROGRAM_TYPE)
        mine = run_program(steps, lambda n: F.when(n == "a", F.col("a")).otherwise(F.col("b")))
        got = df.select(mine.alias("x"), compile_rule(text).column(F.col).alias("y")).collect()
        assert all(r.x == r.y for r in got), text
    with pytest.raises(RuleSyntaxError):
        rule_program("a >")


BODIES = {
    "table": {"structure_hint": "table"}, "list": {"structure_hint": "list"}, "sections": {"structure_hint": "sections"}, "other": {"structure_hint": "plain"},
}
TEXTS = [
    "SHEET\nn: 4\nm: 2\nMy Rows\nname qty\nx 3\ny 0\nz q\n", "n: 4\nMy Rows: x 3 y 4 z 5", "m: 0\nn: 1\nmy rows\nname: x\nqty: 7\n\nname: y\nqty: 1\n",
    "n: 9\nm: 3\nMy rows\n| x | 3 |\n| y | 2 |\n# no 1", "nothing here", "", "My Rows\n\n", "n: one\nm: 2\nn: 5",
]


def body_of(kind):
    body = {
        "version": "2",
        "fields": {"n": {"type": "number", "required": True, "min": 2}, "m": {"type": "number"}},
        "cross_field_rules": [
            {"id": "more", "expression": "n > m", "error_message": "{n} of {m} {x}"}, {"id": "part", "expression": "n / m >= 2", "fields": ["m", "n"]},
            {"id": "bad", "expression": "n >"}, {"id": "strange", "expression": "n > q"}, {"id": "misuse", "expression": "(n > m) + 1 > 0"},
        ],
        "groups": {"rows": {"section_hint": "My Rows", **BODIES[kind], "row_fields": {"name": {"type": "string"}, "qty": {"type": "number"}}, "row_rules": [
            {"id": "some", "expression": "qty >= 1", "error_message": "{name} has {qty}"}, {"id": "broken", "expression": "qty >>"}, {"id": "else", "expression": "zzz > 1"}]}},
    }
    # One checklist that a document can pass.
    return body if kind != "other" else {"version": "2", "fields": body["fields"], "cross_field_rules": body["cross_field_rules"][:2]}


def test_catalogue_agrees_with_plans_of_single_checklists(spark):
    docs = blocks_from_text(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string"))
    bodies = {k: body_of(k) for k in BODIES}
    rows = [(k, json.dumps(b)) for k, b in bodies.items()] + [("list", None), ("no object", "[1]"), ("broken", "{"), (None, "{}")]
    catalogue = compiled(spark.createDataFrame(rows, "spec_id string, body string"), normalise=False)
    everything = docs.withColumn("spec_id", F.explode(F.array(*map(F.lit, [*bodies, "no object", "absent"]))))
    shown = lambda df, *keys: {tuple(r[k] for k in keys): r for r in df.select(*keys, "status", "outcomes").collect()}
    got = shown(validate_documents(everything, catalogue, keep=("doc_id", "spec_id")), "doc_id", "spec_id")
    for kind, body in bodies.items():
        want = shown(validate_documents(docs, Checklist.from_body(kind, body), normalise=False), "doc_id")
        for i in range(len(TEXTS)):
            assert (got[i, kind].status, got[i, kind].outcomes) == (want[i,].status, want[i,].outcomes), (kind, i)
    assert {got[i, k].status for i in range(len(TEXTS)) for k in ("no object", "absent")} == {"UNKNOWN_CHECKLIST"}
    assert len({r.status for r in got.values()}) >= 3


def test_plan_does_not_grow_with_the_catalogue(spark):
    docs = blocks_from_text(spark.createDataFrame([(1, "n: 4", "s0")], "doc_id int, text string, spec_id string"))

    def size(n):
        rows = [(f"s{i}", json.dumps(body_of("list"))) for i in range(n)]
        return len(plan(validate_documents(docs, compiled(spark.createDataFrame(rows, "spec_id string, body string")))))

    assert size(200) < 1.05 * size(2)


def test_patterns_that_the_jvm_rejects_are_left_out(spark):
    body = {"fields": {"a": {"type": "string", "regex_hint": r"(?<=x+)y"}, "b": {"type": "string", "regex_hint": r"k(\d)"}}}
    found = compiled(spark.createDataFrame([("s", json.dumps(body))], "spec_id string, body string"), normalise=False)
    assert {r["name"]: r["regex"] is not None for r in found.select(F.inline("spec.fields")).collect()} == {"a": False, "b": True}


@pytest.mark.parametrize("salts", [1, 3])
def test_as_of_binding_with_ties_gaps_and_hand_over(spark, salts):
    rng = random.Random(7)
    at = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    versions = sorted({(rng.choice("pq"), rng.randint(0, 400)) for _ in range(40)})
    rows = [(i, p, "k", at(h), at(h + 5) if i % 4 == 0 else None, at(h + 9) if i % 6 == 0 else None) for i, (p, h) in enumerate(versions)]
    timeline = spark.createDataFrame(rows, "id long, project_id string, schema_key string, active_from string, archived_at string, deleted_at string")
    timeline = timeline.withColumns({c: F.to_timestamp(c) for c in ("active_from", "archived_at", "deleted_at")})
    docs = [(i, rng.choice("pqr"), rng.choice(["k", "k", "z"]), rng.randint(0, 420)) for i in range(300)] + [(900, None, "k", 5), (901, "p", "k", None)]
    frame = spark.createDataFrame([(i, p, k, None if h is None else at(h), "x") for i, p, k, h in docs], "doc_id int, project_id string, schema_key string, t string, _version string")
    frame = frame.withColumn("uploaded_at", F.to_timestamp("t"))
    out = checklists.bind_as_of(frame, timeline, salts=salts)
    assert out.columns == ["doc_id", "project_id", "schema_key", "t", "_version", "uploaded_at", "spec_id", "reason"]
    got = {r.doc_id: (r.spec_id, r.reason) for r in out.collect()}
    assert len(got) == len(docs)
    for i, p, k, h in docs:
        known = [(v[1], j) for j, v in enumerate(versions) if v[0] == p and k == "k" and h is not None and v[1] <= h]
        if not known:
            want = (None, "unknown_checklist")
        else:
            since, j = max(known)
            ends = [since + 5] * (j % 4 == 0) + [since + 9] * (j % 6 == 0)
            want = (None, "inactive_checklist") if ends and min(ends) <= h else (j, None)
        assert got[i] == want, (i, p, k, h)


@pytest.mark.parametrize("counts", [1, 4_096])
def test_cohorts_against_plain_filters(spark, monkeypatch, counts):
    monkeypatch.setattr(cohorts, "ENTRY_COUNTS", counts)
    rng = random.Random(9)
    tags = lambda: {k: v for k, v in (("a", rng.choice(["1", "2", None])), ("b", rng.choice(["x", " y"])), ("c", str(rng.random()))) if rng.random() < 0.7}
    runs = [(i, "big" if i % 2 else rng.choice(["p", None]), rng.choice(["k1", "k2", "", None]), rng.choice(["1", "2"]), rng.choice(["PASS", "FAIL", "AMBIGUOUS"]), tags() if i % 9 else None) for i in range(400)]
    saved = []
    for i in range(60):
        asked = [(k, v) for k, v in (("a", rng.choice(["1", None])), (" b ", rng.choice(["x", "y", None])), ("", "z"), ("d", None)) if rng.random() < 0.4]
        saved.append((f"c{i}", rng.choice(["big", "p", "none"]), rng.choice(["k1", " ", "", None]), rng.choice(["1", "", None]), rng.choice([[], ["PASS"], ["PASS", "FAIL"]]), asked, 50.0))
    run_df = spark.createDataFrame(runs, "id int, project_id string, schema_key string, version_label string, outcome string, attributes map<string,string>")
    cohort_df = spark.createDataFrame(saved, "id string, project_id string, schema_key string, version_label string, outcomes array<string>, tags array<struct<key:string,value:string>>, threshold double")
    out = cohorts.evaluate_cohorts(run_df, cohort_df)
    got = {r.cohort_id: (r.total, r.pass_count, r.fail_count) for r in out.collect()}
    for cid, project, key, version, outcomes, asked, _ in saved:
        def holds(r):
            own = r[5] or {}
            return (
                r[1] == project and (not (key or "").strip() or r[2] == key.strip()) and (not (version or "").strip() or r[3] == version.strip())
                and (not outcomes or r[4] in outcomes)
                and all(not k.strip() or (k.strip() in own and (v is None or own[k.strip()] == v.strip())) for k, v in asked)
            )

        hit = [r[4] for r in runs if holds(r)]
        assert got[cid] == (len(hit), hit.count("PASS"), hit.count("FAIL")), cid
    text = plan(out)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_label_places():
    automaton = labels.label_automaton(["no", "invoice no", "total", ""])
    assert labels.places_of(["invoice no 3", "nothing", "a total: no", "x"], automaton) == {"no": [0, 1, 2], "invoice no": [0], "total": [2]}
    assert labels.places_of(["a"], labels.label_automaton([])) == {}


def test_labels_by_automaton_agree_with_the_search(spark):
    docs = d.order_reports(spark, "/root/testdata/sf0.001").limit(200)
    names = [lb["label"] for f in d.ORDER_CHECKLIST.fields for lb in f.as_row()["labels"]]
    placed = labels.label_places(docs, names)
    got = validate_documents(placed, d.ORDER_CHECKLIST, label_places="label_places").select("doc_id", "status", "candidates")
    want = validate_documents(docs, d.ORDER_CHECKLIST).select("doc_id", "status", "candidates")
    assert sorted(got.collect()) == sorted(want.collect())


def test_first_block_with_a_needle(spark):
    rows = [("b\nab\nabc", "abc", 2), ("b\nab\nabc", "ab", 1), ("b", "x", None), ("é\nü", "ü", 1), ("", "a", None), ("a", "a", 0)]
    df = spark.createDataFrame(rows, "hay string, n string, want int")
    assert all(r.got == r.want for r in df.select("want", evidence.block_with(F.col("hay"), F.col("n")).alias("got")).collect())
