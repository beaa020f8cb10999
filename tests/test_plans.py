"""Plans: what must not appear in them."""

from docaudit.plans import datasets as d
from docaudit.plans.validation import validate_documents
from docaudit.queries import load
from docaudit.sources.blocks import blocks_from_text

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_validation_is_free_of_shuffles(spark):
    docs = blocks_from_text(d.table(spark, SF_DIR, "documents").select("doc_id", "text"))
    text = plan(validate_documents(docs, d.ORDER_CHECKLIST).select("doc_id", "status"))
    assert "Exchange" not in text and "Python" not in text


def test_scan_reads_needed_columns_only(spark):
    text = plan(load()[0]["coh04_aggregate_outcomes"](spark, SF_DIR))
    assert "o_totalprice" not in text and "c_acctbal" not in text


def test_no_nested_loops_in_joins(spark):
    queries = load()[0]
    for name in ("map02_map_candidates", "map14_anchor_evidence", "coh06_evaluate_cohorts", "spc03_bind_specs", "run07_apply_corrections"):
        text = plan(queries[name](spark, SF_DIR))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_exchanges_of_history_operators(spark):
    queries = load()[0]
    for name, most in (("run07_apply_corrections", 1), ("coh07_tag_vocabulary", 3), ("coh08_merge_vocabularies", 4)):
        text = plan(queries[name](spark, SF_DIR))
        assert text.count("Exchange hashpartitioning") <= most, (name, text.count("Exchange hashpartitioning"))
