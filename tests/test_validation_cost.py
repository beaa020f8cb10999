"""Work of a validated document: nothing is evaluated twice, and short cuts give what the long way gives."""

import re

from pyspark.sql import functions as F

from docaudit.functions.arrays import distinct_by
from docaudit.functions.text import LINE_ENDS, WHITESPACE, let, lines, strip, trimmed, words
from docaudit.functions.values import dedupe_key, value
from docaudit.operators import extraction, groups, mapping
from docaudit.operators.blocks import section_blob
from docaudit.plans import datasets as d
from docaudit.plans.checklist import KNOWN_FIELDS, Checklist, known_fields, needle, spec_column
from docaudit.plans.validation import validate_documents
from docaudit.queries import load
from docaudit.sources.blocks import blocks_from_text
from docaudit.sources.sinks import read_runs, write_runs

SF_DIR = "/root/testdata/sf0.001"


def fields():
    return spec_column(d.ORDER_CHECKLIST)["fields"]


def logical(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def documents(spark, *texts):
    return blocks_from_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_label_patterns_are_tried_once(spark):
    found = let(F.col("blocks"), lambda b: let(fields(), lambda fs: extraction.schema_labels(b, fs)))
    # Marked and plain form, number with and without currency for each, and two kinds of address.
    assert logical(documents(spark, "a").select(found.alias("x"))).count("regexp_extract(") <= 8


def test_a_reading_has_one_canonical_form(spark):
    docs = documents(spark, "a").select(extraction.no_candidates().alias("cs"), "text")
    docs = docs.withColumn("cs", F.when(F.col("text") != "", F.col("cs")))
    plan = logical(docs.select(let(F.col("cs"), lambda c: let(fields(), lambda fs: mapping.settled_map(c, fs))).alias("x")))
    assert plan.count("translate(") <= 4


def test_cells_are_read_once(spark):
    rows = let(F.col("blocks"), lambda b: groups.group_rows(b, d.ORDER_CHECKLIST.groups[0]))
    assert logical(documents(spark, "a").select(rows.alias("x"))).count("try_cast(") <= 4


def test_trimmed_is_strip(spark):
    ends = [*WHITESPACE, "", "a", "~", "!", "\x7f", "é", "\U0001f600", "\x00"]
    texts = [a + b + c for a in ends for b in ("", "x", "x y") for c in ends] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.transform(F.array("t"), trimmed)[0].alias("a"), strip("t").alias("b"))
    assert rows.count() == len(texts) and rows.filter("not a <=> b").count() == 0


def test_needles():
    assert needle(r"(?i)order\s*number:\s*(\d+)") == "number:"
    assert [needle(p) for p in ("a|b", "(abc)+", "[a-z]+", "(?x) a b", "", "(?i)KISS", "x?")] == [""] * 7
    assert needle("foo{2}bar") == "bar" and needle("ab(?=c)cde") == "cde"


def test_patterns_fold_case_beyond_ascii(spark):
    """Letters that match only when case is ignored the Unicode way are still found, as are patterns without a needle."""
    spec = Checklist.from_body("odd", {"fields": {
        "mask": {"type": "number", "regex_hint": r"(?i)mask:\s*(\d+)"}, "either": {"type": "number", "regex_hint": r"(?:left|right) (\d+)"},
        "upper": {"type": "string", "regex_hint": r"CODE ([A-Z]+)"}}})
    docs = documents(spark, "MAſK: 5", "right 7\nCODE XY", "code XY\nnothing", "")
    rows = extraction.extract_regex(docs, spec).select("doc_id", "field", F.coalesce(F.col("value_num").cast("string"), "value_str")).collect()
    assert sorted(map(tuple, rows)) == [(0, "mask", "5.0"), (1, "either", "7.0"), (1, "upper", "XY")]


def test_section_headers_and_endless_numbers(spark):
    docs = documents(spark, "  ORDER ITEMS \n1 2 3.00 0.1\nOrder Items", "Order number: " + "9" * 400)
    rows = groups.rows_table(docs, d.ORDER_CHECKLIST.groups[0]).select("doc_id", "field", "num").collect()
    assert [tuple(r) for r in rows] == [(0, "line", 1.0), (0, "qty", 2.0), (0, "price", 3.0), (0, "discount", 0.1)]
    # A number beyond the range of doubles equals nothing, itself included.
    status = {r[0]: r[1] for r in validate_documents(docs, d.ORDER_CHECKLIST).select("doc_id", "status").collect()}
    assert status[1] == "AMBIGUOUS"


def test_documents_of_many_labels_are_dealt_out(spark):
    """a part file is one or a few splits, which gave as few tasks."""
    df = load()[0]["ext06b_extract_many_labels"](spark, SF_DIR)
    assert "Exchange hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_policies_read_the_documents_once(spark):
    """a filter on the result, pushed below its projection, read every document a second time."""
    once = logical(d.order_reports(spark, SF_DIR).select(let(F.col("blocks"), lambda b: let(fields(), lambda fs: extraction.ensemble(b, fs, False))).alias("x")))
    assert logical(load()[0]["map09_apply_policies"](spark, SF_DIR)).count("regexp_extract_all(") == once.count("regexp_extract_all(")


def test_patterns_of_a_known_checklist_belong_to_the_plan(spark):
    """as values of the row, the patterns of all fields were compiled again for every document."""
    plan = logical(validate_documents(documents(spark, "a"), d.ORDER_CHECKLIST, measurements=False).select("candidates"))
    assert not re.search(r"regexp_extract_all\([^()]*, lambda \w+#\d+\.regex\b", plan)
    many = Checklist.from_body("many", {"fields": {f"f{i}": {"type": "number", "regex_hint": rf"f{i}: (\d+)"} for i in range(KNOWN_FIELDS + 1)}})
    few = Checklist.from_body("few", {"fields": {f"f{i}": many.body["fields"][f"f{i}"] for i in range(3)} | {"note": {"type": "string", "regex_hint": "note .*"}, "due": {"type": "date"}}})
    assert known_fields(many) is None and len(known_fields(few)) == 5
    docs = documents(spark, "f0: 1\nf1: 2 f1: 3\nnote x\nDue: 5 de mayo de 2031", "f2: z\nnone", "")
    fs = spec_column(few)["fields"]
    rows = docs.select(*[let(F.col("blocks"), lambda b, x=x: extraction.schema_regex(b, x)).alias(n) for n, x in (("a", fs), ("b", known_fields(few)))]).collect()
    assert all(r.a == r.b for r in rows) and [len(r.a) for r in rows] == [4, 0, 0]


def test_trimming_copies_no_text(spark):
    """``ascii`` copies the text, and ``between`` did it twice at either end."""
    assert "ascii(" not in logical(spark.createDataFrame([("a",)], "t string").select(trimmed(F.col("t")).alias("x")))


def test_the_section_header_is_sought_once(spark):
    """the position was evaluated in the condition and again in the cut."""
    blob = let(F.col("blocks"), lambda b: section_blob(b, "rows"))
    docs = documents(spark, "a\nMy\tRows\nx\nrows\ny", "the rows of a long line\nz", "a")
    assert logical(docs.select(blob.alias("x"))).count("length(") <= 2
    assert [r[0] for r in docs.select(blob).collect()] == ["My\tRows\nx\nrows\ny", "the rows of a long line", ""]


def test_words_and_lines_of_unusual_texts(spark):
    texts = ["", "a b", " a  b ", "a\tb", "a b\x1cc", "é è", "a\x7fb", "a\r\nb", "a\rb\n", "a b\x0bc", "\n", "\r\n\r\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", words(F.col("t")).alias("w"), lines(F.col("t")).alias("l")).collect()
    for r in rows:
        want = None if r.t is None else re.split("|".join(map(re.escape, ["\r\n", *LINE_ENDS])), r.t)
        assert r.l == want and r.w == (None if r.t is None else [w for w in re.split(f"[{WHITESPACE}]", r.t) if w]), r


def test_first_of_equal_readings_stays(spark):
    """Whole numbers are not rounded for their key; a negative zero is a zero."""
    v = lambda n: value(F.lit(n))
    keys = spark.range(1).select(*[dedupe_key(F.lit("f"), v(n)).alias(str(i)) for i, n in enumerate((0.0, -0.0, 3.0, 0.1234564, 0.1234561, 1e300))]).first()
    assert list(keys) == ["n:0.0", "n:0.0", "n:3.0", "n:0.123456", "n:0.123456", "n:1.0E300"]
    got = spark.range(1).select(distinct_by(F.array(*map(F.lit, ["b", "A", "a", "B", "c"])), F.lower)).first()[0]
    assert got == ["b", "A", "c"]


def test_stored_runs_are_packed(spark, tmp_path):
    """the default codec took half as much again."""
    rows = [(1, "a", ["x"]), (2, "b", None)]
    write_runs(spark.createDataFrame(rows, "id int, project_id string, texts array<string>"), f"{tmp_path}/runs")
    files = list(tmp_path.rglob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)
    assert sorted(map(tuple, read_runs(spark, f"{tmp_path}/runs").select("id", "project_id", "texts").collect())) == rows
