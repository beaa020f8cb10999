"""Cases of the third round's findings."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from docaudit.llm import lines
from docaudit.operators import views
from docaudit.plans import datasets as d
from docaudit.plans.validation import validate_documents
from docaudit.queries import load, sources
from docaudit.sources import sinks
from docaudit.sources.blocks import blocks_from_text

from .llm.helpers import documents, sentence

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_json_is_built_in_the_row(spark, monkeypatch):
    """The export neither validates a second time nor shuffles field rows back together."""
    seen = []
    write = sinks.export_run_json
    monkeypatch.setattr(sources.sinks, "export_run_json", lambda lines, path: (seen.append(plan(lines)), write(lines, path)))
    load()[0]["snk05b_export_run_json"](spark, SF_DIR)
    # Two exchanges bring orders and line items together, no more.
    assert seen[0].count("Exchange hashpartitioning") == 2


def test_run_json_lists_every_declared_field(spark):
    docs = blocks_from_text(spark.createDataFrame([(1, "Order number: 7\nTotal due: 5.00\nTotal due: 6.00"), (2, "")], "doc_id long, text string"))
    results = validate_documents(docs, d.ORDER_CHECKLIST, measurements=False)
    rows = sinks.run_json(results, views.field_row_array(d.ORDER_CHECKLIST))
    body = F.from_json("line", "fields array<struct<field:string,status:string,extracted:string>>")
    got = {r[0]: [tuple(f) for f in r[1]["fields"]] for r in rows.select("run_id", body.alias("b")).collect()}
    assert [f for f, *_ in got[1]] == [f for f, *_ in got[2]] == ["item_count", "order_number", "status", "total_due"]
    assert ("total_due", "Ambiguous", "5 | 6") in got[1] and {s for _, s, _ in got[2]} <= {"Not found", "Rule failed"}


def test_long_lists_give_the_pairs_of_short_ones(spark, monkeypatch):
    """Candidate pairs of long lines are all that share a key and enough minima, whether or not lists are dealt to blocks."""
    rng = random.Random(31)
    base = [sentence(rng, "en", 30) for _ in range(3)]
    texts = [sentence(rng, "de", 30) for _ in range(20)]
    for _ in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = "new"
        texts.append(" ".join(words))
    data = [(i, t, None, None, None) for i, t in enumerate(dict.fromkeys(texts))]
    docs = documents(spark, data).select(F.col("doc_id").alias("key"), "text")
    table = lines.line_table(docs, "key", "text").withColumn("id", F.shiftleft(F.xxhash64("line"), 1)).localCheckpoint()
    monkeypatch.setattr(lines, "TRIED", 1)
    found = []
    for long_list, block in ((512, 256), (4, 3), (2, 2)):
        monkeypatch.setattr(lines, "LONG_LIST", long_list)
        monkeypatch.setattr(lines, "BLOCK_LINES", block)
        rows = [tuple(r) for r in lines.long_pairs(table).collect()]
        assert len(rows) == len(set(rows))
        found.append(set(rows))
    holders, minima = {}, {}
    for key, trait, i in lines.long_keys(table).collect():
        holders.setdefault(key, set()).add(i)
        minima[i] = trait.to_bytes(8, "little", signed=True)
    near = lambda a, b: sum(x == y for x, y in zip(minima[a], minima[b], strict=True)) >= lines.SHARED
    want = {(min(p), max(p)) for ids in holders.values() for p in combinations(ids, 2) if near(*p)}
    assert len(want) > 300 and found == [want] * 3
