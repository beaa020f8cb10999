"""Cases of the fourth round's findings."""

import os
import random

import numpy as np
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from docaudit.llm import common, lines
from docaudit.operators import blocks as ops
from docaudit.plans import datasets as d
from docaudit.plans.validation import validate_documents
from docaudit.queries import load
from docaudit.sources import sinks
from docaudit.sources.blocks import blocks_from_text

from .llm.helpers import documents, sentence

SF_DIR = "/root/testdata/sf0.001"


def odd_documents(spark, path):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "one line\n\nand one more")]
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in rows], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{path}/documents.parquet")
    return f"{path}"


def test_documents_without_text_keep_their_row(spark, tmp_path):
    """A text that is NULL fares like an empty one: no characters, sparse, an empty head."""
    sf = odd_documents(spark, tmp_path)
    got = {n: {r[0]: tuple(r)[1:] for r in load()[0][n](spark, sf).collect()} for n in ("blk03_sparse_documents", "blk05_serialize_index", "blk07_text_head")}
    assert got["blk03_sparse_documents"] == {1: (0, True), 2: (0, True), 3: (0, True), 4: (20, True)}
    assert got["blk05_serialize_index"] == {i: ("(no evidence blocks)",) for i in (1, 2, 3)} | {4: ("[b0 p1] one line\n[b1 p1] and one more",)}
    assert got["blk07_text_head"] == {1: ("",), 2: ("",), 3: ("",), 4: ("one line\nand one more",)}


def test_null_blocks_are_sparse(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long").selectExpr("doc_id", "CAST(NULL AS array<struct<page:int,text:string>>) AS blocks", "array(1) AS image_pages")
    assert [tuple(r)[-2:] for r in ops.sparse_documents(docs).collect()] == [(0, True)]


def test_null_texts_are_judged_like_empty_ones(spark):
    docs = blocks_from_text(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    a, b = validate_documents(docs, d.ORDER_CHECKLIST).drop("text").orderBy("doc_id").collect()
    assert a["status"] == b["status"] == "FAIL" and a[1:] == b[1:]


def test_runs_are_not_shuffled_before_they_are_written(spark, monkeypatch):
    """Documents are placed by project before they are validated; whole runs take some twenty times their bytes."""
    plans = []
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append(self._df._jdf.queryExecution().optimizedPlan().toString()), write(self, path, *a, **k))[1])
    for name in ("snk01_write_runs", "str01_stream_validate"):
        load()[0][name](spark, SF_DIR)
        plan = next(p for p in plans[::-1] if "snapshots" in p)
        assert "RebalancePartitions" not in plan and plan.index("snapshots") < plan.index("RepartitionByExpression [project_id")


def test_placed_documents_make_few_files_and_split_a_large_project(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 > 0, "big").otherwise(F.concat(F.lit("p"), (F.col("id") % 40).cast("string"))).alias("project_id"))
    sinks.write_runs(sinks.placed(docs.repartition(16)), f"{tmp_path}/runs", in_place=True)
    files = {d: len([f for f in os.listdir(f"{tmp_path}/runs/{d}") if f.endswith(".parquet")]) for d in os.listdir(f"{tmp_path}/runs") if "=" in d}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(files) == 11 and sum(files.values()) < 11 + n and files["project_id=big"] >= n // 2
    assert sinks.read_runs(spark, f"{tmp_path}/runs").select("doc_id").distinct().count() == 4000


def test_exported_runs_are_packed(spark, tmp_path):
    rows = spark.range(50).select(F.concat(F.lit('{"run_id":'), F.col("id").cast("string"), F.lit("}")).alias("line"))
    sinks.export_run_json(rows, f"{tmp_path}/runs")
    parts = [f for f in os.listdir(f"{tmp_path}/runs") if f.startswith("part-")]
    assert parts and all(f.endswith(".gz") for f in parts)
    assert sorted(r[0] for r in spark.read.schema("run_id long").json(f"{tmp_path}/runs").collect()) == list(range(50))


def test_distances_in_step_are_those_of_the_loop():
    """Bands of one to eight words, texts with far characters, pairs within and beyond the edits that they may have."""
    rng = random.Random(5)
    for words in lines.BAND_WORDS:
        edits, pairs = 32 * words - 1, []
        for k in range(60):
            a = [rng.choice("abcdefgh \U0001f600") for _ in range(edits + 1 + rng.randrange(200))]
            b = list(a)
            for _ in range(rng.choice([1, edits // 2, edits - 1, edits + 5])):
                at = rng.randrange(len(b))
                b[at : at + rng.randrange(2)] = rng.choice(["", "x", "ü"])
            pairs.append(("".join(a), "".join(b)))
        pairs = [(a, b) for a, b in pairs if len(b) > edits and abs(len(a) - len(b)) <= edits]
        most = np.array([edits if k % 3 else edits // 2 for k in range(len(pairs))])
        found = lines.banded_distances([a for a, _ in pairs], [b for _, b in pairs], most, words)
        want = [lines.edit_distance(a, b, int(m)) for (a, b), m in zip(pairs, most, strict=True)]
        assert any(w <= m for w, m in zip(want, most, strict=True)) and len(pairs) > 30
        assert [min(int(f), int(m) + 1) for f, m in zip(found, most, strict=True)] == want


def test_similar_pairs_are_those_found_one_by_one():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 900))) for _ in range(60)] + ["".join(rng.choice("xyz") for _ in range(6_000))]
    pairs = [("", "a"), ("ab", "ab" * 40), (texts[-1], texts[-1][100:] + "q")]
    for t in texts:
        for share in (0.01, 0.05, 0.09, 0.11, 0.5):
            pairs.append((t, "".join(c for c in t if rng.random() > share)))
            pairs.append(("".join(rng.choice("kl") if rng.random() < share else c for c in t), t))
    want = [lines.may_be_near(a, b) and lines.similar(a, b) for a, b in pairs]
    assert lines.similar_pairs([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want and 100 < sum(want) < len(want) - 100


def test_lines_are_held_once(spark, monkeypatch):
    """What lines are compared by is written for distinct lines only, and not once more in every round."""
    wrote, write = [], common.written
    rng = random.Random(8)
    base = [sentence(rng, "en", 20) for _ in range(30)]
    near = lambda t: " ".join("new" if k == 3 else w for k, w in enumerate(t.split()))
    data = [(i, "\n".join([base[i % 30], near(base[(i + 7) % 30]), sentence(rng, "de", 12)]), None, None, None) for i in range(60)]

    def keeping(df, name):
        wrote.append((name, df.columns))
        return write(df, name)

    monkeypatch.setattr(lines, "written", keeping)
    monkeypatch.setattr(common, "written", keeping)
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.deduplicate_lines(documents(spark, data)).collect()}
    assert sum(d for _, d in found.values()) == 90 and all(n == 3 for n, _ in found.values())
    heavy = [name for name, columns in wrote if "hash" in columns]
    assert heavy == ["lines", "lines-distinct", "lines-traits"]
