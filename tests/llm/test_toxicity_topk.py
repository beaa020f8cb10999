import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docaudit.llm import topk, toxicity

from .helpers import documents, empty, sentence


def toxic_documents():
    rng = random.Random(9)
    out, labels = [], []
    for i in range(400):
        words = sentence(rng, ("en", "de")[i % 2], rng.randint(5, 60)).split()
        bad = i % 5 == 0
        if bad:
            word = rng.choice(["stongering", "ichverstond", "andungeron"])
            words.insert(rng.randrange(len(words)), word if i < 300 else rng.choice([word.replace("o", "0").replace("e", "3").replace("a", "@"), " ".join(word), word.replace("o", "oooo").replace("e", "eee")]))
        out.append((i, " ".join(words), None, None, None))
        labels.append((i, int(bad)))
    return out, labels


@pytest.fixture(scope="module")
def learnt(spark):
    data, labels = toxic_documents()
    docs = documents(spark, data)
    known = spark.createDataFrame(labels[:300], "doc_id long, toxic int")
    return docs, toxicity.train(docs, known, toxicity.trigram_counts(docs)), labels


def test_disguised_words_of_texts_that_were_not_learnt(learnt):
    docs, model, labels = learnt
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.withColumn("Score", F.lit("old")), model).collect()}
    wrong = [i for i, toxic in labels[300:] if (got[i] >= 0.5) != bool(toxic)]
    assert len(wrong) <= 3 and all(0 <= s <= 1 for s in got.values())


def test_counts_cover_whole_texts(spark):
    counts = toxicity.trigram_counts(documents(spark, [(1, "Ab-ab", None, None, None), (2, None, None, None, None), (3, "é", None, None, None)]))
    at = lambda s: counts[sum((ord(c) - 96 if c != "_" else 0) * 27 ** (2 - i) for i, c in enumerate(s))]
    assert (at("_ab"), at("ab_"), at("b_a"), at("_e_")) == (2, 2, 1, 1)


def restore_slowly(span, costs):
    """The cheapest of all paths through the lattice."""
    best = (math.inf, "")
    todo = [(0, 0.0, 0, 0, "", "")]
    while todo:
        at, cost, a, b, read, before = todo.pop()
        if at == len(span):
            best = min(best, (cost + costs[a, b, 0], read))
            continue
        ch, own = span[at], toxicity._code(span[at])
        options = [(own, 0.0)] * bool(own) + [(ord(x) - 96, toxicity.LOOK_COST) for x in toxicity.LOOKS_LIKE.get(ch, "")]
        for x, extra in options:
            todo.append((at + 1, cost + extra + costs[a, b, x], b, x, read + chr(x + 96), ch))
        skip = toxicity.REPEAT_COST if own and ch == before else None if own else toxicity.LOSS_COST if options else toxicity.SKIP_COST
        if skip is not None:
            todo.append((at + 1, cost + skip, a, b, read, ch))
    return best[1]


def test_viterbi_finds_the_cheapest_path():
    rng = random.Random(8)
    costs = toxicity.letter_costs(np.array([rng.randrange(50) for _ in range(27**3)]))
    for _ in range(150):
        span = "".join(rng.choice("ab1!0$ee.-") for _ in range(rng.randrange(1, 8)))
        assert toxicity.restore(span, costs) == restore_slowly(span, costs), span


def test_toxicity_edges(spark, learnt):
    docs, model, _ = learnt
    odd = documents(spark, [(1, None, None, None, None), (2, "", None, None, None), (3, "a " * 30_000, None, None, None), (4, "1!" * 5_000 + "a", None, None, None)])
    scores = [r["score"] for r in toxicity.score(odd, model).collect()]
    assert len(scores) == 4 and max(scores) < 0.5 and scores[0] == scores[1]
    assert toxicity.score(empty(spark), model).count() == 0
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), np.zeros(27**3, np.int64))
    assert nothing.score("stongering") == 0.0


def brute_top(vectors, queries, k):
    out = []
    for q, w in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, v in vectors if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 5, 40])
def test_top_k_against_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 5)
    rng = random.Random(width)
    vectors = [(i, [rng.randrange(-6, 7) * (rng.random() < 0.6) for _ in range(width)]) for i in range(300)]
    vectors = [(i, vectors[0][1] if i % 3 == 0 else v) for i, v in vectors]  # a third of the vectors are equal
    frame = spark.createDataFrame(vectors, "id long, vector array<long>")
    got = topk.top_k(frame, frame.filter("id % 20 = 0"), 5)
    assert sorted(map(tuple, got.collect())) == brute_top(vectors, [v for v in vectors if v[0] % 20 == 0], 5)


def test_quantised_vectors(spark):
    data = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [])]
    frame = spark.createDataFrame(data, "id long, v array<float>").select("id", topk.quantised("v").alias("q"))
    assert {r["id"]: r["q"] for r in frame.collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_top_k_edges(spark):
    schema = "id long, vector array<long>"
    none = spark.createDataFrame([], schema)
    few = spark.createDataFrame([(0, [1, 2]), (1, [3]), (None, [9, 9]), (2, None), (0, [1, 2])], schema)
    assert topk.top_k(none, none).count() == 0 and topk.top_k(few, none).count() == 0
    assert sorted(map(tuple, topk.top_k(few, few.filter("id = 0"), 5).collect())) == [(0, 1, 1, 3)]
    big = spark.createDataFrame([(0, [2**31, 1]), (1, [2**30, 1]), (2, [-(2**30), 7])], schema)
    assert [r["score"] for r in topk.top_k(big, big.filter("id = 0"), 2).orderBy("rank").collect()] == [2**61 + 1, -(2**61) + 7]


def test_a_capped_class_keeps_its_weight(spark, monkeypatch):
    """A word in a third of the clean and nine tenths of the toxic texts flags none, whether all rows are learnt or a sample."""
    rng = random.Random(12)
    data, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = sentence(rng, "en", 8).split()
        if rng.random() < (0.9 if toxic else 0.33):
            words.insert(3, "mildwordx")
        if toxic and rng.random() < 0.9:
            words.insert(2, "foulwordx")
        data.append((i, " ".join(words), None, None, None))
        labels.append((i, int(toxic)))
    docs, known = documents(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")
    counts = toxicity.trigram_counts(docs)
    whole = toxicity.train(docs, known, counts)
    monkeypatch.setattr(toxicity, "SAMPLE_DOCUMENTS", 200)
    capped = toxicity.train(docs, known, counts)
    assert whole.base == pytest.approx(1 / 18) and capped.base == pytest.approx(whole.base)
    assert abs(capped.threshold - whole.threshold) < 0.1
    for model in (whole, capped):
        assert model.score("the mildwordx") < 0.5 <= model.score("the foulwordx")
