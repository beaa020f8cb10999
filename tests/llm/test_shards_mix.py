import pytest
from pyspark.sql import functions as F

from docaudit.llm import mixing, sharding

from .helpers import documents, empty, rows


def size():
    return F.length(F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))) + 16


def test_shards_hold_nearly_equal_bytes(spark):
    data = [(i, "x" * (1 + i * 37 % 400), "en", "hot" if i % 3 else "s", None) for i in range(4_000)]
    got = sharding.shard(documents(spark, data), size(), dims=("text", "source"), shards=7, keep={"lang": F.col("lang")}).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(4_000))
    total, slots = {}, {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(total) == 7 and max(total.values()) < 1.02 * min(total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_value_can_be_split(spark):
    data = [(i, "same text", "en", "one", 9) for i in range(1_000)]
    got = sharding.shard(documents(spark, data), size(), shards=4).groupBy("shard").count().collect()
    assert len(got) == 4 and all(abs(r["count"] - 250) < 25 for r in got)


def test_target_bytes_and_edges(spark):
    docs = documents(spark).withColumn("shard", F.lit("old")).withColumn("_size", F.lit(0))
    got = sharding.shard(docs, size(), target_bytes=20_000).collect()
    total = sum(len((t or "").encode()) + 16 for _, t, *_ in rows())
    assert len(got) == len(rows()) and {r["shard"] for r in got} <= set(range(-(-total // 20_000)))
    assert sharding.shard(empty(spark), size(), shards=3).count() == 0
    twice = sharding.shard(documents(spark, [(1, "a", None, None, None)] * 4 + [(None, None, None, None, None)]), size(), shards=3).collect()
    assert len(twice) == 5 and len({r["shard"] for r in twice if r["doc_id"] == 1}) == 1
    with pytest.raises(ValueError):
        sharding.shard(docs, size())


def fill(sizes: list[int], weights: list[int], share: float, cap: float) -> list[float]:
    """Shares by weight; what is above a cap goes to the others, over and over."""
    left, full, out = share * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i] for i in rest)
        for i in rest:
            out[i] = left * weights[i] / weight
        over = [i for i in rest if out[i] > cap * sizes[i] + 1e-9]
        if not over:
            return out
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        full |= set(over)


@pytest.mark.parametrize("sizes", [[100, 5, 5, 5, 5], [10, 10, 10], [1, 1000, 2], [7], [0, 4, 0], [50, 1, 30, 2, 40, 3]])
def test_targets_are_shared_by_weight(spark, sizes):
    table = spark.createDataFrame([(f"s{i}", f"=s{i}", n) for i, n in enumerate(sizes)], "source string, key string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(table, (3, 1, 2), 1.5, 2.0).collect()}
    want = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_meets_its_targets_and_reruns_agree(spark):
    data = [(i, "w " * (1 + i * 13 % 29), None, ("hot", "hot", "a", "b", None)[i % 5], None) for i in range(3_000)]
    docs = documents(spark, data).withColumn("Taken", F.lit("old"))
    got = mixing.mix(docs, mixing.words("text"), keep=["doc_id", "source"]).collect()
    assert len(got) == 3_000
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5), mixing.words("text"), keep=["doc_id"]).collect()}
    assert {r["doc_id"]: r["taken"] for r in got} == again
    taken, target = {}, {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 29 for s in target) and len(target) == 4
    rows_ = mixing.take(docs, mixing.words("text"))
    assert rows_.columns == docs.columns
    assert rows_.groupBy("doc_id").count().filter("count > 2").isEmpty()
    assert rows_.count() == sum(r["copies"] for r in got)


def test_budgets_are_nested(spark):
    docs = documents(spark)
    small, large = ({r["doc_id"]: r["taken"] for r in mixing.mix(docs, mixing.words("text"), share=s, keep=["doc_id"]).collect()} for s in (0.3, 0.9))
    assert all(large[i] >= small[i] for i in small)


def test_mix_edges(spark):
    assert mixing.mix(empty(spark), mixing.words("text")).count() == 0
    odd = documents(spark, [(1, None, None, None, None), (None, "a b", None, "s", None), (2, "", None, "t", None), (2, "", None, "t", None)])
    got = mixing.mix(odd, mixing.words("text")).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) in (2, 4)
