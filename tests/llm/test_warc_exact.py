import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docaudit.llm import exact, warc
from docaudit.session import shared_folder

from .helpers import documents, empty, rows

PAGES = "page_id long, url string, html string, payload string"


def pages():
    big, other = "a é" * 500, "b" * 1_000
    out = [(5, "http://x.example/a b\r\nc", big, "x"), (2, None, big, None), (9, "http://y.example", big, None), (3, "u", "short", None), (4, "u", "short", None)]
    return out + [(7, "u", None, None), (8, "u", "", None), (None, "u", other, None), (1, "u", other, None), (11, "u", "\r\n\r\nWARC/1.1", None), (9, "z", big, None)]


def expected():
    data = [(i, (h or "").encode()) for i, _, h, _ in pages()]
    most = {}
    for i, d in data:
        if i is not None:
            most[d] = max(i, most.get(d, i))
    out = []
    for i, d in data:
        again = len(d) >= 1000 and most[d] != i
        out.append((i, len(d), hashlib.sha1(d).hexdigest(), "revisit" if again else "response", most[d] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 600)
    frame = spark.createDataFrame(pages(), PAGES).repartition(3)
    files = []
    for _ in range(2):
        folder = shared_folder(spark, "test-warc")
        manifest = warc.write_archives(frame, folder, "page_id", "html", "url", shard_bytes=2_000).collect()
        got = warc.read_archives(spark, folder).collect()
        assert sorted([tuple(r)[:5] for r in got], key=repr) == expected()
        assert {r["row_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response" and r["row_id"] != 9}[11] == b"\r\n\r\nWARC/1.1"
        assert len(manifest) > 2 and sum(m["records"] for m in manifest) == len(pages())
        files.append(sorted((m["file"], m["sha1"], m["bytes"]) for m in manifest))
        warc.commit(spark, folder)  # a second commit changes nothing
        assert warc.read_archives(spark, folder).count() == len(pages())
    assert files[0] == files[1]


def test_many_groups_take_the_salted_way(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW_GROUPS", 0)
    folder = shared_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(pages(), PAGES), folder, "page_id", "html", "url")
    assert sorted([tuple(r)[:5] for r in warc.read_archives(spark, folder, with_payload=False).collect()], key=repr) == expected()


def test_empty_table_and_damage(spark):
    folder = shared_folder(spark, "test-warc")
    assert warc.write_archives(spark.createDataFrame([], PAGES), folder, "page_id", "html", "url").count() == 0
    assert warc.read_archives(spark, folder).count() == 0
    record = warc.encode_record(1, "u", b"payload", 7, hashlib.sha1(b"payload").digest(), None)
    assert [r[:5] for r in warc.parse_archive(gzip.compress(record))] == [(1, 7, hashlib.sha1(b"payload").hexdigest(), "response", None)]
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse_archive(gzip.compress(record.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaD"))))


def saved(spark, data=None):
    path = shared_folder(spark, "test-exact")
    (documents(spark, data) if data is not None else documents(spark)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def brute(data):
    norm = {i: (t or "").translate(str.maketrans(exact.UPPER, exact.LOWER)) for i, t, *_ in data}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (max(groups[t]), len(groups[t]), max(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


@pytest.mark.parametrize("few", [0, 1_000])
def test_exact_groups(spark, monkeypatch, few):
    monkeypatch.setattr(exact, "FEW_DIGESTS", few)
    got = exact.deduplicate(saved(spark)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows()) and len(got) == len(rows())


def test_state_goes_on_with_new_files(spark):
    folder = shared_folder(spark, "test-exact-state")
    data = rows()
    exact.deduplicate(saved(spark, data[:40]), folder=folder).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in exact.deduplicate(saved(spark, data[40:]), folder=folder).collect()}
    assert got == brute(data)


def test_state_in_any_order_of_keys_and_calls(spark):
    data = rows()
    random.Random(3).shuffle(data)
    for parts in ([data[50:], data[20:50], data[:20]], [sorted(data, key=lambda r: -r[0])[:30], [], sorted(data, key=lambda r: -r[0])[30:]]):
        folder = shared_folder(spark, "test-exact-order")
        seen = []
        for part in parts:
            seen += part
            got = {r["doc_id"]: tuple(r)[1:] for r in exact.deduplicate(saved(spark, part), folder=folder).collect()}
            assert got == brute(seen)


@pytest.mark.parametrize("later", [1, 3])
def test_collisions_with_earlier_files_are_found(spark, monkeypatch, later):
    real = F.sha2
    folder = shared_folder(spark, "test-exact-collision")
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: real(F.lit("same").cast("binary"), n))
    exact.deduplicate(saved(spark, [(2, "a", None, None, None)]), folder=folder)
    exact.deduplicate(saved(spark, [(later + 10, "A", None, None, None)]), folder=folder)
    with pytest.raises(ValueError, match="two different texts"):
        exact.deduplicate(saved(spark, [(later, "b", None, None, None)]), folder=folder)


def test_exact_edges(spark):
    assert exact.deduplicate(saved(spark, [])).count() == 0
    twice = [(1, "a", None, None, None), (1, "A", None, None, None), (None, "a", None, None, None)]
    got = exact.deduplicate(saved(spark, twice).withColumn("digest", F.lit(0))).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in got) == [(1, 3)] * 3 and sum(r["kept"] for r in got) == 1


def test_equal_digests_of_different_texts_are_found(spark, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: real(F.lit("same").cast("binary"), n))
    with pytest.raises(ValueError, match="digest"):
        exact.deduplicate(saved(spark, [(1, "a", None, None, None), (2, "b", None, None, None)]))
