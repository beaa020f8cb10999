import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docaudit.llm import resampling, urlrules, whitening

from .helpers import documents, empty, rows

VECTORS = "vec_id long, embedding array<double>, component string, key string, n int"


def spectra():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 40):
        a = rng.normal(size=(n, n))
        yield a @ a.T
    turn, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    yield turn @ np.diag([5.0] * 4 + [1.0] * 4 + [0.0] * 4) @ turn.T
    yield turn @ np.diag(10.0 ** -np.arange(12)) @ turn.T
    yield np.eye(5)
    yield np.zeros((4, 4))
    yield np.ones((6, 6))
    yield np.array([[0.0, 1.0], [1.0, 0.0]])
    yield np.diag([1.0, 1 + 1e-14, 1 - 1e-14, 3.0])


@pytest.mark.parametrize("a", list(spectra()), ids=lambda a: str(len(a)))
def test_spectrum_by_division(a):
    values, vectors = whitening.split_spectrum(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() <= 1e-13
    assert np.abs(vectors @ np.diag(values) @ vectors.T - a).max() <= 1e-13 * size * len(a)


def test_polar_factor():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    u = whitening.polar_factor(a)
    values, vectors = np.linalg.eigh(a)
    assert np.abs(u - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-12


def whitened_slowly(data, components):
    good = [(k, v) for k, v in data if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    wide = max(len(v) for _, v in good)
    ints = [(k, tuple(math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (wide - len(v))])) for k, v in good]
    fit = sorted({x for _, x in ints})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float)
    x -= x.mean(axis=0)
    values, vectors = np.linalg.eigh(x.T @ x / n)
    order = np.argsort(-values)[:components]
    out = []
    for k, row in ints:
        deviation = sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
        white = np.array([v - s / n for v, s in zip(row, sums, strict=True)]) @ vectors[:, order] / np.sqrt(values[order])
        out += [(k, i + 1, n, deviation, w, values[order[i]] / values.sum()) for i, w in enumerate(white)]
    return out


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(11)
    turn = rng.normal(size=(9, 9))
    data = [(i, [float(c) for c in row]) for i, row in enumerate(rng.normal(size=(300, 9)) @ turn)]
    data += [(500 + i, data[0][1]) for i in range(40)] + [(7, data[7][1]), (None, data[8][1]), (600, data[9][1][:5])]
    bad = [(700, None), (701, [1.0, None] + [0.0] * 7), (702, [float("nan")] * 9), (703, [float("inf")] * 9), (704, [])]
    df = spark.createDataFrame([(k, v, "c", "k", 3) for k, v in data + bad], VECTORS).repartition(5)
    got = whitening.whiten(df, components=6).collect()
    want = whitened_slowly(data + [(704, [])], 6)
    mine = sorted(got, key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0, r["component"], r["deviation"]))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"])) for r in mine] == [w[:4] for w in want]
    sign = {}
    for r, w in zip(mine, want, strict=True):
        if abs(w[4]) > 1e-6:
            sign.setdefault(r["component"], math.copysign(1, w[4] * r["whitened"]))
        assert abs(r["whitened"] - sign.get(r["component"], 1) * w[4]) < 1e-9 and abs(r["explained"] / w[5] - 1) < 1e-10
    assert 0 <= mine[0]["identity_error"] < 1e-10
    # The covariance of the whitened distinct vectors is the identity.
    first = {tuple(v): k for k, v in reversed([(k, v) for k, v in data if k is not None and len(v) == 9])}
    white = {(r["vec_id"], r["component"]): r["whitened"] for r in got}
    ids = [*first.values(), 600, 704]
    w = np.array([[white[k, c] for c in range(1, 7)] for k in ids])
    assert np.abs(w.T @ w / len(ids) - np.eye(6)).max() < 1e-10


def test_whitening_of_odd_tables(spark):
    frame = lambda data: spark.createDataFrame([(k, v, None, None, None) for k, v in data], VECTORS)
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None), (2, [None])])).collect() == []
    assert whitening.whiten(frame([(1, []), (2, [])])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    # Two vectors fill one direction.
    one = whitening.whiten(frame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 1.0])])).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["component"], round(abs(r["whitened"]), 12)) for r in one] == [(1, 1, 1.0), (2, 1, 1.0)]
    huge = whitening.whiten(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and all(r["whitened"] is not None for r in huge)
    assert huge[0]["deviation"] is None


def resampled_slowly(docs, aim, most, buckets, least_words, percent, seed):
    word = re.compile(resampling.WORD)
    lower = str.maketrans(resampling.UPPER, resampling.LOWER)

    def features(text):
        words = word.findall((text or "").translate(lower))
        runs = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in aim for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for k, n_words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[5], r[2]))
    for place, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("most", "buckets", "percent"), [(1, 10_000, 10), (2, 64, 40), (3, 997, 100)])
def test_resampling_against_brute_force(spark, most, buckets, percent):
    data = rows() + [(300 + i % 3, "one two\nthree\n\nfour five six seven\nÉé ß 42", "x", None, 1) for i in range(9)]
    data += [(None, rows()[3][1], None, None, None), (None, None, None, None, None), (400, "word " * 30, None, None, None), (400, "word " * 30, None, None, None)]
    aim = [rows()[2][1], rows()[5][1], None, "", "one two three"]
    clash = documents(spark, data).withColumns({"row": F.lit("x"), "key": F.lit("y"), "parts": F.lit(1), "rank": F.lit(2), "SCORE": F.lit(3)})
    target = spark.createDataFrame([(x, 1) for x in aim], "text string, bucket int")
    got = resampling.resample(clash, target, most=most, buckets=buckets, least_words=9, percent=percent)
    want = resampled_slowly([(d[0], d[1]) for d in data], aim, most, buckets, 9, percent, 2024)
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)


def test_segments_are_counted_once(spark):
    docs = documents(spark, [(i, "A common line\nof its own %d\n\n..." % i, None, None, None) for i in range(50)])
    found = resampling.distinct_segments(docs, "text", 2, 100).collect()
    assert len(found) == 51 and sorted(r["n"] for r in found)[-1] == 50
    assert {r["n"]: (r["n_words"], len(r["features"])) for r in found} == {50: (3, 5), 1: (4, 7)}


def test_resampling_of_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(empty(spark), target).collect() == []
    got = resampling.resample(documents(spark, [(1, None, None, None, None), (2, "", None, None, None)]), target).collect()
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["rank"]) for r in got) == [(1, 0, 0, None), (2, 0, 0, None)]


URLS = "page_id long, url string, host int, Rule string, row string, block int, says int"


def judged_slowly(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        found = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = found[1].translate(str.maketrans(urlrules.UPPER, urlrules.LOWER)), found[2]
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(4)
    labels = ["a", "b", "ab", "www", "example", "com", "net"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/en", "/en/", "x", "/fr/y", ""]) for _ in range(rng.randint(0, 4)))
    found = [f"{rng.choice(['http', 'HTTPS', ''])}://{host()}{path()}{rng.choice(['', '?q=/en/', '#://x', '?'])}" for _ in range(300)]
    found += ["http://WWW.Example.COM/en/a", "http://example.com", "no scheme/en/", "", None, "://", "http:///en/", "x\ny://com/\nz", "http://ÉXAMPLE.com/", "http://.com/", "http://com./", "http://a..com/"]
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(80)]
    return found, [*{r[:2]: r for r in rules}.values()]


@pytest.mark.parametrize("blocks", [1, urlrules.MOST_BLOCKS])
def test_urls_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(urlrules, "MOST_BLOCKS", blocks)
    found, rules = urls()
    data = [(i, u, 1, "old", "r", 2, 3) for i, u in enumerate(found)] + [(0, found[0], 1, "old", "r", 2, 3)]
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("com", "/", None)], "host string, path string, verdict string")
    got = urlrules.judge(spark.createDataFrame(data, URLS), listed)
    assert got.columns == ["page_id", "url", "row", "block", "says", "host", "path", "rule", "verdict"]
    mine = sorted((r["page_id"], r["url"], r["row"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.fillna("<null>", "url").collect())
    assert [m[3:] for m in mine] == [judged_slowly(d[1], rules) for d in sorted(data, key=lambda d: d[0])]


def test_urls_without_rows_or_rules(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    some = spark.createDataFrame([("Com", "/", "allow"), ("com", "/", "block")], none.schema)
    page = spark.createDataFrame([(1, "http://a.com/", 1, "", "", 1, 1), (2, None, 1, "", "", 1, 1)], URLS)
    assert urlrules.judge(page.limit(0), some).collect() == []
    assert [(r["rule"], r["verdict"]) for r in urlrules.judge(page, none, default="block").collect()] == [(None, "block")] * 2
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge(page, some).collect()} == {1: ("com/", "block"), 2: (None, "allow")}


def test_bloom_filter_passes_every_rule_and_few_others(spark):
    rules = spark.range(4_000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("rule_host"), F.lit("/").alias("rule_path"))
    blocks = 4_000 // urlrules.BLOCK_RULES
    table = urlrules.bloom_blocks(rules, blocks)
    urls_ = lambda low, high: spark.range(low, high).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("/x").alias("path"))
    own = urlrules.possible(urls_(0, 4_000), [1], table, blocks).filter("host = rule_host").count()
    others = urlrules.possible(urls_(4_000, 24_000), [1], table, blocks).count()
    assert own == 4_000 and others < 0.03 * 2 * 20_000
