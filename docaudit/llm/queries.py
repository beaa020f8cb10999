"""One query for each operator of this folder, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.session import shared_folder

from . import bpe, exact, language, lines, minhash, mixing, resampling, sharding, topk, toxicity, urlrules, warc, whitening

#: Folder of the public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(parts: int):
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op1_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    model = language.train(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op2_bpe")
def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    found = bpe.decode(bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), path).drop("text"), path)
    return found.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query(
    "op5_mix_sources",
    r"""WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
v AS (SELECT *, CASE place % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM w),
c AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS full_at,
             1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget FROM v),
l AS (SELECT *, coalesce(sum(most) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under,
             sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM c),
m AS (SELECT *, (SELECT (budget - under) / open FROM l WHERE (budget - under) / open <= full_at ORDER BY full_at, place LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM m),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS own FROM d GROUP BY source, h),
r AS (SELECT source, h, own, coalesce(sum(own) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT d.doc_id, d.size, f.source_size, f.target,
       d.size * (f.whole + CASE WHEN f.target > f.whole * f.source_size AND r.before + r.own / 2.0 <= f.target - f.whole * f.source_size THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h""",
)
def mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), mixing.words("text"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_shard_kd")
def shard_kd(spark: SparkSession, sf: str) -> DataFrame:
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    placed = sharding.shard(table(spark, sf, "documents"), F.length(data) + 16, shards=40, keep={"text_crc32": F.crc32(data)})
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op8_exact_dedup",
    """WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""",
)
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf, "documents"))


@query(
    "op3_warc",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to FROM g""",
)
def warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), folder, "page_id", "html", "url")
    back = warc.read_archives(spark, folder, with_payload=False)
    return back.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op10_top_k",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised("embedding").alias("vector"))
    return topk.top_k(vectors, vectors.filter("id % 50 = 0"), 5)


@query("op7_minhash")
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), similarity=85)


@query("op6_line_dedup")
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.deduplicate_lines(table(spark, sf, "documents").select("doc_id", "text"))


@query("op9_toxicity")
def toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    model = toxicity.train(docs, table(spark, sf, "labels").filter(~held_out), toxicity.trigram_counts(docs))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_whitening")
def whitened(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"), components=16)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query(
    "op12_resampling",
    r"""WITH RT AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL),
g AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM b) GROUP BY ALL),
u AS (SELECT DISTINCT word FROM (SELECT word FROM c UNION ALL SELECT word FROM g)),
h AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, list_extract(tab, (xor(c, x) & 255) + 1))), 4294967295) % 10000 AS bucket FROM u, RT),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM c JOIN h USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM g JOIN h USING (word) GROUP BY bucket),
k AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::BIGINT AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::BIGINT AS all_t),
v AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), k),
w AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM c JOIN h USING (word) JOIN v USING (bucket) GROUP BY doc_id),
x AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN floor(total / n_features)::BIGINT ELSE 0 END AS weight,
             ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS r FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((r + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, (count(*) OVER () * 10) // 100 AS drawn FROM y WHERE n_features >= 20)
SELECT y.*, CASE WHEN place <= drawn THEN place END AS rank FROM y LEFT JOIN z USING (doc_id)""",
)
def resampled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf, "benchmark").select("text"), most=1, buckets=10_000, least_words=20, percent=10, seed=2024)


#: Rules of the url filter: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op13_url_rules",
    r"""WITH r(rule_host, rule_path, says) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u)
SELECT page_id, host, path,
       (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT arg_max(says, length(rule_host || rule_path)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict FROM p""",
)
def url_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf, "pages").select("page_id", "url"), rules).drop("url")
