"""URL rules by a blocked Bloom filter and an exact hash join.

A rule is a host and a path: it fits its host and all subdomains where the path of the url starts with the rule's. A
url's candidates are every parent of its host with every start of its path that is as long as some rule's path. The
listed rules set one bit in each of the eight words of one block of a Bloom filter. Candidates whose block lacks a bit
are no rule and go at once, without a shuffle; the few that pass meet the list itself in a hash join, which removes
false positives. The filter is a table of at most ``MOST_BLOCKS`` blocks, so it may be broadcast whatever the length of
the list: a longer list only lets more candidates pass to the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, without, written

#: Words of 64 bits of a block; rules that share a block on average; blocks at most (72 bytes each).
WORDS = 8
BLOCK_RULES = 32
MOST_BLOCKS = 1 << 19

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ("host", "path", "rule", "verdict")


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty where it is null or holds no ``://``."""
    u = F.col(url) if isinstance(url, str) else url
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    cut = lambda group: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group)
    return F.translate(cut(1), UPPER, LOWER), cut(2)


def _places(host: str, path: str) -> tuple[Column, list[Column]]:
    """Number of a key's block before the remainder, and one bit for each word."""
    second = F.xxhash64(F.lit(1), path, host)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]
    return F.xxhash64(host, path), bits


def bloom_blocks(rules: DataFrame, blocks: int) -> DataFrame:
    """``block`` and its words ``w0``… of the listed ``rule_host``, ``rule_path``."""
    first, bits = _places("rule_host", "rule_path")
    rows = rules.select(F.pmod(first, F.lit(blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def candidates(urls: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """``host``, ``path``, ``rule_host``, ``rule_path``: all that could be a rule for each url."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    both = urls.filter("host <> ''").select("host", "path", F.explode(parents).alias("rule_host"), starts.alias("starts"))
    return both.select("host", "path", "rule_host", F.explode("starts").alias("rule_path"))


def possible(urls: DataFrame, lengths: Sequence[int], filter_blocks: DataFrame, blocks: int) -> DataFrame:
    """The candidates whose bits are all set."""
    first, bits = _places("rule_host", "rule_path")
    set_ = F.lit(True)
    for i, bit in enumerate(bits):
        set_ = set_ & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    placed = candidates(urls, lengths).withColumn("block", F.pmod(first, F.lit(blocks)))
    return placed.join(F.broadcast(filter_blocks), "block").filter(set_).select("host", "path", "rule_host", "rule_path")


def judge(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, else null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). Hosts are compared with A-Z lower-cased
    and paths as they are. Of the rules that fit, the longest (host and path together) wins, of equally long ones that
    with the longer host; of rules with equal host and path ``block`` wins. Rules with a null or an empty host or a
    null in another column are left out. Urls that are null, empty or without ``://`` have empty host and path and get the ``default``,
    as do those that no rule fits. Repeated rows are judged alike, other columns stay, old ones of the four names are
    replaced. An empty table stays empty, an empty list gives every row the default.
    """
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("says"))
    listed = listed.filter("rule_host <> '' AND rule_path IS NOT NULL AND says IS NOT NULL")
    listed = written(listed.groupBy("rule_host", "rule_path").agg(F.max("says").alias("says")), "url-rules")
    count, lengths = listed.agg(F.count("*"), F.array_sort(F.collect_set(F.length("rule_path")))).first()
    host, path = host_and_path(f"`{url}`")
    base = without(df, RESULT)
    if not count:
        return base.select("*", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = max(1, min(MOST_BLOCKS, -(-count // BLOCK_RULES)))
    urls = df.select(host.alias("host"), path.alias("path"))
    passed = possible(urls, lengths, written(bloom_blocks(listed, blocks), "url-bloom"), blocks).distinct()
    exact = passed.join(F.broadcast(listed) if count <= FEW_ROWS else listed.hint("shuffle_hash"), ["rule_host", "rule_path"])
    longest = F.max(F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("own"), F.concat("rule_host", "rule_path").alias("rule"), "says"))
    hits = written(exact.groupBy("host", "path").agg(longest.alias("best")).select("host", "path", "best.rule", "best.says"), "url-hits")
    # The row travels as one value, so that no column of it can clash with those of the join.
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row") if base.columns else F.struct(F.lit(1)).alias("row")
    rows = df.select(row, host.alias("host"), path.alias("path"))
    found = rows.join(F.broadcast(hits) if hits.count() <= FEW_ROWS else hits, ["host", "path"], "left")
    return found.select(*[F.col("row").getField(c).alias(c) for c in base.columns], "host", "path", "rule", F.coalesce("says", F.lit(default)).alias("verdict"))
