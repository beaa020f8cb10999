"""Evidence: where in the document a value stands.

Needles are compared with blocks of the same document only, inside the document row, so there is
never a join of needles with blocks. Texts of blocks are normalised once a document and joined to one haystack, which a
needle searches as a whole; no needle visits the blocks one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.geometry import area_of, valid_box
from docaudit.functions.text import compact, first, group0_or, let, squeeze, strip
from docaudit.functions.values import text_of

# Needle lengths and area limits.
QUOTE_CHARS, VALUE_CHARS = 4, 3
SNIPPET_CHARS = 8
TIGHTER, SMALL_AREA = 0.92, 2500.0


def needle(text: Column) -> Column:
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


def haystack(blocks: Column) -> Column:
    """Normalised texts of all blocks, one a line. Needles hold no line feed, so a hit lies within one block."""
    return F.array_join(F.transform(blocks, lambda b: needle(b["text"])), "\n")


def block_with(hay: Column, n: Column) -> Column:
    """Number of the first block that holds a needle, NULL if none does: one search through the document's text."""

    def line(at: Column) -> Column:
        before = F.left(hay, at)
        return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))

    return let(F.instr(hay, n), line)


def anchor_block(blocks: Column, cited: Column, quote: Column, val: Column) -> Column:
    """The cited block if a needle occurs in it, else the block with the longest needle, else the cited one."""

    def pick(q: Column, v: Column) -> Column:
        needles = F.concat(
            F.when(F.length(q) >= QUOTE_CHARS, F.array(q)).otherwise(F.array().cast("array<string>")),
            F.when(
                (F.length(v) >= VALUE_CHARS) & ~((F.length(q) >= QUOTE_CHARS) & (q == v)), F.array(v)
            ).otherwise(F.array().cast("array<string>")),
        )

        def search(ns: Column) -> Column:
            named = first(F.filter(blocks, lambda b: (b["block_id"] == cited) & (cited != "")))
            confirmed = F.exists(ns, lambda n: needle(named["text"]).contains(n))

            def longest(hay: Column) -> Column:
                hits = F.transform(ns, lambda n: F.struct((-F.length(n)).alias("size"), block_with(hay, n).alias("i")))
                return F.get(blocks, F.array_min(F.filter(hits, lambda h: h["i"].isNotNull()))["i"])

            found = F.when(F.size(ns) > 0, let(haystack(blocks), longest))
            return F.when(named.isNotNull() & confirmed, named).otherwise(F.coalesce(found, named))

        return let(needles, search)

    return let(needle(quote), lambda q: let(needle(val), lambda v: pick(q, v)))


def anchor_evidence(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``(key, blocks, cited, quote, value_text)`` → anchored block id, page and box."""
    a = let(
        F.col("blocks"), lambda bs: anchor_block(bs, F.col("cited"), F.col("quote"), F.col("value_text"))
    )
    return df.select(key, "cited", "quote", a.alias("a")).select(
        key, "cited", "quote", F.coalesce("a.block_id", "cited").alias("block_id"),
        F.coalesce("a.page", F.lit(1)).alias("page"), "a.x0", "a.y0", "a.x1", "a.y1",
    )


def needle_variants(quote: Column, val: Column) -> Column:
    """Search phrases: the quote, the value, what follows the last colon, the first number."""
    tail = F.when(quote.contains(":"), strip(F.substring_index(quote, ":", -1)))
    number = group0_or(quote, r"[\d][\d.,]*")
    phrases = F.transform(compact(F.array(quote, val, tail, number)), strip)
    return F.filter(phrases, lambda p: F.length(p) >= 2)


def _smallest(spans: Column) -> Column:
    """Smallest box with an area, ``NULL`` when there is none."""
    boxes = F.filter(
        F.transform(
            spans,
            lambda s: F.struct(area_of(s).alias("area"), *(s[k].alias(k) for k in ("x0", "y0", "x1", "y1"))),
        ),
        lambda b: b["area"] > 0,
    )
    return F.array_min(boxes)


def tightened(cands: Column, spans: Column) -> Column:
    """Shrink each candidate's box to the smallest span holding one of its phrases."""

    def one(c: Column) -> Column:
        quote = F.coalesce(F.nullif(strip(c["evidence_text"]), F.lit("")), text_of(c["value"]))

        def fit(phrases: Column) -> Column:
            hits = F.filter(
                spans,
                lambda s: (s["page"] == c["page"])
                & F.exists(phrases, lambda p: F.lower(s["text"]).contains(F.lower(p))),
            )
            return let(
                _smallest(hits),
                lambda box: F.when(
                    c["x0"].isNotNull() & (box["area"] < area_of(c) * TIGHTER),
                    c.withField("x0", box["x0"]).withField("y0", box["y0"]).withField("x1", box["x1"]).withField("y1", box["y1"]),
                ).otherwise(c),
            )

        return let(needle_variants(quote, text_of(c["value"])), fit)

    return F.transform(cands, one)


def tighten_bbox(df: DataFrame, spans: str = "spans") -> DataFrame:
    return df.withColumn(
        "candidates", let(F.col("candidates"), lambda cs: let(F.col(spans), lambda ss: tightened(cs, ss)))
    )


def snippets(blocks: Column, quote: Column, limit: int | None = None) -> Column:
    """All blocks that contain the quote, with their whole text, or the first ``limit`` of them."""
    wanted = F.lower(strip(F.coalesce(quote, F.lit(""))))
    hits = F.filter(blocks, lambda b: F.lower(b["text"]).contains(wanted))
    cut = F.transform(
        hits if limit is None else F.slice(hits, 1, limit),
        lambda b: F.struct(
            b["text"].alias("text"),
            *(b[k].alias(k) for k in ("block_id", "page", "x0", "y0", "x1", "y1")),
        ),
    )
    return F.when(F.length(wanted) >= SNIPPET_CHARS, cut).otherwise(F.slice(cut, 1, 0))


def evidence_snippets(df: DataFrame, quote: str = "quote", key: str = "doc_id") -> DataFrame:
    found = let(F.col("blocks"), lambda bs: snippets(bs, F.col(quote)))
    return df.select(key, quote, F.posexplode(found).alias("snippet_ix", "s")).select(key, quote, "snippet_ix", "s.*")


def realigned(cands: Column, blocks: Column) -> Column:
    """Move a large box to the first block that holds the evidence (or the value), if that one is smaller."""
    return let(haystack(blocks), lambda hay: _realigned(cands, blocks, hay))


def _realigned(cands: Column, blocks: Column, hay: Column) -> Column:
    def find(text: Column) -> Column:
        return let(needle(text), lambda n: F.when(F.length(n) >= VALUE_CHARS, F.get(blocks, block_with(hay, n))))

    def one(c: Column) -> Column:
        boxed = valid_box(c)
        match = F.coalesce(find(c["evidence_text"]), find(text_of(c["value"])))

        def move(m: Column) -> Column:
            better = valid_box(m) & (~boxed | (area_of(m) < area_of(c)))
            moved = (
                c.withField("block_id", m["block_id"])
                .withField("page", F.when(m["page"] > 0, m["page"]).otherwise(c["page"]))
                .withField("x0", m["x0"]).withField("y0", m["y0"]).withField("x1", m["x1"]).withField("y1", m["y1"])
            )
            return F.when(boxed & (area_of(c) < SMALL_AREA), c).when(better, moved).otherwise(c)

        return let(match, move)

    return F.transform(cands, one)


def realign(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "candidates", let(F.col("candidates"), lambda cs: let(F.col("blocks"), lambda bs: realigned(cs, bs)))
    )
