"""Block enrichment: sections, column bands, serialised views, section bodies.

Functions ending in a Column work on the ``blocks`` array of one row; the DataFrame functions
apply them. None of them shuffles. Folds never grow an array element by element over a whole
document, so the cost per document stays linear in its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.geometry import DEFAULT_PAGE_WIDTH, column_band
from docaudit.functions.text import first_line, let, strip
from docaudit.plans.checklist import GroupSpec
from docaudit.sources.blocks import BLOCKS_TYPE

# Heading heuristics and sparse-text limits.
HEADING_CHARS, HEADING_FONT_STEP, DEFAULT_FONT = 80, 1.5, 10.0
SPARSE_DOCUMENT_CHARS, SPARSE_PAGE_CHARS = 60, 50
HEADER_SLACK = 6
PART_BREAK = "\n\n---\n\n"


def _median(values: Column) -> Column:
    def middle(v: Column) -> Column:
        n = F.size(v)
        low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        return (F.get(v, low) + F.get(v, high)) / 2

    return let(F.sort_array(values), middle)


def _is_heading(block: Column, median: Column) -> Column:
    def test(line: Column) -> Column:
        big = F.coalesce(block["font_size_max"], F.lit(DEFAULT_FONT)) > median + HEADING_FONT_STEP
        caps = (F.length(line) > 2) & line.rlike(r"^[\p{L} ]+$") & (line == F.upper(line)) & (line != F.lower(line))
        return (F.length(line) < HEADING_CHARS) & (big | caps) & ~line.contains(":")

    return let(first_line(block["text"]), test)


def sectioned(blocks: Column) -> Column:
    """Forward-fill section labels: a heading has none, what follows carries its first line.

    The document is cut at its headings and each piece labelled as a whole.
    """
    fonts = F.transform(blocks, lambda b: F.coalesce(F.nullif(b["font_size_max"], F.lit(0.0)), F.lit(DEFAULT_FONT)))

    def cut(median: Column) -> Column:
        heads = F.filter(
            F.transform(blocks, lambda b, i: F.when(_is_heading(b, median), i)), lambda i: i.isNotNull()
        )

        def pieces(starts: Column) -> Column:
            def piece(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(blocks))
                label = F.when(k > 0, first_line(F.get(blocks, start)["text"]))
                return let(
                    label,
                    lambda lb: F.transform(
                        F.slice(blocks, start + 1, end - start),
                        lambda b, j: b.withField("section_label", F.when((k == 0) | (j > 0), lb)),
                    ),
                )

            return F.flatten(F.transform(starts, piece))

        return let(F.concat(F.array(F.lit(0)), heads), pieces)

    return F.when(F.size(blocks) > 0, let(_median(fonts), cut)).otherwise(F.array().cast(BLOCKS_TYPE))


def infer_sections(df: DataFrame) -> DataFrame:
    return df.withColumn("blocks", let(F.col("blocks"), sectioned))


def page_widths(blocks: Column) -> Column:
    """``array<struct<page,width>>``: right-most edge per page."""
    pages = F.sort_array(F.array_distinct(blocks["page"]))
    return F.transform(
        pages,
        lambda p: F.struct(
            p.alias("page"),
            F.coalesce(
                F.nullif(F.array_max(F.filter(blocks, lambda b: b["page"] == p)["x1"]), F.lit(0.0)),
                F.lit(DEFAULT_PAGE_WIDTH),
            ).alias("width"),
        ),
    )


def banded(blocks: Column) -> Column:
    def band(widths: Column) -> Column:
        by_page = F.map_from_entries(widths)
        return let(
            by_page,
            lambda m: F.transform(
                blocks,
                lambda b: b.withField("column_band", column_band(b["x0"], b["x1"], F.element_at(m, b["page"]))),
            ),
        )

    return let(page_widths(blocks), band)


def with_column_band(df: DataFrame) -> DataFrame:
    return df.withColumn("blocks", let(F.col("blocks"), banded))


def text_chars(blocks: Column) -> Column:
    """Characters of all blocks; none where there are no blocks."""
    return F.coalesce(F.aggregate(blocks, F.lit(0), lambda acc, b: acc + F.coalesce(F.length(strip(b["text"])), F.lit(0))), F.lit(0))


def sparse_text(blocks: Column, image_pages: Column) -> Column:
    """Hardly any text in the document, or on a page that holds an image."""

    def thin(p: Column) -> Column:
        return text_chars(F.filter(blocks, lambda b: b["page"] == p)) < SPARSE_PAGE_CHARS

    return (text_chars(blocks) < SPARSE_DOCUMENT_CHARS) | F.coalesce(F.exists(image_pages, thin), F.lit(False))


def sparse_documents(df: DataFrame) -> DataFrame:
    """Flag documents with hardly any text; ``image_pages ARRAY<INT>`` lists pages that hold images."""
    return df.withColumn("text_chars", text_chars(F.col("blocks"))).withColumn("is_sparse", sparse_text(F.col("blocks"), F.col("image_pages")))


def _one_line(text: Column) -> Column:
    return F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit(" / "))


def _point(v: Column) -> Column:
    return F.round(v, 1).cast("string")


def layout_text(blocks: Column, max_blocks: int | None = None, max_chars: int | None = None) -> Column:
    """Blocks with ids and layout marks, page by page from top to bottom; whole unless a limit is given.

    With a budget of characters, a block that does not fit ends its page, and later pages may still add theirs.
    """

    def entry(b: Column) -> Column:
        section = F.when(
            F.coalesce(b["section_label"], F.lit("")) != "",
            F.concat(F.lit(' section="'), b["section_label"], F.lit('"')),
        ).otherwise("")
        box = F.concat(
            F.lit("("), _point(b["x0"]), F.lit(","), _point(b["y0"]), F.lit(")-("),
            _point(b["x1"]), F.lit(","), _point(b["y1"]), F.lit(")"),
        )
        text = F.concat(
            F.lit("["), b["block_id"], F.lit(" p"), b["page"].cast("string"), F.lit(" col="), b["column_band"],
            F.lit(" bbox="), box, section, F.lit("]\n"), _one_line(b["text"]), F.lit("\n"),
        )
        return F.struct(
            b["page"].alias("page"), b["y0"].alias("y0"), b["x0"].alias("x0"), b["block_ix"].alias("ix"),
            text.alias("line"),
        )

    ordered = F.sort_array(F.transform(banded(blocks), entry))
    if max_chars is None and max_blocks is None:
        joined = F.array_join(ordered["line"], "\n")
    else:
        joined = _within_budget(ordered, max_blocks, max_chars)
    return F.when(F.size(blocks) > 0, joined).otherwise("(no text blocks)")


def _within_budget(entries: Column, max_blocks: int | None, max_chars: int | None) -> Column:
    start = F.struct(
        F.lit(0).alias("used"), F.lit(None).cast("int").alias("closed"), F.array().cast("array<string>").alias("lines")
    )

    def add(acc: Column, e: Column) -> Column:
        full = F.lit(False) if max_blocks is None else F.size(acc["lines"]) >= max_blocks
        skipped = F.coalesce(acc["closed"] == e["page"], F.lit(False))
        used = acc["used"] + F.length(e["line"])
        fits = F.lit(True) if max_chars is None else used <= max_chars
        taken = F.struct(used.alias("used"), acc["closed"].alias("closed"), F.concat(acc["lines"], F.array(e["line"])).alias("lines"))
        ended = F.struct(acc["used"].alias("used"), e["page"].alias("closed"), acc["lines"].alias("lines"))
        return F.when(full | skipped, acc).when(fits, taken).otherwise(ended)

    return F.aggregate(entries, start, add, lambda acc: F.array_join(acc["lines"], "\n"))


def index_text(blocks: Column, max_blocks: int | None = None) -> Column:
    """``[id pN] text`` lines of all blocks, or of the first ``max_blocks``."""
    entries = F.transform(
        blocks if max_blocks is None else F.slice(blocks, 1, max_blocks),
        lambda b: F.concat(
            F.lit("["), b["block_id"], F.lit(" p"), b["page"].cast("string"), F.lit("] "), _one_line(b["text"])
        ),
    )
    return F.when(F.size(blocks) > 0, F.array_join(entries, "\n")).otherwise("(no evidence blocks)")


def serialize_layout(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, let(F.col("blocks"), lambda b: layout_text(b)).alias("layout_text"))


def serialize_index(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, let(F.col("blocks"), lambda b: index_text(b)).alias("index_text"))


def document_view(df: DataFrame, markdown: str = "markdown", images: str = "image_text") -> DataFrame:
    """Readable text, image text and block index under one another; blank parts are left out."""

    def part(title: str, body: Column) -> Column:
        text = strip(F.coalesce(body, F.lit("")))
        return F.when(text != "", F.concat(F.lit(f"# {title}\n\n"), text))

    index = F.when(F.size("blocks") > 0, let(F.col("blocks"), lambda b: index_text(b)))
    view = F.concat_ws(
        PART_BREAK,
        part("Document (markdown)", F.col(markdown)),
        part("Embedded images (vision)", F.col(images)),
        F.when(index != "", F.concat(F.lit("# Evidence block index\n\n"), index)),
    )
    return df.withColumn("view", F.when(view != "", view).otherwise(let(F.col("blocks"), lambda b: layout_text(b))))


def text_head(blocks: Column, max_blocks: int | None = None, max_chars: int | None = None) -> Column:
    """Text of all blocks; of the first blocks, or cut to a length, where a limit is given."""
    text = F.array_join((blocks if max_blocks is None else F.slice(blocks, 1, max_blocks))["text"], "\n")
    return text if max_chars is None else F.left(text, F.lit(max_chars))


# ---- sections --------------------------------------------------------------------------------


def reading_order(blocks: Column) -> Column:
    """Blocks from top to bottom; positions are sorted, not whole blocks."""
    return F.transform(_reading_places(blocks), lambda i: F.get(blocks, i))


def _reading_places(blocks: Column) -> Column:
    keyed = F.transform(blocks, lambda b, i: F.struct(b["page"], b["y0"], b["x0"], b["block_ix"], i.alias("at")))
    return F.sort_array(keyed)["at"]


def _hint(hint: str | Column) -> Column:
    """Section hint as it is looked for; a text is a constant, a column differs by row."""
    return F.lit(hint.strip().lower()) if isinstance(hint, str) else F.lower(strip(hint))


def _opens(text: Column, hint: Column) -> Column:
    """Does the block's first line name the section? A block that does not hold the hint at all is not cut into lines."""
    named = let(
        F.lower(first_line(text)),
        lambda line: line.contains(hint) & (F.length(line) <= F.length(hint) + HEADER_SLACK),
    )
    return F.when(~F.lower(text).contains(hint), F.lit(False)).otherwise(named)


def _header(texts: Column, hint: Column) -> Column:
    """Position, from 1, of the first of these texts that opens the section; NULL when none does."""
    return F.array_min(F.transform(texts, lambda t, i: F.when(_opens(t, hint), i + 1)))


def _mentions(block: Column, hint: Column) -> Column:
    return F.lower(F.coalesce(block["section_label"], F.lit(""))).contains(hint) | F.lower(block["text"]).contains(hint)


def section_body(blocks: Column, hint: str | Column) -> Column:
    """Blocks below the section header to the end of the document, header lines left out.

    Without a header the blocks that mention the section stand in.
    """
    hint = _hint(hint)

    def body(ordered: Column) -> Column:
        below = F.slice(ordered, _header(ordered["text"], hint) + 1, F.size(ordered))
        return F.coalesce(F.filter(below, lambda b: ~_opens(b["text"], hint)), F.array().cast(BLOCKS_TYPE))

    found = let(reading_order(blocks), body)
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.filter(blocks, lambda b: _mentions(b, hint))))


def section_blob(blocks: Column, hint: str | Column) -> Column:
    """Text of the section with its header lines."""
    hint = _hint(hint)

    def tail(texts: Column) -> Column:
        return F.array_join(F.slice(texts, _header(texts, hint), F.size(texts)), "\n")

    fallback = F.array_join(F.filter(blocks, lambda b: _mentions(b, hint))["text"], "\n")
    ordered = F.transform(_reading_places(blocks), lambda i: F.get(blocks, i)["text"])
    return F.coalesce(let(ordered, tail), fallback)


def section_blocks(df: DataFrame, group: GroupSpec, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.inline(let(F.col("blocks"), lambda b: section_body(b, group.section_hint))))


def section_text(df: DataFrame, group: GroupSpec, key: str = "doc_id") -> DataFrame:
    return df.select(key, let(F.col("blocks"), lambda b: section_blob(b, group.section_hint)).alias("section_text"))


def choose_granularity(specs: DataFrame) -> DataFrame:
    """Span or layout blocks per checklist, from ``(spec_id, version, structure_hint)`` group rows."""
    hint = F.lower(F.coalesce("structure_hint", F.lit("")))
    return (
        specs.groupBy("spec_id", "version")
        .agg(
            F.bool_or(hint.isin("list", "sections")).alias("needs_lines"),
            F.bool_or(hint == "table").alias("has_table"),
        )
        .select(
            "spec_id",
            F.when((F.col("version") == "2") & ~F.col("needs_lines") & F.col("has_table"), "spans")
            .otherwise("layout")
            .alias("granularity"),
        )
    )
