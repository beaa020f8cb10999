"""Documents to positioned text blocks.

A document stays one row with ``blocks ARRAY<STRUCT>``: uploads are limited to 30 MiB (see
``sources.uploads``), so the array is bounded and every later per-document step is a narrow
projection without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.geometry import DEFAULT_PAGE_HEIGHT
from docaudit.functions.text import blank_to_null, exploding, first, let, lines, strip, trimmed

BLOCK_TYPE = (
    "struct<block_ix:int,block_id:string,page:int,x0:double,y0:double,x1:double,y1:double,"
    "text:string,section_label:string,font_size_max:double>"
)
BLOCKS_TYPE = f"array<{BLOCK_TYPE}>"

# Geometry given to plain text: a fixed-pitch page, one line per block.
CHAR_WIDTH, LINE_HEIGHT, FONT_SIZE = 6.0, 12.0, 10.0


def block(
    ix: Column, page: Column, box: tuple[Column, Column, Column, Column], text: Column,
    label: Column | None = None, font: Column | None = None, prefix: str = "b",
) -> Column:
    null = F.lit(None)
    return F.struct(
        ix.cast("int").alias("block_ix"),
        F.concat(F.lit(prefix), ix.cast("string")).alias("block_id"),
        page.cast("int").alias("page"),
        *(v.cast("double").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), box)),
        text.alias("text"),
        (null if label is None else label).cast("string").alias("section_label"),
        (null if font is None else font).cast("double").alias("font_size_max"),
    )


def text_blocks(text: Column, sep: str = "\n", prefix: str = "b") -> Column:
    """Split text into blocks; blank pieces vanish before numbering; form feeds turn pages. A text that is NULL has no blocks."""
    pieces = F.flatten(
        F.transform(
            F.split(text, "\f"),
            lambda page, p: F.transform(
                F.split(page, sep),
                lambda t, n: F.struct((p + 1).alias("page"), n.alias("line"), trimmed(t).alias("text")),
            ),
        )
    )

    def place(piece: Column, ix: Column) -> Column:
        top = piece["line"] * F.lit(LINE_HEIGHT)
        widest = F.array_max(F.transform(lines(piece["text"]), F.length)) * F.lit(CHAR_WIDTH)
        box = (F.lit(0.0), top, widest, top + LINE_HEIGHT)
        return block(ix, piece["page"], box, piece["text"], font=F.lit(FONT_SIZE), prefix=prefix)

    placed = F.transform(F.filter(pieces, lambda p: p["text"] != ""), place)
    return F.coalesce(placed, F.array().cast(BLOCKS_TYPE))


def blocks_from_text(df: DataFrame, text: str = "text", sep: str = "\n") -> DataFrame:
    """Add ``blocks`` to a table of documents."""
    return df.withColumn("blocks", text_blocks(F.col(text), sep))


def explode_blocks(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per block, flat columns, for joins and for storage."""
    return df.select(key, F.inline(exploding(F.col("blocks"))))


# ---- layout JSON -----------------------------------------------------------------------------

_PROV = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>"
_CELLS = "array<string>"
LAYOUT_TYPE = (
    "struct<"
    f"texts:array<struct<text:string,orig:string,label:string,prov:{_PROV}>>,"
    f"tables:array<struct<data:{_CELLS},grid:{_CELLS},prov:{_PROV}>>,"
    f"pictures:array<struct<captions:array<string>,prov:{_PROV}>>,"
    f"spans:array<struct<text:string,size:double,prov:{_PROV}>>,"
    "pages:map<string,struct<page_no:int,size:struct<height:double>>>>"
)


def read_layout(df: DataFrame, body: str = "layout") -> DataFrame:
    """Parse the layout JSON with an explicit schema (no inference pass over the data)."""
    return df.withColumn("layout", F.from_json(F.col(body), LAYOUT_TYPE))


def page_heights(pages: Column) -> Column:
    """Height per page number; the entry's own number wins over its key, the last one over earlier."""
    entries = F.transform(
        F.map_entries(pages),
        lambda e: F.struct(
            F.coalesce(F.nullif(e["value"]["page_no"], F.lit(0)), e["key"].try_cast("int")).alias("page"),
            F.coalesce(F.nullif(e["value"]["size"]["height"], F.lit(0.0)), F.lit(DEFAULT_PAGE_HEIGHT)).alias("height"),
        ),
    )
    return F.coalesce(entries, F.array().cast("array<struct<page:int,height:double>>"))


def _height_at(heights: Column, page: Column) -> Column:
    hits = F.filter(heights, lambda x: x["page"] == page)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["height"]).otherwise(F.lit(DEFAULT_PAGE_HEIGHT))


def flipped_box(bbox: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    def side(k: str) -> Column:
        return F.coalesce(bbox[k], F.lit(0.0))

    return side("l"), height - side("t"), side("r"), height - side("b")


def flip_bbox(df: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Table form: ``df(key, page, l, t, r, b)`` joined with ``pages(key, page, height)``."""
    h = F.coalesce(F.col("height"), F.lit(DEFAULT_PAGE_HEIGHT))
    return (
        df.join(pages, [key, "page"], "left")
        .withColumns(
            {"x0": F.col("l"), "y0": h - F.col("t"), "x1": F.col("r"), "y1": h - F.col("b")}
        )
        .drop("l", "t", "r", "b", "height")
    )


def table_cells_text(rows: Column) -> Column:
    """Cells of a row joined by `` | ``, rows by newline; a row may also be an object with text/value."""

    def row_text(raw: Column) -> Column:
        cells = F.from_json(raw, "array<string>")
        entry = F.from_json(raw, "struct<text:string,value:string>")
        joined = F.array_join(F.filter(F.transform(cells, strip), lambda c: c != ""), " | ")
        single = F.coalesce(blank_to_null(entry["text"]), blank_to_null(entry["value"]))
        return F.when(F.substring(raw, 1, 1) == "[", blank_to_null(joined)).otherwise(single)

    return F.array_join(F.filter(F.transform(rows, row_text), lambda t: t.isNotNull()), "\n")


def _is_list(cells: Column) -> Column:
    return F.coalesce(F.size(cells) > 0, F.lit(False))


def layout_blocks(layout: Column) -> Column:
    """Text items, then tables; only items with a position and some text; ids over what is kept."""
    texts = F.transform(
        layout["texts"],
        lambda t: F.struct(
            strip(F.coalesce(F.nullif(t["text"], F.lit("")), t["orig"], F.lit(""))).alias("text"),
            F.nullif(t["label"], F.lit("")).alias("label"),
            first(t["prov"]).alias("prov"),
        ),
    )
    tables = F.transform(
        layout["tables"],
        lambda t: F.struct(
            strip(table_cells_text(F.when(_is_list(t["data"]), t["data"]).otherwise(t["grid"]))).alias("text"),
            F.lit("table").alias("label"),
            first(t["prov"]).alias("prov"),
        ),
    )
    empty = F.array().cast(f"array<struct<text:string,label:string,prov:{_PROV[len('array<'):-1]}>>")
    kept = F.filter(
        F.concat(F.coalesce(texts, empty), F.coalesce(tables, empty)),
        lambda i: i["prov"].isNotNull() & (F.coalesce(i["text"], F.lit("")) != ""),
    )

    def place(item: Column, ix: Column, heights: Column) -> Column:
        page = F.coalesce(F.nullif(item["prov"]["page_no"], F.lit(0)), F.lit(1))
        return block(ix, page, flipped_box(item["prov"]["bbox"], _height_at(heights, page)), item["text"], item["label"])

    return let(
        page_heights(layout["pages"]),
        lambda heights: F.transform(kept, lambda item, ix: place(item, ix, heights)),
    )


def layout_spans(layout: Column) -> Column:
    """Finer blocks, one per text span, numbered ``s0..``."""
    kept = F.filter(
        layout["spans"], lambda s: first(s["prov"]).isNotNull() & (strip(F.coalesce(s["text"], F.lit(""))) != "")
    )

    def place(span: Column, ix: Column, heights: Column) -> Column:
        prov = first(span["prov"])
        page = F.coalesce(prov["page_no"], F.lit(1))
        box = flipped_box(prov["bbox"], _height_at(heights, page))
        return block(ix, page, box, strip(span["text"]), font=span["size"], prefix="s")

    placed = let(page_heights(layout["pages"]), lambda h: F.transform(kept, lambda s, ix: place(s, ix, h)))
    return F.coalesce(placed, F.array().cast(BLOCKS_TYPE))


def layout_pictures(layout: Column) -> Column:
    """Picture references; ``img{i}`` counts skipped pictures too."""

    def refer(pic: Column, ix: Column, heights: Column) -> Column:
        prov = first(pic["prov"])
        page = F.coalesce(F.nullif(prov["page_no"], F.lit(0)), F.lit(1))
        x0, y0, x1, y1 = flipped_box(prov["bbox"], _height_at(heights, page))
        ref = F.struct(
            F.concat(F.lit("img"), ix.cast("string")).alias("picture_id"),
            page.alias("page"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
            F.nullif(first(pic["captions"]), F.lit("")).alias("caption"),
        )
        return F.when(prov.isNotNull(), ref)

    refs = let(
        page_heights(layout["pages"]),
        lambda h: F.transform(layout["pictures"], lambda p, ix: refer(p, ix, h)),
    )
    return F.filter(refs, lambda r: r.isNotNull())


def blocks_from_layout_json(df: DataFrame, body: str = "layout") -> DataFrame:
    parsed = F.from_json(F.col(body), LAYOUT_TYPE)
    return df.withColumn("blocks", let(parsed, layout_blocks))


def spans_from_layout_json(df: DataFrame, body: str = "layout") -> DataFrame:
    parsed = F.from_json(F.col(body), LAYOUT_TYPE)
    return df.withColumn("spans", let(parsed, layout_spans))


def pictures_from_layout_json(df: DataFrame, body: str = "layout", key: str = "doc_id") -> DataFrame:
    parsed = F.from_json(F.col(body), LAYOUT_TYPE)
    return df.select(key, F.inline(let(parsed, layout_pictures)))
