"""Repeating groups: rows of a document section, typed and checked.

All strategies work inside the document row. The only sequential step, clustering spans into text
rows by an anchor, runs within runs of spans that have no wide gap, which are short.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.expressions import RuleSyntaxError, compile_rule, interpolate
from docaudit.functions.text import let, lines, number_text, slug, strip, trimmed, words
from docaudit.functions.values import strict_number
from docaudit.plans.checklist import GroupSpec, RowRule

from .blocks import reading_order, section_blob, section_body

TOKENS_TYPE = "array<array<string>>"
CELL_TYPE = "struct<name:string,num:double,str:string>"
ROWS_TYPE = f"array<array<{CELL_TYPE}>>"


def _no_tokens() -> Column:
    return F.array().cast(TOKENS_TYPE)


def _kept_lines(blob: Column) -> Column:
    return F.filter(F.transform(lines(blob), trimmed), lambda t: t != "")


def _not_comment(ls: Column) -> Column:
    return F.filter(ls, lambda t: ~t.startswith("#"))


def line_tokens(line: Column, width: int | Column, pipes: bool) -> Column:
    """Tokens of a line with exactly ``width`` cells, NULL otherwise."""
    blanks = let(words(line), lambda p: F.when(F.size(p) == width, p))
    if not pipes:
        return blanks
    cells = let(
        F.filter(F.transform(F.split(line, r"\|"), strip), lambda p: p != ""),
        lambda p: F.when(F.size(p) == width, p),
    )
    return F.coalesce(F.when(line.contains("|"), cells), blanks)


def tokens_of_lines(ls: Column, width: int | Column, pipes: bool) -> Column:
    return F.filter(F.transform(_not_comment(ls), lambda t: line_tokens(t, width, pipes)), lambda t: t.isNotNull())


def glued_lines(blob: Column, hint: str | Column, width: int | Column) -> Column:
    """Rows recovered from one long line behind the section hint."""
    hint, width = (F.lit(x) if not isinstance(x, Column) else x for x in (hint, width))
    pattern = F.concat(F.lit(r"(?U)\S+"), F.repeat(F.lit(r"\s+[\d.]+"), width - 1))

    def recover(tail: Column) -> Column:
        rows = F.transform(F.regexp_extract_all(tail, pattern, F.lit(0)), strip)
        return F.when(width < 2, F.array().cast("array<string>")).when(tail.contains("\n"), _kept_lines(tail)).otherwise(rows)

    at = F.instr(F.lower(blob), hint)
    tail = F.when(at > 0, strip(F.substring(blob, at + F.length(hint), F.length(blob)))).otherwise("")
    return let(tail, recover)


def list_tokens(blob: Column, hint: str | Column, n: int | Column) -> Column:
    """White-space rows; when no line has the right width, rows glued into one line."""

    def read(pairs: Column) -> Column:
        fitting = F.filter(pairs, lambda p: p["tokens"].isNotNull())
        rows = F.filter(fitting, lambda p: ~p["line"].startswith("#"))["tokens"]
        return F.when(F.size(fitting) > 0, rows).otherwise(
            tokens_of_lines(glued_lines(blob, hint, n), n, False)
        )

    split_up = F.transform(
        _kept_lines(blob), lambda t: F.struct(t.alias("line"), line_tokens(t, n, False).alias("tokens"))
    )
    return let(split_up, read)


def table_tokens(blob: Column, width: int | Column) -> Column:
    return tokens_of_lines(_kept_lines(blob), width, True)


def plain_tokens(blob: Column, width: int | Column) -> Column:
    return tokens_of_lines(_kept_lines(blob), width, False)


def baselines(blocks: Column, tol: float | Column) -> Column:
    """Blocks in reading order cut into text rows: a block joins while it is within ``tol`` of the
    first block of the row. A new page always opens a row.

    Two neighbours further apart than ``tol`` always separate rows, so the anchored walk is only
    needed inside such runs.
    """
    ordered = let(blocks, reading_order)

    def cut(bs: Column) -> Column:
        gaps = F.filter(
            F.transform(
                bs,
                lambda b, i: F.when(
                    (i == 0) | (F.get(bs, i - 1)["page"] != b["page"]) | (b["y0"] - F.get(bs, i - 1)["y0"] > tol), i
                ),
            ),
            lambda i: i.isNotNull(),
        )

        def runs(starts: Column) -> Column:
            return F.transform(
                starts, lambda s, k: F.slice(bs, s + 1, F.coalesce(F.get(starts, k + 1), F.size(bs)) - s)
            )

        return F.flatten(F.transform(let(gaps, runs), lambda run: let(run, anchored)))

    def anchored(run: Column) -> Column:
        zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))

        def step(acc: Column, x: Column) -> Column:
            joins = F.coalesce(F.abs(x["y"] - acc["anchor"]) <= tol, F.lit(False))
            return F.when(joins, acc).otherwise(
                F.struct(x["y"].alias("anchor"), F.concat(acc["starts"], F.array(x["i"])).alias("starts"))
            )

        marks = F.aggregate(
            F.transform(run, lambda b, i: F.struct(b["y0"].alias("y"), i.alias("i"))), zero, step, lambda a: a["starts"]
        )
        return let(
            marks,
            lambda st: F.transform(
                st, lambda s, k: F.slice(run, s + 1, F.coalesce(F.get(st, k + 1), F.size(run)) - s)
            ),
        )

    return let(ordered, cut)


def cells(row: Column, gap: float | Column) -> Column:
    """Texts of a row joined into cells; a horizontal gap wider than ``gap`` opens the next cell."""
    spans = F.filter(
        F.sort_array(
            F.transform(
                row,
                lambda b: F.struct(
                    b["x0"].alias("x0"), b["y0"].alias("y0"), b["block_ix"].alias("ix"), b["x1"].alias("x1"),
                    strip(b["text"]).alias("text"),
                ),
            )
        ),
        lambda s: s["text"] != "",
    )
    zero = F.struct(
        F.lit(None).cast("double").alias("right"), F.lit("").alias("open"), F.array().cast("array<string>").alias("done")
    )

    def step(acc: Column, s: Column) -> Column:
        opens = F.coalesce(s["x0"] - acc["right"] > gap, F.lit(False))
        return (
            F.when(acc["right"].isNull(), F.struct(s["x1"].alias("right"), s["text"].alias("open"), acc["done"].alias("done")))
            .when(
                opens,
                F.struct(
                    s["x1"].alias("right"), s["text"].alias("open"),
                    F.concat(acc["done"], F.array(acc["open"])).alias("done"),
                ),
            )
            .otherwise(
                F.struct(
                    F.greatest(acc["right"], s["x1"]).alias("right"),
                    F.concat(acc["open"], F.lit(" "), s["text"]).alias("open"), acc["done"].alias("done"),
                )
            )
        )

    return F.aggregate(
        spans, zero, step,
        lambda a: F.when(a["right"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))),
    )


def box_tokens(blocks: Column, hint: str | Column, n: int | Column, gap: float | Column, tol: float | Column) -> Column:
    """Rows from the geometry of the section's blocks."""
    rows = let(
        let(blocks, lambda b: section_body(b, hint)),
        lambda body: baselines(body, tol),
    )
    return F.filter(F.transform(rows, lambda r: cells(r, gap)), lambda t: F.size(t) == n)


def section_tokens(blob: Column, slugs: Column) -> Column:
    """One row per paragraph of ``label: value`` (or ``label value``) lines that names every field."""

    def pair(line: Column) -> Column:
        colon = line.contains(":")
        left = F.when(colon, F.substring_index(line, ":", 1)).otherwise(F.get(words(line), F.lit(0)))
        right = F.when(colon, F.substring(line, F.instr(line, ":") + 1, F.length(line))).otherwise(
            F.substring(line, F.length(F.get(words(line), F.lit(0))) + 1, F.length(line))
        )
        usable = colon | (F.size(words(line)) >= 2)
        return F.when(usable, F.struct(slug(left).alias("k"), strip(right).alias("v")))

    def paragraph(p: Column) -> Column:
        pairs = F.filter(F.transform(_not_comment(_kept_lines(p)), pair), lambda x: x.isNotNull())

        def row(ps: Column) -> Column:
            picked = F.transform(slugs, lambda s: F.try_element_at(F.filter(ps, lambda x: x["k"] == s)["v"], F.lit(-1)))
            return let(picked, lambda t: F.when(F.forall(t, lambda v: v.isNotNull()), t))

        return let(pairs, row)

    paragraphs = F.filter(F.transform(F.split(blob, r"(?U)\n\s*\n+"), strip), lambda p: p != "")
    return F.filter(F.transform(paragraphs, paragraph), lambda t: t.isNotNull())


def group_tokens(blocks: Column, group: GroupSpec) -> Column:
    """Token rows by the declared structure. Tables try the geometry first, then the text."""
    if not group.section_hint or not group.row_fields:
        return _no_tokens()
    blob, n = let(blocks, lambda b: section_blob(b, group.section_hint)), len(group.row_fields)
    if group.structure_hint == "sections":
        names = F.array(*(F.lit(re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")) for name, _ in group.row_fields))
        return let(blob, lambda s: section_tokens(s, names))
    if group.structure_hint == "list":
        return let(blob, lambda s: list_tokens(s, group.section_hint, n))
    return let(blob, lambda s: (table_tokens if group.structure_hint == "table" else plain_tokens)(s, n))


def typed(tokens: Column, group: GroupSpec) -> Column:
    """Header rows and rows with a bad number vanish; a cell is ``struct(name, num, str)``."""
    names = [n for n, _ in group.row_fields]

    def plain(t: Column) -> Column:
        return F.lower(F.replace(t, F.lit(" "), F.lit("_")))

    def row(ts: Column) -> Column:
        is_header = F.lit(True)
        out = []
        for i, (name, typ) in enumerate(group.row_fields):
            tok = F.get(ts, F.lit(i))
            is_header = is_header & (plain(tok) == name.replace(" ", "_").lower())

            def cell(num: Column, name: str = name, typ: str | None = typ, tok: Column = tok) -> Column:
                text = F.lit(None).cast("string") if typ == "number" else F.when(num.isNull(), tok)
                return F.struct(F.lit(name).alias("name"), num.alias("num"), text.alias("str"))

            out.append(cell(F.lit(None).cast("double")) if typ == "string" else let(strict_number(tok), cell))

        def whole(cs: Column) -> Column:
            broken = F.lit(False)
            for i, (_, typ) in enumerate(group.row_fields):
                if typ == "number":
                    broken = broken | F.get(cs, F.lit(i))["num"].isNull()
            return F.when(~(is_header | broken), cs)

        return let(F.array(*out), whole)

    if not names:
        return F.array().cast(ROWS_TYPE)
    return F.filter(F.transform(tokens, row), lambda r: r.isNotNull())


def group_rows(blocks: Column, group: GroupSpec) -> Column:
    """Typed rows of a group, in document order."""
    text_rows = typed(group_tokens(blocks, group), group)
    if group.structure_hint != "table" or not group.section_hint or not group.row_fields:
        return text_rows
    boxes = box_tokens(blocks, group.section_hint, len(group.row_fields), group.column_gap_pt, group.row_y_tolerance_pt)
    return let(typed(boxes, group), lambda r: F.when(F.size(r) > 0, r).otherwise(text_rows))


def row_text(row: Column) -> Column:
    """``name=value`` list of a row, for the ledger."""
    return F.array_join(
        F.transform(row, lambda c: F.concat(c["name"], F.lit("="), F.coalesce(c["str"], number_text(c["num"])))), ", "
    )


def row_rule_results(rows: Column, group: GroupSpec) -> Column:
    """``array<struct(row_ix, rule, passed, expected)>``; a rule that lacks a number is skipped."""
    names = [n for n, _ in group.row_fields]

    def of_row(row: Column, ix: Column) -> Column:
        cell = {n: F.get(row, F.lit(i)) for i, n in enumerate(names)}
        shown = {n: F.coalesce(c["str"], c["num"].cast("string")) for n, c in cell.items()}
        results = []
        for rule in group.row_rules:
            applies, passed = F.lit(True), F.lit(False)
            try:
                compiled = compile_rule(rule.expression)
            except RuleSyntaxError:
                compiled = None
            if compiled is not None:
                if not set(compiled.names) <= set(names):
                    continue
                for n in compiled.names:
                    applies = applies & cell[n]["num"].isNotNull()
                passed = compiled.column(lambda n: cell[n]["num"])

            def result(p: Column, rule: RowRule = rule, compiled: object = compiled) -> Column:
                text = F.lit(rule.expression)
                if compiled is not None:
                    text = F.when(p, text).otherwise(interpolate(rule.message, shown))
                return F.struct(
                    ix.alias("row_ix"), F.lit(rule.id).alias("rule"), p.alias("passed"), text.alias("expected"),
                    row_text(row).alias("value"),
                )

            results.append(F.when(applies, let(passed, result)))
        none = F.array().cast("array<struct<row_ix:int,rule:string,passed:boolean,expected:string,value:string>>")
        return F.filter(F.array(*results), lambda r: r.isNotNull()) if results else none

    return F.flatten(F.transform(rows, of_row))


# ---- table operators -------------------------------------------------------------------------


def rows_table(df: DataFrame, group: GroupSpec, key: str = "doc_id") -> DataFrame:
    """``(key, group, row_ix, field, num, str)`` in long form."""
    rows = let(F.col("blocks"), lambda b: group_rows(b, group))
    return (
        df.select(key, F.posexplode(rows).alias("row_ix", "row"))
        .select(key, F.lit(group.name).alias("group"), "row_ix", F.inline("row"))
        .withColumnRenamed("name", "field")
    )


def row_rule_outcomes(df: DataFrame, group: GroupSpec, key: str = "doc_id") -> DataFrame:
    rows = let(F.col("blocks"), lambda b: group_rows(b, group))
    return df.select(key, F.inline(let(rows, lambda r: row_rule_results(r, group)))).withColumn(
        "field", F.concat(F.lit(group.name + "["), F.col("row_ix").cast("string"), F.lit("]"))
    )


def groups_not_found(df: DataFrame, group: GroupSpec, key: str = "doc_id") -> DataFrame:
    rows = let(F.col("blocks"), lambda b: group_rows(b, group))
    return df.select(key, F.size(rows).alias("n_rows")).filter("n_rows = 0").select(
        key, F.lit(group.name).alias("field"), F.lit("group_not_found").alias("rule")
    )
