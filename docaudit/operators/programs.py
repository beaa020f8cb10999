"""Cross-field rules and groups as values of the row: one plan for checklists of any number and form.

A checklist's rules and groups travel as a struct next to its fields. Rules are folds over their steps, groups a
``transform`` over their declarations, so the size of the plan does not hang on the catalogue.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docaudit.functions.expressions import (
    PROGRAM_TYPE, TEMPLATE_TYPE, RuleSyntaxError, filled, rule_program, run_program, template_parts,
)
from docaudit.functions.text import compact, let, number_text
from docaudit.functions.values import strict_number
from docaudit.plans.checklist import Checklist, GroupSpec

from . import groups as g
from .blocks import section_blob
from .verdicts import OUTCOMES_TYPE, no_evidence, outcome

CROSS_TYPE = (
    f"struct<id:string,text:string,anchor:string,cited:array<string>,names:array<string>,program:{PROGRAM_TYPE},message:{TEMPLATE_TYPE}>"
)
ROW_RULE_TYPE = f"struct<id:string,text:string,names:array<string>,program:{PROGRAM_TYPE},message:{TEMPLATE_TYPE}>"
GROUP_TYPE = (
    "struct<name:string,hint:string,structure:string,fields:array<struct<name:string,type:string,slug:string,header:string>>,"
    f"gap:double,tolerance:double,rules:array<{ROW_RULE_TYPE}>>"
)
PROGRAMS_TYPE = f"struct<cross:array<{CROSS_TYPE}>,groups:array<{GROUP_TYPE}>>"


# ---- checklists to data ----------------------------------------------------------------------


def programs_row(checklist: Checklist) -> dict:
    """Rules and groups of a checklist that can be evaluated at all."""
    cross = []
    for rule, compiled in checklist.active_cross_rules():
        names, steps = rule_program(rule.expression)
        cross.append(
            {
                "id": rule.id, "text": rule.expression, "anchor": (*rule.fields, *names, "cross_field")[0],
                "cited": list(rule.fields or names), "names": list(names), "program": steps,
                "message": template_parts(rule.message, names),
            }
        )
    return {"cross": cross, "groups": [_group_row(x) for x in checklist.groups if checklist.extended]}


def _group_row(group: GroupSpec) -> dict:
    names = [n for n, _ in group.row_fields]
    rules = []
    for rule in group.row_rules:
        try:
            used, steps = rule_program(rule.expression)
        except RuleSyntaxError:  # fails on every row and shows its text
            rules.append({"id": rule.id, "text": rule.expression, "names": [], "program": [], "message": [{"text": rule.expression}]})
            continue
        if set(used) <= set(names):
            message = template_parts(rule.message, names)
            rules.append({"id": rule.id, "text": rule.expression, "names": list(used), "program": steps, "message": message})
    fields = [
        {
            "name": n, "type": t, "slug": re.sub(r"[^a-z0-9]+", "_", n.strip().lower()).strip("_"),
            "header": n.replace(" ", "_").lower(),
        }
        for n, t in group.row_fields
    ]
    return {
        "name": group.name, "hint": group.section_hint, "structure": group.structure_hint, "fields": fields,
        "gap": group.column_gap_pt, "tolerance": group.row_y_tolerance_pt, "rules": rules,
    }


# ---- evaluation ------------------------------------------------------------------------------


def _evidence_of(found: Column, fields: Column) -> Column:
    """Proof of the named fields, in that order; fields without any are left out."""
    return F.flatten(F.transform(fields, lambda n: F.transform(
        F.filter(found, lambda r: r["field"] == n), lambda r: F.struct(r["field"].alias("field"), r["evidence"].alias("evidence")))))


def cross_outcomes(resolved: Column, rules: Column) -> Column:
    """One outcome per rule whose every name resolved to a number; other rules are skipped."""

    def build(found: Column) -> Column:
        numbers = F.map_from_entries(F.transform(found, lambda r: F.struct(r["field"], r["value"]["num"])))

        def of_rule(nums: Column, rule: Column) -> Column:
            number = lambda n: F.try_element_at(nums, n)
            binding = F.array_join(F.transform(rule["names"], lambda n: F.concat(n, F.lit("="), number_text(number(n)))), ", ")
            judged = let(run_program(rule["program"], number), lambda passed: outcome(
                rule["anchor"], rule["id"], passed, binding,
                F.when(passed, rule["text"]).otherwise(filled(rule["message"], lambda n: number_text(number(n)))),
                _evidence_of(found, rule["cited"]),
            ))
            return F.when(F.forall(rule["names"], lambda n: number(n).isNotNull()), judged)

        return let(numbers, lambda nums: F.transform(rules, lambda rule: of_rule(nums, rule)))

    none = F.array().cast(OUTCOMES_TYPE)
    return F.when(F.coalesce(F.size(rules), F.lit(0)) > 0, compact(let(compact(resolved), build))).otherwise(none)


def typed(tokens: Column, fields: Column) -> Column:
    """Header rows and rows with a bad number vanish; a cell is ``struct(name, num, str)``."""

    def cell(tok: Column, f: Column) -> Column:
        num = F.when(F.coalesce(f["type"] != "string", F.lit(True)), strict_number(tok))
        text = F.when(F.coalesce(f["type"] != "number", F.lit(True)) & num.isNull(), tok)
        return F.struct(f["name"].alias("name"), num.alias("num"), text.alias("str"))

    def row(ts: Column) -> Column:
        plain = F.transform(ts, lambda t: F.lower(F.replace(t, F.lit(" "), F.lit("_"))))
        header = plain == F.transform(fields, lambda f: f["header"])

        def checked(cells: Column) -> Column:
            numbers = F.zip_with(cells, fields, lambda c, f: F.coalesce(f["type"] == "number", F.lit(False)) & c["num"].isNull())
            return F.when(~(header | F.exists(numbers, lambda broken: broken)), cells)

        return let(F.zip_with(ts, fields, cell), checked)

    return compact(F.transform(tokens, row))


def group_rows(blocks: Column, group: Column) -> Column:
    """Typed rows of a group, in document order."""
    hint, fields, structure = group["hint"], group["fields"], group["structure"]
    width = F.size(fields)

    def from_text() -> Column:
        def tokens(blob: Column) -> Column:
            return (
                F.when(structure == "sections", g.section_tokens(blob, F.transform(fields, lambda f: f["slug"])))
                .when(structure == "list", g.list_tokens(blob, hint, width))
                .when(structure == "table", g.table_tokens(blob, width))
                .otherwise(g.plain_tokens(blob, width))
            )

        return typed(let(section_blob(blocks, hint), tokens), fields)

    boxes = F.when(structure == "table", typed(g.box_tokens(blocks, hint, width, group["gap"], group["tolerance"]), fields))
    rows = let(boxes, lambda r: F.when(F.size(r) > 0, r).otherwise(from_text()))
    return F.when((hint != "") & (width > 0), rows).otherwise(F.array().cast(g.ROWS_TYPE))


def row_rule_results(rows: Column, group: Column) -> Column:
    """``array<struct(row_ix, rule, passed, expected, value)>``; a rule that lacks a number is skipped."""

    def of_row(row: Column, ix: Column) -> Column:
        cell = lambda n: F.get(F.filter(row, lambda c: c["name"] == n), F.lit(0))
        shown = lambda n: let(cell(n), lambda c: F.coalesce(c["str"], c["num"].cast("string")))

        def of_rule(rule: Column) -> Column:
            result = let(run_program(rule["program"], lambda n: cell(n)["num"]), lambda passed: F.struct(
                ix.alias("row_ix"), rule["id"].alias("rule"), passed.alias("passed"),
                F.when(passed, rule["text"]).otherwise(filled(rule["message"], shown)).alias("expected"), g.row_text(row).alias("value"),
            ))
            return F.when(F.forall(rule["names"], lambda n: cell(n)["num"].isNotNull()), result)

        return compact(F.transform(group["rules"], of_rule))

    return F.flatten(F.transform(rows, of_row))


def group_outcomes(blocks: Column, groups: Column) -> Column:
    """Row rules of every group; a group without rows fails."""

    def of_group(b: Column, group: Column) -> Column:
        missing = outcome(group["name"], F.lit("group_not_found"), F.lit(False), F.lit(None), F.lit("rows"), no_evidence())

        def results(rows: Column) -> Column:
            return F.transform(row_rule_results(rows, group), lambda r: outcome(
                F.concat(group["name"], F.lit("["), r["row_ix"].cast("string"), F.lit("]")), r["rule"], r["passed"], r["value"], r["expected"], no_evidence()))

        return let(group_rows(b, group), lambda rows: F.when(F.size(rows) == 0, F.array(missing)).otherwise(results(rows)))

    none = F.array().cast(OUTCOMES_TYPE)
    found = let(blocks, lambda b: F.flatten(F.transform(groups, lambda group: of_group(b, group))))
    return F.when(F.coalesce(F.size(groups), F.lit(0)) > 0, found).otherwise(none)

