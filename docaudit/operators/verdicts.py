"""Rules on resolved values, the outcome ledger and the PASS / FAIL / AMBIGUOUS verdict.

An outcome is ``struct(field, rule, passed, value, expected, evidence)`` where evidence lists the
proof per field, so single-field and cross-field outcomes have one shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.expressions import interpolate_numbers
from docaudit.functions.text import compact, let, number_text
from docaudit.functions.values import text_of
from docaudit.plans.checklist import Checklist

from .groups import group_rows, row_rule_results

EVIDENCE_TYPE = (
    "struct<text:string,block_id:string,page:int,x0:double,y0:double,x1:double,y1:double,section_label:string>"
)
OUTCOME_TYPE = (
    "struct<field:string,rule:string,passed:boolean,value:string,expected:string,"
    f"evidence:array<struct<field:string,evidence:{EVIDENCE_TYPE}>>>"
)
OUTCOMES_TYPE = f"array<{OUTCOME_TYPE}>"
RESOLVED_TYPE = f"array<struct<field:string,value:struct<num:double,str:string>,evidence:{EVIDENCE_TYPE}>>"

# Slack of the bounds and ledger order of the rules.
BOUND_SLACK = 1e-9
RULE_ORDER = {"required": 0, "type_check": 1, "range_validation": 2, "group_not_found": 5}
OTHER_RULES = 9


def rule_order(rule: Column) -> Column:
    table = F.create_map(*(x for k, v in RULE_ORDER.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, rule), F.lit(OTHER_RULES))


def outcome(field: Column, rule: Column, passed: Column, value: Column, expected: Column, evidence: Column) -> Column:
    return F.struct(
        field.alias("field"), rule.alias("rule"), passed.alias("passed"), value.cast("string").alias("value"),
        expected.cast("string").alias("expected"), evidence.alias("evidence"),
    ).cast(OUTCOME_TYPE)


def no_evidence() -> Column:
    return F.array().cast(f"array<struct<field:string,evidence:{EVIDENCE_TYPE}>>")


def _proof(r: Column) -> Column:
    return F.when(
        r.isNotNull(), F.array(F.struct(r["field"].alias("field"), r["evidence"].alias("evidence")))
    ).otherwise(no_evidence())


def merge_evidence(resolved: Column, fields: Sequence[str]) -> Column:
    """Proof of several fields, in the order asked for; fields without any are left out."""
    parts = [F.filter(resolved, lambda r: r["field"] == f) for f in fields]
    return F.transform(
        F.concat(*parts), lambda r: F.struct(r["field"].alias("field"), r["evidence"].alias("evidence"))
    ) if parts else no_evidence()


def bounds_text(lo: Column, hi: Column) -> Column:
    both = compact(F.array(number_text(lo), number_text(hi)))
    return F.when(F.size(both) > 0, F.concat(F.lit("["), F.array_join(both, ", "), F.lit("]")))


def within(num: Column, lo: Column, hi: Column) -> Column:
    """Inclusive bounds; a missing bound does not bind."""
    return F.coalesce(num + BOUND_SLACK >= lo, F.lit(True)) & F.coalesce(num - BOUND_SLACK <= hi, F.lit(True))


def field_outcomes(resolved: Column, fields: Column, rules: Column) -> Column:
    """required, type_check and range_validation over aligned ``resolved`` and ``fields`` arrays."""

    def required(r: Column, f: Column) -> Column:
        return F.when(
            F.array_contains(rules, "required") & f["required"],
            outcome(f["name"], F.lit("required"), r.isNotNull(), text_of(r["value"]), F.lit("present"), _proof(r)),
        )

    def typed(r: Column, f: Column) -> Column:
        return F.when(
            F.array_contains(rules, "type_check") & r.isNotNull() & (f["type"] == "number"),
            outcome(
                f["name"], F.lit("type_check"), r["value"]["num"].isNotNull(), text_of(r["value"]), F.lit("number"), _proof(r)
            ),
        )

    def ranged(r: Column, f: Column) -> Column:
        num = r["value"]["num"]
        bounded = f["min"].isNotNull() | f["max"].isNotNull()
        return F.when(
            F.array_contains(rules, "range_validation") & (f["type"] == "number") & num.isNotNull() & bounded,
            outcome(
                f["name"], F.lit("range_validation"), within(num, f["min"], f["max"]), number_text(num),
                bounds_text(f["min"], f["max"]), _proof(r),
            ),
        )

    return compact(F.flatten(F.array(*(F.zip_with(resolved, fields, rule) for rule in (required, typed, ranged)))))


def cross_field_outcomes(resolved: Column, checklist: Checklist) -> Column:
    """One outcome per rule whose every name resolved to a number; other rules are skipped."""
    found = compact(resolved)

    def build(nums: Column) -> Column:
        out = []
        for rule, compiled in checklist.active_cross_rules():
            def number(name: str) -> Column:
                return F.try_element_at(nums, F.lit(name))

            applies = F.lit(True)
            for n in compiled.names:
                applies = applies & number(n).isNotNull()
            passed = compiled.column(number)
            cited = rule.fields or compiled.names
            anchor = rule.fields[0] if rule.fields else (compiled.names[0] if compiled.names else "cross_field")
            binding = F.concat_ws(", ", *(F.concat(F.lit(f"{n}="), number_text(number(n))) for n in compiled.names))
            expected = F.when(passed, F.lit(rule.expression)).otherwise(
                interpolate_numbers(rule.message, {n: number(n) for n in compiled.names})
            )
            out.append(
                F.when(
                    applies,
                    outcome(F.lit(anchor), F.lit(rule.id), passed, binding, expected, merge_evidence(found, cited)),
                )
            )
        return compact(F.array(*out))

    if not checklist.active_cross_rules():
        return F.array().cast(OUTCOMES_TYPE)
    numbers = F.map_from_entries(F.transform(found, lambda r: F.struct(r["field"], r["value"]["num"])))
    return let(numbers, build)


def group_outcomes(blocks: Column, checklist: Checklist) -> Column:
    """Row rules of every group; a group without rows fails."""
    parts = []
    for g in checklist.groups if checklist.extended else ():
        missing = outcome(
            F.lit(g.name), F.lit("group_not_found"), F.lit(False), F.lit(None), F.lit("rows"), no_evidence()
        )

        def results(rows: Column) -> Column:
            return F.transform(
                row_rule_results(rows, g),
                lambda r: outcome(
                    F.concat(F.lit(g.name + "["), r["row_ix"].cast("string"), F.lit("]")), r["rule"], r["passed"],
                    r["value"], r["expected"], no_evidence(),
                ),
            )

        parts.append(
            let(
                let(blocks, lambda b: group_rows(b, g)),
                lambda rows: F.when(F.size(rows) == 0, F.array(missing)).otherwise(results(rows)),
            )
        )
    return F.concat(*parts) if parts else F.array().cast(OUTCOMES_TYPE)


def sorted_ledger(outcomes: Column) -> Column:
    """Ledger order: field, then rule rank, then the order in which the rules ran."""
    keyed = F.transform(
        outcomes,
        lambda o, i: F.struct(o["field"].alias("f"), rule_order(o["rule"]).alias("r"), i.alias("i")),
    )
    return F.transform(F.sort_array(keyed), lambda k: F.get(outcomes, k["i"]))


def passes(outcomes: Column) -> Column:
    return F.forall(outcomes, lambda o: o["passed"])


def merge_evaluation(status: Column, evaluations: Column) -> Column:
    """Bring open-ended evaluations, in order, into a verdict.

    ``fail`` fails at once. ``ambiguous`` on a PASS ends the walk, hiding a later ``fail``; on other
    verdicts it is passed over.
    """
    first_hit = F.get(
        F.filter(evaluations, lambda e: (e == "fail") | ((e == "ambiguous") & (status == "PASS"))), F.lit(0)
    )
    return F.when(first_hit == "fail", "FAIL").when(first_hit == "ambiguous", "AMBIGUOUS").otherwise(status)


# ---- over flat tables ------------------------------------------------------------------------


def rule_required(resolved: DataFrame, docs: DataFrame, checklist: Checklist, key: str = "doc_id") -> DataFrame:
    """Flat form: ``resolved(key, field, value_num, value_str)``."""
    wanted = [f.name for f in checklist.fields if f.required]
    grid = docs.select(key, F.explode(F.array(*map(F.lit, wanted)).cast("array<string>")).alias("field"))
    return grid.join(resolved, [key, "field"], "left").select(
        key, "field", F.lit("required").alias("rule"),
        (F.col("value_num").isNotNull() | F.col("value_str").isNotNull()).alias("passed"),
    )


def _per_field(checklist: Checklist, attribute: str, typ: str) -> Column:
    pairs = [(f.name, getattr(f, attribute)) for f in checklist.fields]
    table = F.map_from_arrays(
        F.array(*(F.lit(n) for n, _ in pairs)), F.array(*(F.lit(v).cast(typ) for _, v in pairs))
    )
    return F.try_element_at(table, F.col("field"))


def rule_type(resolved: DataFrame, checklist: Checklist, key: str = "doc_id") -> DataFrame:
    return resolved.filter(_per_field(checklist, "type", "string") == "number").select(
        key, "field", F.lit("type_check").alias("rule"), F.col("value_num").isNotNull().alias("passed")
    )


def rule_range(resolved: DataFrame, checklist: Checklist, key: str = "doc_id") -> DataFrame:
    lo, hi = _per_field(checklist, "min", "double"), _per_field(checklist, "max", "double")
    return resolved.filter(
        (_per_field(checklist, "type", "string") == "number")
        & F.col("value_num").isNotNull()
        & (lo.isNotNull() | hi.isNotNull())
    ).select(
        key, "field", F.lit("range_validation").alias("rule"), within(F.col("value_num"), lo, hi).alias("passed"),
        bounds_text(lo, hi).alias("expected"),
    )


def rule_cross_field(wide: DataFrame, checklist: Checklist, key: str) -> DataFrame:
    """Rules over a wide table whose columns carry the field names: one pass for all rules."""
    parts = []
    for rule, compiled in checklist.active_cross_rules():
        applies = F.lit(True)
        for n in compiled.names:
            applies = applies & F.col(n).isNotNull()
        passed = compiled.column(lambda n: F.col(n).cast("double"))
        anchor = (*rule.fields, *compiled.names, rule.id)[0]
        expected = F.when(passed, F.lit(rule.expression)).otherwise(
            interpolate_numbers(rule.message, {n: F.col(n) for n in compiled.names})
        )
        parts.append(
            F.when(
                applies,
                F.struct(
                    F.lit(anchor).alias("field"), F.lit(rule.id).alias("rule"), passed.alias("passed"),
                    expected.alias("expected"),
                ),
            )
        )
    return wide.select(key, F.inline(compact(F.array(*parts))))


def verdicts(outcomes: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """PASS iff no outcome failed. Only failures travel: they are aggregated before the join."""
    failed = outcomes.filter(~F.col("passed")).groupBy(key).agg(F.count("*").alias("n_failed"))
    return docs.select(key).join(failed, key, "left").select(
        key,
        F.when(F.col("n_failed").isNull(), "PASS").otherwise("FAIL").alias("status"),
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
    )


def document_verdicts(outcomes: DataFrame, entries: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with an ambiguous field are AMBIGUOUS and see no rules; the others follow the rules."""
    ambiguous = entries.filter("status = 'ambiguous'").select(key).distinct()
    clear = docs.select(key).join(ambiguous, key, "left_anti")
    return verdicts(outcomes, clear, key).select(key, "status").unionByName(
        ambiguous.select(key, F.lit("AMBIGUOUS").alias("status"))
    )


def merge_evaluations(verdicts_: DataFrame, evaluations: DataFrame, key: str = "doc_id") -> DataFrame:
    """Table form: ``evaluations(key, ix, evaluation, informative_only)`` in spec order.

    The first decisive evaluation per verdict is a ``min_by``, so it aggregates on the map side.
    """
    counted = evaluations.filter("not informative_only and evaluation in ('fail', 'ambiguous')")
    firsts = counted.groupBy(key).agg(
        F.min_by("evaluation", "ix").alias("first_any"),
        F.bool_or(F.col("evaluation") == "fail").alias("any_fail"),
    )
    status = F.col("status")
    merged = (
        F.when((status == "PASS") & (F.col("first_any") == "ambiguous"), "AMBIGUOUS")
        .when(F.col("any_fail"), "FAIL")
        .otherwise(status)
    )
    return verdicts_.join(firsts, key, "left").select(key, merged.alias("status"))


def normalize_evaluations(replies: DataFrame, checklist: Checklist, key: str = "doc_id", documents: DataFrame | None = None) -> DataFrame:
    """Reply tags to evaluations: declared or default tag, anything else (also an error) is ambiguous.

    ``replies(key, field, evaluation)``; informative fields carry no evaluation. With ``documents(key)`` every
    document gets a row for every declared field, and a field without a readable reply is ambiguous.
    """
    specs = {s.name: s for s in checklist.open_ended}
    name = F.col("field")
    if documents is not None:
        declared = documents.select(key).distinct().withColumn("field", F.explode(F.array(*map(F.lit, specs)).cast("array<string>")))
        replies = declared.join(replies.filter(name.isin(*specs)).select(key, "field", "evaluation"), [key, "field"], "left")
    tag = F.lower(F.trim(F.coalesce("evaluation", F.lit(""))))
    known = name.isin(*specs)
    informative = name.isin(*(n for n, s in specs.items() if s.informative_only))
    unjudged = name.isin(*(n for n, s in specs.items() if not s.informative_only and not s.has_evaluation))
    return replies.filter(known).select(
        key, "field",
        F.when(informative | unjudged, F.lit(None)).when(tag.isin("pass", "fail", "ambiguous"), tag)
        .otherwise("ambiguous").alias("evaluation"),
        informative.alias("informative_only"),
    )


def needs_retry(verdicts_: DataFrame, outcomes: DataFrame, missing: DataFrame, key: str = "doc_id") -> DataFrame:
    """Failing documents whose failure may come from extraction: semi joins, nothing is duplicated."""
    causes = (
        outcomes.filter("rule = 'required' and not passed").select(key).unionByName(missing.select(key)).distinct()
    )
    return verdicts_.filter("status = 'FAIL'").join(causes, key, "left_semi")
