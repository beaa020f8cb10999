"""The whole validation of documents as one narrow plan.

Every stage adds a column to the document row: blocks → candidates → field map → resolved →
outcomes → status. A document never leaves its partition, so a job over any number of documents
has no shuffle of its own. Each stage reads the one before through ``let``: when the optimizer folds
projections together, the earlier stage is still evaluated once per row, never once per element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.text import compact, exploding, let
from docaudit.operators import extraction, mapping, programs, verdicts
from docaudit.operators.blocks import sparse_text
from docaudit.operators.evidence import tightened
from docaudit.plans.catalogue import spec_programs
from docaudit.plans.checklist import Checklist, known_fields, spec_column
from docaudit.plans.normalise import normalised_body

RESULTS = ("candidates", "field_map", "resolved", "outcomes", "status")
UNKNOWN_CHECKLIST = "UNKNOWN_CHECKLIST"


@dataclass(frozen=True)
class _Rules:
    """Cross-field rules and groups: built into the plan for one checklist, values of the row for a catalogue."""

    own: Checklist | None

    @property
    def has_cross(self) -> bool:
        return self.own is None or bool(self.own.active_cross_rules())

    @property
    def has_groups(self) -> bool:
        return self.own is None or (self.own.extended and bool(self.own.groups))

    def cross(self, resolved: Column) -> Column:
        if self.own is None:
            return programs.cross_outcomes(resolved, F.col("programs.cross"))
        return verdicts.cross_field_outcomes(resolved, self.own)

    def groups(self, blocks: Column) -> Column:
        if self.own is None:
            return programs.group_outcomes(blocks, F.col("programs.groups"))
        return verdicts.group_outcomes(blocks, self.own)


class _Stages:
    """Adds the stages of one pass. ``gate`` limits a pass to the rows that need it."""

    def __init__(self, spec: Column, rules: _Rules, options: dict, suffix: str = "", gate: Column | None = None):
        self.spec, self.rules, self.options, self.suffix, self.gate = spec, rules, options, suffix, gate

    def name(self, column: str) -> str:
        return column + self.suffix

    def col(self, column: str) -> Column:
        return F.col(self.name(column))

    def add(self, df: DataFrame, column: str, expr: Column) -> DataFrame:
        return df.withColumn(self.name(column), expr if self.gate is None else F.when(self.gate, expr))

    def _with(self, column: str, body: Callable[[Column, Column], Column]) -> Column:
        """``body(stage value, checklist fields)``, both evaluated once."""
        return let(self.col(column), lambda x: let(self.spec["fields"], lambda fs: body(x, fs)))

    def map_fields(self, df: DataFrame) -> DataFrame:
        """candidates → settled field map."""
        return self.add(df, "field_map", self._with("candidates", mapping.settled_map))

    def settle(self, df: DataFrame) -> DataFrame:
        """candidates → all result columns."""
        o = self.options
        df = self.map_fields(df)
        if o["context_replies"] is not None:
            wanted = let(
                self.col("field_map"),
                lambda m: let(self.col("candidates"), lambda cs: mapping.contextual_fields(m, cs, self.spec)),
            )
            df = self.add(df, "_wanted", let(
                wanted, lambda ns: F.filter(self.spec["fields"], lambda f: F.array_contains(ns, f["name"]))))
            extra = let(
                self.col("_wanted"),
                lambda w: let(F.col("blocks"), lambda b: let(
                    F.col(o["context_replies"]), lambda r: extraction.contextual_candidates(r, w, b))),
            )
            df = self.add(df, "candidates", F.concat(self.col("candidates"), extra)).drop(self.name("_wanted"))
            df = self.add(df, "candidates", let(self.col("candidates"), mapping.deduped))
            df = self.map_fields(df)
        if o["judge_verdicts"] is not None:
            df = self.add(df, "field_map", self._with(
                "field_map",
                lambda m, fs: let(F.col(o["judge_verdicts"]), lambda v: mapping.judged(m, fs, v, self.spec["judge"])),
            ))
        if o["spans"] is not None:
            def tighten(m: Column, ss: Column) -> Column:
                return F.transform(m, lambda e: mapping.entry(e["field"], e["status"], tightened(e["candidates"], ss)))

            df = self.add(df, "field_map", let(self.col("field_map"), lambda m: let(F.col(o["spans"]), lambda ss: tighten(m, ss))))
            df = self.add(df, "candidates", let(self.col("candidates"), lambda cs: let(F.col(o["spans"]), lambda ss: tightened(cs, ss))))
        return self.judge(df)

    def judge(self, df: DataFrame) -> DataFrame:
        """field map → resolved, outcomes, status. Ambiguous documents see no rules."""
        df = self.add(df, "_ambiguous", let(self.col("field_map"), mapping.has_ambiguity))
        ambiguous = self.col("_ambiguous")
        none = F.array().cast(verdicts.RESOLVED_TYPE)
        df = self.add(df, "_aligned", F.when(ambiguous, none).otherwise(let(self.col("field_map"), mapping.resolved)))
        basic = self._with("_aligned", lambda r, fs: verdicts.field_outcomes(r, fs, self.spec["rules"]))
        parts = [basic]
        empty = F.array().cast(verdicts.OUTCOMES_TYPE)
        group_blocks = F.col(self.options["group_blocks"] or "blocks")
        if self.rules.has_cross:
            parts.append(let(self.col("_aligned"), self.rules.cross))
        if self.rules.has_groups:
            parts.append(let(group_blocks, self.rules.groups))
        df = self.add(df, "outcomes", F.when(ambiguous, empty).otherwise(F.concat(*parts)))
        df = self.add(df, "outcomes", let(self.col("outcomes"), verdicts.sorted_ledger))
        df = self.add(df, "resolved", compact(self.col("_aligned")))
        status = F.when(ambiguous, "AMBIGUOUS").when(verdicts.passes(self.col("outcomes")), "PASS").otherwise("FAIL")
        return self.add(df, "status", status).drop(self.name("_ambiguous"), self.name("_aligned"))


def validate_documents(
    docs: DataFrame,
    checklists: Checklist | Sequence[Checklist] | DataFrame,
    *,
    measurements: bool = True,
    spans: str | None = None,
    group_blocks: str | None = None,
    gap_replies: str | None = None,
    gap_fill_everywhere: bool = False,
    context_replies: str | None = None,
    page_replies: str | None = None,
    judge_verdicts: str | None = None,
    evaluations: str | None = None,
    image_pages: str | None = None,
    label_places: str | None = None,
    normalise: bool = True,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Validate ``docs(…, blocks[, spec_id])``; returns ``keep`` + blocks + result columns, one row per document.

    Several checklists may be given as objects or as a catalogue compiled by ``catalogue.compiled``; their fields, rules
    and groups are then values that are joined to the documents, and the plan is the same for any number. A document
    whose ``spec_id`` is NULL or names none of them has the status ``UNKNOWN_CHECKLIST`` and no results.

    Replies are optional columns of the document row: ``gap_replies MAP<STRING,STRING>``,
    ``context_replies MAP<STRING,STRUCT<value,block_id,evidence_text>>``,
    ``page_replies MAP<STRING,STRING>`` (used where a document has hardly any text, ``image_pages`` being its pages
    with images, or lacks a required value, and in a second pass by documents that fail for want of a value and have
    not used theirs), ``label_places`` (see ``labels.label_places``, for catalogues of many labels), ``judge_verdicts MAP<STRING,BOOLEAN>`` and ``evaluations ARRAY<STRING>``. Checklists are
    normalised from their bodies first, unless told otherwise.
    """
    several = not isinstance(checklists, Checklist)
    if several:
        if not isinstance(checklists, DataFrame):
            specs = [Checklist.from_body(c.spec_id, normalised_body(c.body)) if normalise and c.body else c for c in checklists]
            checklists = spec_programs(docs.sparkSession, specs)
        df = docs.join(checklists.select("spec_id", "spec", "programs"), "spec_id", "left")
        spec, rules, known = F.col("spec"), _Rules(None), None
    else:
        own = Checklist.from_body(checklists.spec_id, normalised_body(checklists.body)) if normalise and checklists.body else checklists
        df, spec, rules = docs, spec_column(own), _Rules(own)
        known = known_fields(own)
    options = {
        "context_replies": context_replies, "judge_verdicts": judge_verdicts, "spans": spans, "group_blocks": group_blocks,
    }
    stages = _Stages(spec, rules, options)
    if label_places is None:
        found = let(F.col("blocks"), lambda b: let(spec["fields"], lambda fs: extraction.ensemble(b, fs, measurements, known=known)))
    else:
        found = let(F.col("blocks"), lambda b: let(spec["fields"], lambda fs: let(F.col(label_places), lambda p: extraction.ensemble(b, fs, measurements, p, known))))
    df = df.withColumn("candidates", found)
    if gap_replies is not None:
        targets = stages._with(
            "candidates",
            lambda cs, fs: let(mapping.field_map(cs, fs), lambda m: mapping.gapfill_fields(m, fs, gap_fill_everywhere)),
        )
        df = df.withColumn("_targets", targets)
        extra = let(
            F.col("_targets"),
            lambda t: let(F.col("blocks"), lambda b: let(F.col(gap_replies), lambda r: extraction.reply_candidates(r, t, b))),
        )
        df = df.withColumn("candidates", F.concat("candidates", extra)).drop("_targets")
    if page_replies is not None:
        df = _first_page_pass(df, stages, page_replies, image_pages)
    df = df.withColumn("candidates", let(F.col("candidates"), mapping.deduped))
    df = stages.settle(df)
    if page_replies is not None:
        df = _second_pass(df, spec, rules, options, page_replies)
    if several:
        df = df.withColumn("status", F.when(spec.isNull(), UNKNOWN_CHECKLIST).otherwise(F.col("status")))
        df = df.withColumns({c: F.when(spec.isNotNull(), F.col(c)) for c in RESULTS if c != "status"})
    out = df.select(*keep, "blocks", *RESULTS, *([evaluations] if evaluations else []))
    if evaluations is not None:
        out = out.withColumn("status", verdicts.merge_evaluation(F.col("status"), F.col(evaluations)))
    return out


def _page_candidates(spec: Column, replies: str) -> Column:
    page = F.coalesce(F.get(F.col("blocks"), F.lit(0))["page"], F.lit(1))
    return let(spec["fields"], lambda fs: let(F.col(replies), lambda r: extraction.page_reply_candidates(r, fs, page)))


def _first_page_pass(df: DataFrame, stages: _Stages, replies: str, image_pages: str | None) -> DataFrame:
    """Page replies of documents with hardly any text or without a required value join the candidates."""
    lacking = stages._with(
        "candidates", lambda cs, fs: let(mapping.field_map(cs, fs), lambda m: mapping.missing_required_fields(m, fs))
    )
    pages = F.col(image_pages) if image_pages else F.array().cast("array<int>")
    wanted = let(F.col("blocks"), lambda b: sparse_text(b, pages)) | (F.size(lacking) > 0)
    df = df.withColumn("_page", F.when(wanted, _page_candidates(stages.spec, replies)).otherwise(extraction.no_candidates()))
    return df.withColumn("candidates", F.concat("candidates", "_page")).withColumn("_page_used", F.size("_page") > 0).drop("_page")


def _second_pass(df: DataFrame, spec: Column, rules: _Rules, options: dict, replies: str) -> DataFrame:
    """Read documents again that fail for want of a value, now with the page replies."""
    lacking = let(
        F.col("field_map"), lambda m: let(spec["fields"], lambda fs: mapping.missing_required_fields(m, fs))
    )
    failed_required = F.exists("outcomes", lambda o: (o["rule"] == "required") & ~o["passed"])
    df = df.withColumn("_retry", (F.col("status") == "FAIL") & ~F.col("_page_used") & ((F.size(lacking) > 0) | failed_required))
    again = _Stages(spec, rules, options, "_2", F.col("_retry"))
    more = _page_candidates(spec, replies)
    df = again.add(df, "candidates", let(F.concat("candidates", more), mapping.deduped))
    df = again.settle(df)
    merged = {c: F.when(F.col("_retry"), F.col(f"{c}_2")).otherwise(F.col(c)) for c in RESULTS}
    return df.withColumns(merged).drop("_retry", *(f"{c}_2" for c in RESULTS))


def resolved_number(field: str) -> Column:
    return F.get(F.filter("resolved", lambda r: r["field"] == field)["value"]["num"], F.lit(0))


def resolved_text(field: str) -> Column:
    return F.get(F.filter("resolved", lambda r: r["field"] == field)["value"]["str"], F.lit(0))


def outcome_rows(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ledger as a flat table."""
    return results.select(key, F.posexplode(exploding(F.col("outcomes"))).alias("outcome_ix", "o")).select(
        key, "outcome_ix", "o.field", "o.rule", "o.passed", "o.value", "o.expected", "o.evidence"
    )


def field_rows_of(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Field map as a flat table ``(key, field, status, n_candidates)``."""
    return results.select(key, F.explode(exploding(F.col("field_map"))).alias("e")).select(
        key, "e.field", "e.status", F.size("e.candidates").cast("long").alias("n_candidates")
    )
