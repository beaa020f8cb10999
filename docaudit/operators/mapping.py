"""Candidates to one value per field: mapping, conflicts, policies, resolution.

Two forms share the same Column logic: inside a document row (``field_map`` array, used by the
validation plan, no shuffle) and over a flat candidate table keyed by document (one aggregation
with map-side combine).

A field entry is ``struct(field, status, candidates)``, one per checklist field, in checklist order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.arrays import distinct_by
from docaudit.functions.text import field_key, first, let
from docaudit.functions.values import canonical, dedupe_key, equivalent, value

from .extraction import CANDIDATES_TYPE

ENTRY_TYPE = f"struct<field:string,status:string,candidates:{CANDIDATES_TYPE}>"

# Rank of extraction sources, best first in effect.
SOURCE_PRIORITY = {"llm_context": 5, "regex": 4, "layout": 3, "llm": 2, "vision": 1}
TRUSTED_REGEX_CONFIDENCE = 0.85
LAST_BLOCK = 10**9


def source_priority(source: Column) -> Column:
    table = F.create_map(*(x for k, v in SOURCE_PRIORITY.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, F.lower(source)), F.lit(0))


def block_rank(block_id: Column) -> Column:
    """``b12`` → 12; any other id sorts last."""
    return F.when(block_id.rlike(r"^b\d+$"), F.substring(block_id, 2, 12).try_cast("long")).otherwise(
        F.lit(LAST_BLOCK).cast("long")
    )


def _page(c: Column) -> Column:
    return F.when(c["page"] > 0, c["page"]).otherwise(1)


def rank(c: Column, ix: Column, strategy: Column) -> Column:
    """Sort key of a candidate under a strategy; the smallest key wins, ties fall to input order."""
    page, block = _page(c).cast("double"), block_rank(c["block_id"]).cast("double")
    order = ix.cast("double")
    best = F.struct(-source_priority(c["source"]).cast("double"), -c["confidence"], block, order)
    surest = F.struct(-c["confidence"], page, block, order)
    earliest = F.struct(page, block, order, F.lit(0.0))
    latest = F.struct(-page, -block, -order, F.lit(0.0))
    return (
        F.when(strategy == "highest_confidence", surest)
        .when(strategy.isin("first", "any"), earliest)
        .when(strategy == "last", latest)
        .otherwise(best)
    )


def pick_ix(cands: Column, strategy: Column | None = None) -> Column:
    """Position of the winning candidate, NULL when there is none. A sole one needs no rank."""
    chosen = F.lit("best_match") if strategy is None else strategy
    keyed = F.transform(cands, lambda c, i: F.struct(rank(c, i, chosen).alias("key"), i.alias("i")))
    return F.when(F.size(cands) == 1, F.lit(0)).otherwise(F.array_min(keyed)["i"])


def pick(cands: Column, strategy: Column | None = None) -> Column:
    """The winning candidate, NULL when there is none."""
    return F.get(cands, pick_ix(cands, strategy))


def conflicting(values: Column) -> Column:
    """True iff some value differs from the first one."""
    return let(values, lambda vs: let(first(vs), lambda head: F.exists(vs, lambda v: ~equivalent(v, head))))


def status_of(cands: Column) -> Column:
    return (
        F.when(F.size(cands) == 0, "missing")
        .when(conflicting(F.transform(cands, lambda c: c["value"])), "ambiguous")
        .otherwise("found")
    )


def entry(field: Column, status: Column, cands: Column) -> Column:
    return F.struct(field.alias("field"), status.alias("status"), cands.alias("candidates"))


def only(c: Column) -> Column:
    return F.array(c)


# ---- in the document row ---------------------------------------------------------------------


def _mapped(f: Column, cands: Column, keys: Column) -> Column:
    mine = F.filter(cands, lambda _, i: F.array_contains(f["keys"], F.get(keys, i)))
    return let(mine, lambda m: entry(f["name"], status_of(m), m))


def _keys(cands: Column) -> Column:
    return F.transform(cands, lambda c: field_key(c["field"]))


def field_map(cands: Column, fields: Column) -> Column:
    """One entry per checklist field; a candidate may serve several fields through aliases."""
    return let(cands, lambda cs: let(_keys(cs), lambda ks: F.transform(fields, lambda f: _mapped(f, cs, ks))))


def settled_map(cands: Column, fields: Column) -> Column:
    """Mapping, reconciliation and policies of each field in one go."""

    def one(f: Column, cs: Column, ks: Column) -> Column:
        return let(let(_mapped(f, cs, ks), lambda e: _reconciled(e, f)), lambda e: _with_policy(e, f))

    return let(cands, lambda cs: let(_keys(cs), lambda ks: F.transform(fields, lambda f: one(f, cs, ks))))


def deduped(cands: Column) -> Column:
    """Keep the first reading per field, canonical value and block."""
    return distinct_by(
        cands, lambda c: F.struct(c["field"], dedupe_key(c["field"], c["value"]), F.coalesce(c["block_id"], F.lit("")))
    )


def _reconciled(e: Column, f: Column) -> Column:
    cands = e["candidates"]
    best = entry(e["field"], F.lit("found"), only(pick(cands)))

    def settle(forms: Column) -> Column:
        def tidy(i: Column) -> Column:
            return let(F.get(cands, i), lambda w: w.withField("value", F.get(forms, i)))

        merged = entry(e["field"], F.lit("found"), only(let(pick_ix(cands, f["strategy"]), tidy)))
        return (
            F.when(~conflicting(forms), merged)
            .when((e["status"] == "found") & (F.size(cands) > 1), best)
            .otherwise(e)
        )

    forms = F.transform(cands, lambda c: canonical(f["name"], c["value"]))
    return F.when(F.size(cands) == 0, e).otherwise(let(forms, settle))


def _with_policy(e: Column, f: Column) -> Column:
    decided = entry(e["field"], F.lit("found"), only(pick(e["candidates"], f["strategy"])))
    return F.when((e["status"] == "ambiguous") & f["strategy"].isNotNull(), decided).otherwise(e)


def reconciled(entries: Column, fields: Column) -> Column:
    """Merge readings that agree in canonical form; real conflicts stay for the policies."""
    return F.zip_with(entries, fields, _reconciled)


def with_policies(entries: Column, fields: Column) -> Column:
    """Ambiguous fields with a declared strategy keep its winner."""
    return F.zip_with(entries, fields, _with_policy)


def judged(entries: Column, fields: Column, verdicts: Column, enabled: Column) -> Column:
    """Remove winners a reviewer rejected; regex winners are trusted and never reviewed.

    ``verdicts`` maps field → approved.
    """

    def one(e: Column, f: Column) -> Column:
        cands = e["candidates"]
        keyed = F.transform(cands, lambda c, i: F.struct(rank(c, i, F.lit("best_match")).alias("key"), i.alias("i")))

        def review(i: Column) -> Column:
            rejected = (
                enabled & f["judged"] & (e["status"] == "found") & (F.lower(F.get(cands, i)["source"]) != "regex")
                & (F.try_element_at(verdicts, f["name"]) == F.lit(False))
            )
            rest = F.filter(cands, lambda c, k: k != i)
            return F.when(F.coalesce(rejected, F.lit(False)), let(rest, lambda r: entry(e["field"], status_of(r), r))).otherwise(e)

        return F.when(F.size(cands) == 0, e).otherwise(let(F.array_min(keyed)["i"], review))

    return F.zip_with(entries, fields, one)


def has_ambiguity(entries: Column) -> Column:
    return F.exists(entries, lambda e: e["status"] == "ambiguous")


def evidence_struct(c: Column) -> Column:
    """What is kept of a candidate as proof."""
    return F.struct(
        F.coalesce(c["evidence_text"], F.lit("")).alias("text"),
        *(c[k].alias(k) for k in ("block_id", "page", "x0", "y0", "x1", "y1", "section_label")),
    )


def resolved(entries: Column) -> Column:
    """Aligned with the field map: ``struct(field, value, evidence)`` for found fields, else NULL."""

    def one(e: Column) -> Column:
        return F.when(
            e["status"] == "found",
            let(
                pick(e["candidates"]),
                lambda w: F.struct(e["field"].alias("field"), w["value"].alias("value"), evidence_struct(w).alias("evidence")),
            ),
        )

    return F.transform(entries, one)


def missing_required_fields(entries: Column, fields: Column) -> Column:
    pairs = F.zip_with(entries, fields, lambda e, f: F.when(f["required"] & (e["status"] == "missing"), e["field"]))
    return F.filter(pairs, lambda x: x.isNotNull())


def gapfill_fields(entries: Column, fields: Column, everywhere: bool | Column = False) -> Column:
    """Checklist fields that should get a model reply: missing, and wanted globally or by the field."""
    wanted = F.lit(everywhere) if isinstance(everywhere, bool) else everywhere
    open_ = F.filter(entries, lambda e: e["status"] == "missing")["field"]
    return F.filter(fields, lambda f: F.array_contains(open_, f["name"]) & (wanted | f["gap_fill"]))


def contextual_fields(entries: Column, cands: Column, spec: Column) -> Column:
    """Fields that profit from a second, context-aware reading; sorted names."""

    def need(e: Column, f: Column) -> Column:
        sole = first(e["candidates"])
        trusted = (F.size(e["candidates"]) == 1) & (sole["source"] == "regex") & (sole["confidence"] >= TRUSTED_REGEX_CONFIDENCE)
        crowded = F.size(F.filter(cands, lambda c: c["field"] == f["name"])) > 1
        wanted = (
            F.when(spec["context_pass"] == "always", F.lit(True))
            .when(e["status"].isin("missing", "ambiguous"), F.lit(True))
            .when(trusted, F.lit(False))
            .otherwise(crowded | (f["semantic_role"] != ""))
        )
        return F.when(wanted, f["name"])

    names = F.sort_array(F.filter(F.zip_with(entries, spec["fields"], need), lambda n: n.isNotNull()))
    never = (spec["context_pass"] == "never") | ~spec["understand"]
    return F.when(never, F.slice(names, 1, 0)).otherwise(names)


# ---- over flat tables ------------------------------------------------------------------------


def alias_table(fields: DataFrame) -> DataFrame:
    """``(schema_field, key)`` from ``(field, aliases)`` rows."""
    keys = F.concat(F.array(field_key(F.col("field"))), F.transform(F.coalesce("aliases", F.array()), field_key))
    return fields.select(F.col("field").alias("schema_field"), F.explode(F.array_distinct(keys)).alias("key"))


def map_candidates(cands: DataFrame, fields: DataFrame) -> DataFrame:
    """Equi-join on the normalised name. Checklist tables are small; Catalyst broadcasts them by size."""
    return cands.withColumn("key", field_key(F.col("field"))).join(alias_table(fields), "key").drop("key")


def unmatched(cands: DataFrame, fields: DataFrame) -> DataFrame:
    return (
        cands.withColumn("key", field_key(F.col("field"))).join(alias_table(fields), "key", "left_anti").drop("key")
    )


def classify_fields(
    mapped: DataFrame, fields: Sequence[str], docs: DataFrame, key: str = "doc_id"
) -> DataFrame:
    """``(key, field, status, n_candidates)`` for every document and checklist field.

    A reading conflicts when it differs from the first one. Within one aggregation that is: the
    first number or text, and whether numbers spread further than the tolerance from it. The
    extremes decide, so the job is a plain aggregation with map-side combine.
    """
    stats = mapped.groupBy(key, "schema_field").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("value_num", "value_str"), "cand_ix").alias("head"),
        F.count("value_num").alias("n_num"),
        F.min("value_num").alias("lo"), F.max("value_num").alias("hi"),
        F.min("value_str").alias("smin"), F.max("value_str").alias("smax"),
    )
    h = F.col("head")
    differs = F.when(
        h["value_num"].isNotNull(),
        (F.col("n_num") < F.col("n"))
        | (F.abs(h["value_num"] - F.col("lo")) > 0.001)
        | (F.abs(h["value_num"] - F.col("hi")) > 0.001),
    ).otherwise((F.col("n_num") > 0) | (F.col("smin") != F.col("smax")))
    known = stats.select(key, F.col("schema_field").alias("field"), "n", differs.alias("differs"))
    grid = docs.select(key, F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return grid.join(known, [key, "field"], "left").select(
        key, "field",
        F.when(F.col("n").isNull(), "missing").when(F.col("differs"), "ambiguous").otherwise("found").alias("status"),
        F.coalesce("n", F.lit(0)).alias("n_candidates"),
    )


def inconsistencies(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document from the flat field map: is anything ambiguous, and which fields with how many readings."""
    amb = F.col("status") == "ambiguous"
    return entries.groupBy(key).agg(
        F.bool_or(amb).alias("has_ambiguity"),
        F.count_if(amb).alias("n_ambiguous"),
        F.sort_array(
            F.collect_list(F.when(amb, F.struct(F.col("field"), F.col("n_candidates"))))
        ).alias("ambiguous_fields"),
    )


def dedupe_candidates(cands: DataFrame, key: str = "doc_id") -> DataFrame:
    """First reading per field, canonical value and block: ``min_by`` on the extraction order."""
    v = value(F.col("value_num"), F.col("value_str"))
    rest = [c for c in cands.columns if c not in (key, "field")]
    picked = cands.withColumn("_k", dedupe_key(F.col("field"), v)).groupBy(
        key, "field", "_k", F.coalesce("block_id", F.lit("")).alias("_b")
    ).agg(F.min_by(F.struct(*rest), "cand_ix").alias("c"))
    return picked.select(key, "field", "c.*")


def resolve(cands: DataFrame, key: str = "doc_id", strategy: str = "best_match") -> DataFrame:
    """Winner per (key, field) of a flat candidate table, by aggregation rather than a window."""
    c = F.struct("source", "confidence", "block_id", "page")
    keyed = cands.withColumn("_rank", rank(c, F.col("cand_ix"), F.lit(strategy)))
    rest = [x for x in cands.columns if x not in (key, "field")]
    return keyed.groupBy(key, "field").agg(F.min_by(F.struct(*rest), "_rank").alias("c")).select(key, "field", "c.*")


def missing_required(entries: DataFrame, fields: DataFrame) -> DataFrame:
    required = fields.filter("required").select("field")
    return entries.filter("status = 'missing'").join(required, "field", "left_semi")


def gapfill_targets(entries: DataFrame, fields: DataFrame, everywhere: bool = False) -> DataFrame:
    wanted = fields.filter(F.lit(everywhere) | F.coalesce("llm_fallback", F.lit(False)) | (F.col("type") == "date"))
    return entries.filter("status = 'missing'").join(wanted.select("field"), "field", "left_semi")
