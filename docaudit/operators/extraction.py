"""Extraction: blocks x checklist fields → candidates with evidence.

The candidate order matters downstream (conflicts are judged against the first reading), and it is
fixed by construction: extractor, then field, then block, then match. Inside a document row that is
simply the array order. Loops run field by field with blocks inside, so each pattern is compiled
once per document and field, however many checklists share the job; the field patterns of a checklist that is
known when the query is planned (``checklist.known_fields``) once in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.arrays import any_of, distinct_by, each
from docaudit.functions.text import compact, first, group0_or, let, lines, strip, trimmed
from docaudit.functions.values import coerce, coerce_reply, is_set, text_of, value
from docaudit.plans.checklist import Checklist, Known, spec_column

CANDIDATE_TYPE = (
    "struct<field:string,value:struct<num:double,str:string>,source:string,confidence:double,block_ix:int,"
    "block_id:string,page:int,evidence_text:string,x0:double,y0:double,x1:double,y1:double,section_label:string>"
)
CANDIDATES_TYPE = f"array<{CANDIDATE_TYPE}>"

# Context words of the guard for document totals.
TOTAL_PHRASES = ("importe por pagar", "total due", "amount due", "total a pagar")
OTHER_AMOUNT_PHRASES = ("subtotal", "unit price", "precio")
# Words that mark the recipient part of a document.
RECIPIENT_WORDS = ("facturar", "bill to", "bill-to", "recipient", "destinatario")
# Patterns.
EMAIL = r"(?Ui)[\w.+-]+@[\w.-]+\.\w+"
SPANISH_DATE = (
    r"(?Ui)(\d{1,2})\s+de\s+"
    r"(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)"
    r"\s+de\s+(\d{4})"
)
MEASUREMENT_PATTERNS = {
    "ph": (
        r"(?Ui)ph\s*[:=]\s*([\d.]+)",
        r"(?Ui)measured\s+ph\s*[:=]\s*([\d.]+)",
        r"(?Ui)ph\s+level\s*[:=]?\s*([\d.]+)",
        r"(?Ui)ph\s+value\s*[:=]?\s*([\d.]+)",
    ),
    "alcohol": (r"(?Ui)alcohol\s*[:=]\s*([\d.]+)\s*%?",),
    "quality": (r"(?Ui)quality\s*[:=]\s*([\d.]+)",),
}
LOOSE_ALCOHOL = r"(?Ui)alcohol(?!\s*[:=]\s*[\d.])(?:\s+\w+){0,8}\s+(?:at\s+)?([\d.]+)"
NUMBER = r"[\d.]+"
# Confidence per extractor.
REGEX_CONFIDENCE, SPANISH_DATE_CONFIDENCE, LABEL_CONFIDENCE = 0.9, 0.85, 0.6
HINTED_EMAIL_CONFIDENCE, EMAIL_CONFIDENCE = 0.92, 0.75
MEASUREMENT_CONFIDENCE = 0.95
MEASUREMENT_LINE_CONFIDENCE = {"alcohol": 0.55, "ph": 0.5, "quality": 0.5}
GAP_FILL_CONFIDENCE, MEASUREMENT_GAP_FILL_CONFIDENCE = 0.45, 0.40
CONTEXT_CONFIDENCE, PAGE_REPLY_CONFIDENCE = 0.88, 0.42


def no_candidates() -> Column:
    return F.array().cast(CANDIDATES_TYPE)


def candidate(field: Column, val: Column, source: str, confidence: float | Column, block: Column, evidence: Column) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        field.alias("field"),
        val.alias("value"),
        F.lit(source).alias("source"),
        conf.cast("double").alias("confidence"),
        *(block[k].alias(k) for k in ("block_ix", "block_id", "page")),
        evidence.alias("evidence_text"),
        *(block[k].alias(k) for k in ("x0", "y0", "x1", "y1", "section_label")),
    )


def _contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | text.contains(p)
    return hit


def total_in_context(text: Column) -> Column:
    """False where an amount sits in a block about subtotals or unit prices and no total phrase."""
    return let(
        F.lower(text), lambda low: _contains_any(low, TOTAL_PHRASES) | ~_contains_any(low, OTHER_AMOUNT_PHRASES)
    )


# ---- patterns of the checklist ---------------------------------------------------------------


def regex_reading(text: Column, f: Column) -> Column:
    """First acceptable match of a field's pattern: ``struct(evidence, value)`` or NULL."""

    def read(whole: Column, caps: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            taken = first(F.filter(F.transform(caps, lambda c: F.get(c, i)), lambda r: r != ""))
            # Without a group that took part the whole match is read; a group that is empty gives nothing.
            raw = F.coalesce(taken, F.when((F.size(caps) == 0) | ~F.coalesce(F.regexp_like(m, f["regex_took"]), F.lit(False)), m))
            return F.struct(trimmed(m).alias("evidence"), coerce(raw, f["type"]).alias("value"))

        return first(F.filter(F.transform(whole, one), lambda m: is_set(m["value"])))

    # regexp_extract_all keeps its compiled pattern between calls, unlike rlike with a column pattern.
    groups = each(f["regex_groups"], lambda g: F.regexp_extract_all(text, f["regex"], g), "array<array<string>>")
    return let(
        F.regexp_extract_all(text, f["regex"], F.lit(0)),
        lambda whole: F.when(F.size(whole) > 0, let(groups, lambda caps: read(whole, caps))),
    )


def regex_candidates(blocks: Column, f: Column, lows: Column) -> Column:
    """Matches of a field's pattern. ``lows`` are the blocks' texts in lower case: only blocks with the pattern's
    ``regex_needle``, a piece of text that every match holds, are searched.
    """

    def hit(b: Column) -> Column:
        return let(
            regex_reading(b["text"], f),
            lambda m: F.when(
                m.isNotNull() & (~f["is_total"] | total_in_context(b["text"])),
                candidate(f["name"], m["value"], "regex", REGEX_CONFIDENCE, b, m["evidence"]),
            ),
        )

    likely = F.filter(blocks, lambda _, i: F.coalesce(F.get(lows, i).contains(f["regex_needle"]), F.lit(True)))
    return F.when(f["regex"].isNotNull(), compact(F.transform(likely, hit))).otherwise(no_candidates())


def spanish_date_candidates(blocks: Column, f: Column) -> Column:
    """``17 de marzo de 2031`` in blocks that carry one of the field's labels; every match counts."""

    def hits(b: Column) -> Column:
        low = F.lower(b["text"])
        labelled = any_of(f["labels"], lambda lb: low.contains(lb["label"]))
        found = F.transform(
            F.regexp_extract_all(b["text"], F.lit(SPANISH_DATE), F.lit(0)),
            lambda m: candidate(f["name"], value(None, strip(m)), "regex", SPANISH_DATE_CONFIDENCE, b, strip(m)),
        )
        return F.when(labelled, found).otherwise(no_candidates())

    return F.when(f["spanish_dates"], F.flatten(F.transform(blocks, hits))).otherwise(no_candidates())


def text_lines(blocks: Column) -> Column:
    """All non-blank lines with the position of their block, for the label search."""
    return F.flatten(
        F.transform(
            blocks,
            lambda b, i: F.transform(
                F.filter(F.transform(lines(b["text"]), trimmed), lambda t: t != ""),
                lambda t: F.struct(t.alias("text"), F.lower(t).alias("low"), i.alias("at")),
            ),
        )
    )


def label_candidate(ls: Column, blocks: Column, f: Column, places: Column | None = None) -> Column:
    """``Label: value`` or ``Label value``: first label with any usable hit, then first line, then form.

    ``places`` (see ``labels.label_places``) names the lines that hold each label; without it every label is searched.
    """

    def lines_with(label: Column) -> Column:
        if places is None:
            return F.filter(ls, lambda x: x["low"].contains(label["label"]))
        return F.transform(F.coalesce(F.try_element_at(places, label["label"]), F.array().cast("array<int>")), lambda i: F.get(ls, i))

    def usable(text: Column) -> Column:
        def test(raw: Column) -> Column:
            glued = f["name"].contains("invoice_number") & F.lower(raw).contains("total due")
            return F.when(raw.isNotNull() & ~glued, coerce(raw, f["type"]))

        return let(text, test)

    def read(text: Column, label: Column) -> Column:
        marked = usable(trimmed(group0_or(text, label["marked"], 1)))
        return let(
            marked,
            lambda m: F.when(is_set(m), m).otherwise(usable(trimmed(group0_or(text, label["plain"], 1)))),
        )

    def hit(line: Column, label: Column) -> Column:
        return let(
            read(line["text"], label),
            lambda v: F.when(
                is_set(v),
                candidate(
                    f["name"], v, "layout", LABEL_CONFIDENCE, F.get(blocks, line["at"]),
                    line["text"],
                ),
            ),
        )

    none = F.lit(None).cast(CANDIDATE_TYPE)

    def of_label(label: Column) -> Column:
        return F.aggregate(lines_with(label), none, lambda got, x: F.when(got.isNotNull(), got).otherwise(hit(x, label)))

    found = F.aggregate(f["labels"], none, lambda got, label: F.when(got.isNotNull(), got).otherwise(of_label(label)))
    return let(found, lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(no_candidates()))


def email_candidate(blocks: Column, f: Column) -> Column:
    """Address fields: first hit of the field's own pattern, else the shortest address anywhere."""
    recipients = F.filter(
        blocks, lambda b: f["recipient"] & let(F.lower(b["text"]), lambda low: _contains_any(low, RECIPIENT_WORDS))
    )
    pool = F.when(f["recipient"] & (F.size(recipients) > 0), recipients).otherwise(blocks)

    def hinted(bs: Column) -> Column:
        def one(b: Column) -> Column:
            return let(
                group0_or(b["text"], f["regex"]),
                lambda m: F.when(m.isNotNull(), candidate(f["name"], value(None, m), "layout", HINTED_EMAIL_CONFIDENCE, b, m)),
            )

        return F.slice(compact(F.transform(bs, one)), 1, 1)

    def shortest(bs: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            found = F.when(b["text"].contains("@"), group0_or(b["text"], EMAIL))
            return let(
                found,
                lambda m: F.when(
                    m.isNotNull(),
                    F.struct(
                        F.length(m), i,
                        candidate(f["name"], value(None, m), "layout", EMAIL_CONFIDENCE, b, m).alias("candidate"),
                    ),
                ),
            )

        return F.slice(F.sort_array(compact(F.transform(bs, one)))["candidate"], 1, 1)

    return let(pool, lambda bs: F.when(f["regex"].isNotNull(), hinted(bs)).otherwise(shortest(bs)))


def schema_regex(blocks: Column, fields: Column | list[Known]) -> Column:
    def of_field(f: Column, lows: Column) -> Column:
        return F.concat(regex_candidates(blocks, f, lows), spanish_date_candidates(blocks, f))

    return let(F.transform(blocks, lambda b: F.lower(b["text"])), lambda lows: F.flatten(each(fields, lambda f: of_field(f, lows))))


def schema_labels(blocks: Column, fields: Column, places: Column | None = None) -> Column:
    def of_field(f: Column, ls: Column) -> Column:
        return (
            F.when(f["skip_labels"], no_candidates())
            .when(f["is_email"], email_candidate(blocks, f))
            .otherwise(label_candidate(ls, blocks, f, places))
        )

    def present(held: Column) -> Column:
        return F.filter(fields, lambda f: f["is_email"] | F.arrays_overlap(f["labels"]["label"], held))

    wanted = fields if places is None else let(F.map_keys(places), present)
    return let(text_lines(blocks), lambda ls: F.flatten(F.transform(wanted, lambda f: of_field(f, ls))))


# ---- measurement patterns --------------------------------------------------------------------


def _readings(text: Column, pattern: str) -> Column:
    """All matches as ``struct(evidence, num)``; readings that are no number are dropped."""

    def pair(whole: Column) -> Column:
        pairs = F.zip_with(
            whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(1)),
            lambda m, g: F.struct(strip(m).alias("evidence"), g.try_cast("double").alias("num")),
        )
        return F.when(F.size(whole) > 0, F.filter(pairs, lambda p: p["num"].isNotNull())).otherwise(no_readings())

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pair)


def no_readings() -> Column:
    return F.array().cast("array<struct<evidence:string,num:double>>")


def measurement_regex(blocks: Column) -> Column:
    def hits(b: Column, low: Column) -> Column:
        per_field = []
        for field, patterns in MEASUREMENT_PATTERNS.items():
            # Every pattern of a field spells its name, so a plain search spares most blocks the patterns.
            found = F.when(low.contains(field), F.concat(*(_readings(b["text"], p) for p in patterns))).otherwise(no_readings())
            per_field.append(
                F.transform(
                    found,
                    lambda r: candidate(F.lit(field), value(r["num"]), "regex", MEASUREMENT_CONFIDENCE, b, r["evidence"]),
                )
            )
        return F.when(_contains_any(low, tuple(MEASUREMENT_PATTERNS)), F.concat(*per_field)).otherwise(no_candidates())

    return F.flatten(F.transform(blocks, lambda b: let(F.lower(b["text"]), lambda low: hits(b, low))))


def _distinct_readings(*groups: Column) -> Column:
    """Keep the first reading of each number, in order."""
    return let(F.concat(*groups), lambda all_: distinct_by(all_, lambda r: r["num"]))


def _line_readings(line: Column, field: str) -> Column:
    low = F.lower(line)
    plain = F.filter(
        F.transform(
            F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)),
            lambda t: F.struct(line.alias("evidence"), t.try_cast("double").alias("num")),
        ),
        lambda r: r["num"].isNotNull(),
    )
    none = no_readings()
    if field == "alcohol":
        anchored = _readings(line, MEASUREMENT_PATTERNS[field][0])
        loose = _readings(line, LOOSE_ALCOHOL)
        # Anchored readings all stay; a loose one only if its number is new.
        marked = let(
            anchored,
            lambda a: F.concat(
                a, F.filter(_distinct_readings(loose), lambda r: ~F.array_contains(a["num"], r["num"]))
            ),
        )
        fallback = F.slice(F.reverse(plain), 1, 1)
        applies = low.contains("alcohol")
    elif field == "ph":
        in_scale = lambda r: (r["num"] > 0) & (r["num"] < 14)
        marked = _distinct_readings(*(F.filter(_readings(line, p), in_scale) for p in MEASUREMENT_PATTERNS[field]))
        fallback = F.filter(F.slice(plain, 1, 1), in_scale)
        applies = low.startswith("ph") | F.concat(F.lit(" "), low, F.lit(" ")).contains(" ph ")
    else:
        pattern = MEASUREMENT_PATTERNS[field][0]
        marked = F.when(
            line.rlike(pattern),
            F.transform(
                F.filter(F.array(group0_or(line, pattern, 1).try_cast("double")), lambda v: v.isNotNull()),
                lambda v: F.struct(strip(group0_or(line, pattern)).alias("evidence"), v.alias("num")),
            ),
        ).otherwise(none)
        fallback = F.when(line.rlike(pattern), none).otherwise(F.slice(F.reverse(plain), 1, 1))
        applies = low.contains("quality")
    chosen = let(marked, lambda m: F.when(F.size(m) > 0, m).otherwise(fallback))
    return F.when(applies, chosen).otherwise(none)


def measurement_lines(blocks: Column) -> Column:
    def of_line(line: Column, b: Column) -> Column:
        return F.concat(
            *(
                F.transform(
                    _line_readings(line, field),
                    lambda r: candidate(
                        F.lit(field), value(r["num"]), "layout", MEASUREMENT_LINE_CONFIDENCE[field], b, r["evidence"]
                    ),
                )
                for field in ("alcohol", "ph", "quality")
            )
        )

    def of_block(b: Column) -> Column:
        kept = F.filter(F.transform(lines(b["text"]), strip), lambda t: t != "")
        named = let(F.lower(b["text"]), lambda low: _contains_any(low, tuple(MEASUREMENT_PATTERNS)))
        return F.when(named, F.flatten(F.transform(kept, lambda t: of_line(t, b)))).otherwise(no_candidates())

    return F.flatten(F.transform(blocks, of_block))


def ensemble(
    blocks: Column, fields: Column, measurements: bool = True, places: Column | None = None, known: list[Known] | None = None
) -> Column:
    """All extractors in their fixed order. ``known`` are the fields of a checklist known when the query is planned."""
    parts = [schema_regex(blocks, known or fields), schema_labels(blocks, fields, places)]
    if measurements:
        parts += [measurement_regex(blocks), measurement_lines(blocks)]
    return F.concat(*parts)


# ---- model replies ---------------------------------------------------------------------------

CONTEXT_REPLY_TYPE = "map<string,struct<value:string,block_id:string,evidence_text:string>>"
CONTEXT_TYPE = (
    "struct<document_type:string,summary:string,"
    "regions:array<struct<role:string,block_ids:array<string>,description:string>>,disambiguation_notes:array<string>>"
)


def reply_candidates(reply: Column, wanted: Column, blocks: Column, confidence: float = GAP_FILL_CONFIDENCE) -> Column:
    """``{field: value}`` replies for the wanted fields, anchored to the first block."""

    def one(f: Column) -> Column:
        return let(
            coerce_reply(F.try_element_at(reply, f["name"]), f["type"]),
            lambda v: F.when(
                is_set(v),
                candidate(f["name"], v, "llm", confidence, first(blocks), text_of(v)),
            ),
        )

    found = compact(F.transform(wanted, one))
    return F.when(reply.isNotNull() & (F.size(blocks) > 0), found).otherwise(no_candidates())


def contextual_candidates(reply: Column, wanted: Column, blocks: Column) -> Column:
    """``{field: {value, block_id, evidence_text}}`` replies, anchored where the evidence stands."""
    from .evidence import anchor_block

    def one(f: Column) -> Column:
        entry = F.try_element_at(reply, f["name"])

        def build(v: Column) -> Column:
            quote = F.coalesce(F.nullif(entry["evidence_text"], F.lit("")), text_of(v))
            cited = strip(F.coalesce(entry["block_id"], F.lit("")))
            return F.when(
                is_set(v),
                let(
                    anchor_block(blocks, cited, quote, text_of(v)),
                    lambda a: candidate(
                        f["name"], v, "llm_context", CONTEXT_CONFIDENCE,
                        F.when(a.isNotNull(), a).otherwise(_uncited(cited)), quote,
                    ),
                ),
            )

        return let(coerce_reply(entry["value"], f["type"]), build)

    return F.when(reply.isNotNull(), compact(F.transform(wanted, one))).otherwise(no_candidates())


def _uncited(block_id: Column) -> Column:
    null = F.lit(None)
    return F.struct(
        null.cast("int").alias("block_ix"), block_id.alias("block_id"), F.lit(1).alias("page"),
        *(null.cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")),
        null.cast("string").alias("text"), null.cast("string").alias("section_label"),
        null.cast("double").alias("font_size_max"),
    )


def merge_page_replies(replies: DataFrame, key: str = "doc_id") -> DataFrame:
    """First value per field in page order, from ``(key, page, fields MAP<STRING,STRING>)``.

    ``min_by`` combines on the map side, so many pages of one document do not pile up in a task.
    """
    pairs = replies.select(key, "page", F.explode("fields").alias("field", "raw")).filter("raw is not null")
    return pairs.groupBy(key, "field").agg(
        F.min_by("raw", "page").alias("raw"), F.lit("vision").alias("source"),
        F.lit(PAGE_REPLY_CONFIDENCE).alias("confidence"),
    )


def page_reply_candidates(merged: Column, fields: Column, first_page: Column) -> Column:
    """Merged page replies as candidates; their evidence is the first page as a whole."""
    null = F.lit(None)
    page = first_page.cast("int")
    whole_page = F.struct(
        null.cast("int").alias("block_ix"), F.concat(F.lit("vision-p"), page.cast("string")).alias("block_id"),
        page.alias("page"), *(null.cast("double").alias(k) for k in ("x0", "y0", "x1", "y1")),
        F.lit("vision").alias("section_label"),
    )
    note = F.concat(F.lit("vision extraction (page "), page.cast("string"), F.lit(")"))

    def one(f: Column) -> Column:
        raw = F.try_element_at(merged, f["name"])
        v = F.when(raw.isNotNull(), coerce_reply(raw, f["type"]))
        return let(
            v, lambda x: F.when(is_set(x), candidate(f["name"], x, "vision", PAGE_REPLY_CONFIDENCE, whole_page, note))
        )

    return F.when(merged.isNotNull(), compact(F.transform(fields, one))).otherwise(no_candidates())


def region_roles(replies: DataFrame, key: str = "doc_id", body: str = "reply") -> DataFrame:
    """Document-context replies to ``(key, role, description, block_id)`` rows."""
    parsed = F.from_json(F.col(body), CONTEXT_TYPE)
    regions = replies.select(key, F.inline(parsed["regions"]))
    role = F.coalesce(strip(F.nullif(F.col("role"), F.lit(""))), F.lit("unknown"))
    return regions.select(
        key,
        role.alias("role"),
        F.coalesce(F.nullif(strip("description"), F.lit("")), role).alias("description"),
        F.explode(F.filter("block_ids", lambda b: F.coalesce(b, F.lit("")) != "")).alias("block_id"),
    )


# ---- table operators -------------------------------------------------------------------------


def _table(df: DataFrame, checklist: Checklist, build: Callable[[Column, Column], Column], key: str) -> DataFrame:
    found = let(F.col("blocks"), lambda bs: let(spec_column(checklist)["fields"], lambda fs: build(bs, fs)))
    return flat_candidates(df.select(key, F.posexplode(found).alias("cand_ix", "c")), key)


def flat_candidates(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, cand_ix, c)`` with the candidate spread over flat columns."""
    return df.select(
        key, F.col("cand_ix"), "c.field", F.col("c.value.num").alias("value_num"), F.col("c.value.str").alias("value_str"),
        *(f"c.{k}" for k in ("source", "confidence", "block_ix", "block_id", "page", "evidence_text", "x0", "y0", "x1", "y1", "section_label")),
    )


def extract_regex(df: DataFrame, checklist: Checklist, key: str = "doc_id") -> DataFrame:
    return _table(df, checklist, schema_regex, key)


def extract_spanish_dates(df: DataFrame, checklist: Checklist, key: str = "doc_id") -> DataFrame:
    return _table(
        df, checklist, lambda b, fs: F.flatten(F.transform(fs, lambda f: spanish_date_candidates(b, f))), key
    )


def extract_labels(df: DataFrame, checklist: Checklist, key: str = "doc_id", places: str | None = None) -> DataFrame:
    """Candidates by label; ``places`` is the column that ``labels.label_places`` adds for checklists of many labels."""
    if places is None:
        return _table(df, checklist, schema_labels, key)
    return _table(df, checklist, lambda b, fs: let(F.col(places), lambda p: schema_labels(b, fs, p)), key)


def extract_measurements(df: DataFrame, key: str = "doc_id") -> DataFrame:
    found = let(F.col("blocks"), measurement_regex)
    return flat_candidates(df.select(key, F.posexplode(found).alias("cand_ix", "c")), key)


def extract_measurement_lines(df: DataFrame, key: str = "doc_id") -> DataFrame:
    found = let(F.col("blocks"), measurement_lines)
    return flat_candidates(df.select(key, F.posexplode(found).alias("cand_ix", "c")), key)


def extract_all(df: DataFrame, checklist: Checklist, key: str = "doc_id", measurements: bool = True) -> DataFrame:
    return _table(df, checklist, lambda b, fs: ensemble(b, fs, measurements), key)


def guard_totals(cands: DataFrame, text: str = "block_text") -> DataFrame:
    """Drop amounts whose block speaks of subtotals or unit prices and not of the total."""
    return cands.filter(total_in_context(F.col(text)))


def label_table(fields: DataFrame, key: str = "spec_id") -> DataFrame:
    """Ordered labels per field of a catalogue ``(key, field, aliases)``: name, aliases or built-ins."""
    from docaudit.plans.checklist import BUILTIN_LABELS

    builtin = F.lit(None).cast("array<string>")
    for name, labels in BUILTIN_LABELS.items():
        builtin = F.when(F.col("field") == name, F.array(*map(F.lit, labels))).otherwise(builtin)
    own = F.when(F.size("aliases") > 0, F.col("aliases"))
    raw = F.concat(
        F.array(F.replace("field", F.lit("_"), F.lit(" "))), F.coalesce(own, builtin, F.array().cast("array<string>"))
    )
    tidy = F.filter(F.transform(raw, strip), lambda t: t != "")

    def unique(ls: Column) -> Column:
        low = F.transform(ls, F.lower)
        return let(low, lambda lo: F.filter(ls, lambda _, i: F.array_position(lo, F.get(lo, i)) == i + 1))

    return fields.select(key, "field", F.posexplode(let(tidy, unique)).alias("label_ix", "label"))
