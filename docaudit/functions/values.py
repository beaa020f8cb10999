"""Field values: coercion, comparison, canonical form.

A value is ``struct(num DOUBLE, str STRING)`` with at most one side set, because an extracted
value is either a number or a text and the two never compare equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, group0_or, let, number_text, squeeze, strip, trimmed

VALUE_TYPE = "struct<num:double,str:string>"

# Fixed value: comparison tolerance.
NUMERIC_TOLERANCE = 0.001

USD_AMOUNT = r"(?i)USD\s*([\d,]+\.?\d*)"
PLAIN_NUMBER = r"[\d.]+"
STRICT_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPANISH_DATE_FRAGMENT = r"(?Ui)(\d{1,2}\s+de\s+\w+\s+de\s+\d{4})"
INVOICE_ID = r"(?i)^([A-Z0-9]+(?:-\d+)+|[A-Z0-9]{2,}(?:-[A-Z0-9]+)*)"


def value(num: Column | None = None, text: Column | None = None) -> Column:
    n = F.lit(None) if num is None else num
    s = F.lit(None) if text is None else text
    return F.struct(n.cast("double").alias("num"), s.cast("string").alias("str"))


def is_set(v: Column) -> Column:
    return v["num"].isNotNull() | v["str"].isNotNull()


def text_of(v: Column) -> Column:
    return F.coalesce(v["str"], number_text(v["num"]))


def equivalent(a: Column, b: Column) -> Column:
    """Numbers within the tolerance, texts exactly; a number never equals a text."""
    return F.coalesce(F.abs(a["num"] - b["num"]) <= NUMERIC_TOLERANCE, a["str"] == b["str"], F.lit(False))


def parse_number(raw: Column) -> Column:
    """Amount after ``USD`` if there is one, else the first digit run; NULL when it is no number.

    Once ``USD x`` matched there is no second try, and ``1.2.3`` or ``.`` give NULL.
    """

    def parse(t: Column) -> Column:
        chunk = F.coalesce(
            group0_or(t, USD_AMOUNT, 1), group0_or(F.replace(t, F.lit(","), F.lit("")), PLAIN_NUMBER)
        )
        return F.replace(chunk, F.lit(","), F.lit("")).try_cast("double")

    return let(trimmed(raw), parse)


def strict_number(token: Column) -> Column:
    """Whole-token number. Spark alone would also take ``1d`` and ``inf``."""
    return F.when(token.rlike(STRICT_NUMBER), token.try_cast("double"))


def coerce(raw: Column, typ: Column) -> Column:
    """Raw text to a value of the declared field type."""
    t = blank_to_null(raw)
    return F.when(typ == "number", value(parse_number(raw))).otherwise(value(None, t))


def coerce_reply(raw: Column, typ: Column) -> Column:
    """Coercion of a model reply: the whole text must be the number."""
    t = blank_to_null(raw)
    number = strict_number(strip(F.replace(raw, F.lit(","), F.lit(""))))
    return F.when(typ == "number", value(number)).otherwise(value(None, t))


def canonical(field: Column, v: Column) -> Column:
    """Form in which readings of one field are compared, so glued text makes no false conflict."""
    is_invoice_number = (field == "invoice_number") | (field.contains("invoice") & field.contains("number"))
    invoice_id = F.when(
        is_invoice_number, group0_or(strip(F.coalesce(v["str"], v["num"].cast("string"))), INVOICE_ID, 1)
    )
    dated = F.lower(field).contains("date") | F.lower(field).contains("fecha")
    text = let(squeeze(v["str"]), lambda flat: F.coalesce(
        invoice_id, F.when(dated, F.lower(group0_or(flat, SPANISH_DATE_FRAGMENT, 1))), flat
    ))
    return F.when(v["str"].isNull() & ~is_invoice_number, value(v["num"])).otherwise(
        let(text, lambda t: value(F.when(t.isNull(), v["num"]), t))
    )


def dedupe_key(field: Column, v: Column) -> Column:
    """Grouping key of equal readings: ``n:`` + rounded number or ``s:`` + lower-case text. Whole numbers are not rounded."""

    def rounded(n: Column) -> Column:
        return F.when(n == F.rint(n), n + F.lit(0.0)).otherwise(F.round(n, 6))

    return let(
        canonical(field, v),
        lambda c: F.coalesce(
            F.concat(F.lit("s:"), F.lower(c["str"])), F.concat(F.lit("n:"), rounded(c["num"]).cast("string"))
        ),
    )
