"""Text helpers. Everything here is a built-in expression and runs inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when trimming and splitting.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Characters that end a line, next to the pair CR LF.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# Patterns of the characters that may need translation; a range is tried faster than a list.
UNUSUAL, UNUSUAL_IN_LINES = "[^ -~]", "[^\n -~]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Inside lambdas Spark does not share common subexpressions, and the optimizer may inline a
    projected column into a lambda where it would run once per element. An aggregate over nothing
    whose start value is ``value`` binds it to a variable: evaluated once, and neither wrapped in an
    array nor copied, as a one-element ``transform`` would.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, lambda bound: body(bound))


def exploding(arr: Column) -> Column:
    """Input for ``explode`` of a computed array.

    For a plain attribute Spark infers a non-empty filter and pushes it below, where the expression
    behind the attribute would be computed a second time.
    """
    return let(arr, lambda a: a)


def first(arr: Column) -> Column:
    """First element or NULL."""
    return F.get(arr, F.lit(0))


def compact(arr: Column) -> Column:
    """Drop NULL elements."""
    return F.filter(arr, lambda x: x.isNotNull())


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def trimmed(col: Column) -> Column:
    """``strip`` for texts inside a lambda: most begin and end with a visible ASCII character and are left as they are."""

    def visible(t: Column) -> Column:
        # By the first byte: comparisons copy nothing.
        return (t >= "!") & (t < "\x7f")

    return let(col, lambda t: F.when(visible(t) & visible(F.substring(t, -1, 1)), t).otherwise(strip(t)))


def filled(col: Column) -> Column:
    """The text, NULL when empty. Unlike ``nullif``, inside a lambda it evaluates the text once."""
    return let(col, lambda t: F.when(t != "", t))


def blank_to_null(col: Column) -> Column:
    return filled(trimmed(col))


def words(col: Column) -> Column:
    """White-space separated tokens. Translating first, where need be, keeps ``split`` on its single-character path."""
    blanks = F.when(col.rlike(UNUSUAL), F.translate(col, WHITESPACE, " " * len(WHITESPACE))).otherwise(col)
    return F.filter(F.split(blanks, " "), lambda t: t != "")


def squeeze(col: Column) -> Column:
    """Trim and reduce inner white space to single blanks."""
    return F.array_join(words(col), " ")


def lines(col: Column) -> Column:
    joined = F.replace(col, F.lit("\r\n"), F.lit("\n"))
    feeds = F.when(col.rlike(UNUSUAL_IN_LINES), F.translate(joined, LINE_ENDS, "\n" * len(LINE_ENDS))).otherwise(col)
    return F.split(feeds, "\n")


def first_line(col: Column) -> Column:
    """First line of the trimmed text, trimmed."""
    return trimmed(let(strip(col), lambda t: first(lines(t))))


def group0_or(col: Column, pattern: str | Column, group: int = 0) -> Column:
    """``regexp_extract`` that yields NULL instead of '' when nothing matched."""
    if isinstance(pattern, Column):
        return filled(F.call_function("regexp_extract", col, pattern, F.lit(group)))
    return filled(F.regexp_extract(col, pattern, group))


def slug(col: Column) -> Column:
    """``Lower bound`` → ``lower_bound``."""
    return F.btrim(F.regexp_replace(F.lower(strip(col)), "[^a-zA-Z0-9]+", "_"), F.lit("_"))


def field_key(col: Column) -> Column:
    """Field-name normalisation used when candidates are matched to a checklist."""
    return strip(F.translate(F.lower(col), " -", "__"))


def fingerprint(col: Column) -> Column:
    """Content hash with its algorithm prefix."""
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def number_text(num: Column) -> Column:
    """Numbers as people write them: whole values without a fraction."""
    return F.when(F.abs(num - F.rint(num)) < 1e-9, F.rint(num).cast("long").cast("string")).otherwise(
        num.cast("string")
    )
