"""Checklist rule strings as Spark Columns.

The grammar work is left to Python's own ``ast`` module; this file only admits the few node types
a rule may use and gives each of them its rule semantics. Types are static (every name is a
number), so misuse of booleans is found when the rule is compiled, not per row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number_text

# Tolerances of the comparison operators.
EQUAL_TOLERANCE = 1e-9
ORDER_TOLERANCE = 1e-12

_TOKEN = re.compile(r"\s+|(?P<word>[^\W\d]\w*)|\d[\d.]*|\.\d[\d.]*|==|!=|>=|<=|[-+*/()<>]")
_PREFIX = "f_"


class RuleSyntaxError(ValueError):
    """The rule text is not a valid expression."""


@dataclass(frozen=True)
class Rule:
    """A compiled rule. ``column(lookup)`` is TRUE when it holds, FALSE when it fails or errs."""

    text: str
    names: tuple[str, ...]
    column: Callable[[Callable[[str], Column]], Column]


def _python_source(text: str) -> str:
    out, pos = [], 0
    text = text.strip()
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if m is None:
            raise RuleSyntaxError(f"unexpected character {text[pos]!r}")
        word = m.group("word")
        if word is None:
            if m.group(0).strip("0123456789.") == "":
                try:
                    out.append(repr(float(m.group(0))))
                except ValueError as exc:
                    raise RuleSyntaxError(f"bad number {m.group(0)!r}") from exc
            else:
                out.append(m.group(0))
        elif word.upper() in ("AND", "OR", "NOT"):
            out.append(f" {word.lower()} ")
        else:
            out.append(_PREFIX + word)
        pos = m.end()
    return "".join(out).strip()


def _tree(text: str) -> ast.expr:
    source = _python_source(text)
    if "**" in source or "//" in source:
        raise RuleSyntaxError("unsupported operator")
    try:
        return ast.parse(source, mode="eval").body
    except SyntaxError as exc:
        raise RuleSyntaxError(str(exc)) from exc


def _names(tree: ast.expr) -> tuple[str, ...]:
    return tuple(sorted({n.id[len(_PREFIX) :] for n in ast.walk(tree) if isinstance(n, ast.Name)}))


_COMPARE = {
    ast.Eq: lambda a, b: F.abs(a - b) <= EQUAL_TOLERANCE,
    ast.NotEq: lambda a, b: F.abs(a - b) > EQUAL_TOLERANCE,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b + ORDER_TOLERANCE,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a + ORDER_TOLERANCE >= b,
}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
}


class _Misuse(Exception):
    """Booleans where numbers belong or the reverse: such a rule always fails."""


def _emit(node: ast.expr, lookup: Callable[[str], Column], guards: list[Column]) -> tuple[Column, str]:
    def operand(child: ast.expr, kind: str) -> Column:
        col, got = _emit(child, lookup, guards)
        if got != kind:
            raise _Misuse
        return col

    if isinstance(node, ast.Constant):
        return F.lit(float(node.value)), "number"
    if isinstance(node, ast.Name):
        return lookup(node.id[len(_PREFIX) :]), "number"
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~operand(node.operand, "bool"), "bool"
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.UAdd | ast.USub):
        inner = operand(node.operand, "number")
        return (-inner if isinstance(node.op, ast.USub) else inner), "number"
    if isinstance(node, ast.BinOp):
        left, right = operand(node.left, "number"), operand(node.right, "number")
        if isinstance(node.op, ast.Div):
            guards.append(right != 0.0)
        return _ARITHMETIC[type(node.op)](left, right), "number"
    if isinstance(node, ast.Compare):
        return _COMPARE[type(node.ops[0])](operand(node.left, "number"), operand(node.comparators[0], "number")), "bool"
    assert isinstance(node, ast.BoolOp)
    parts = [operand(v, "bool") for v in node.values]
    joined = parts[0]
    for p in parts[1:]:
        joined = (joined & p) if isinstance(node.op, ast.And) else (joined | p)
    return joined, "bool"


def _admit(tree: ast.expr) -> None:
    """Refuse everything outside the rule vocabulary before a Column is built."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Compare):
            if len(node.ops) != 1 or type(node.ops[0]) not in _COMPARE:
                raise RuleSyntaxError("comparisons take two operands")
        elif isinstance(node, ast.BinOp):
            if type(node.op) not in _ARITHMETIC:
                raise RuleSyntaxError("unsupported operator")
        elif not isinstance(
            node,
            ast.BoolOp | ast.UnaryOp | ast.Name | ast.Constant | ast.expr_context | ast.operator | ast.unaryop
            | ast.cmpop | ast.boolop,
        ):
            raise RuleSyntaxError("unsupported construct")


_SYMBOL = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=",
    ast.Gt: ">", ast.GtE: ">=", ast.And: "and", ast.Or: "or", ast.Not: "not", ast.USub: "neg",
}


def _steps(node: ast.expr, wanted: str) -> list[dict]:
    """Operands before their operator. Kinds are checked as for Columns."""
    if isinstance(node, ast.Constant):
        kind, out = "number", [{"op": "number", "num": float(node.value)}]
    elif isinstance(node, ast.Name):
        kind, out = "number", [{"op": "field", "name": node.id[len(_PREFIX) :]}]
    elif isinstance(node, ast.UnaryOp):
        kind = "bool" if isinstance(node.op, ast.Not) else "number"
        out = _steps(node.operand, kind) + ([] if isinstance(node.op, ast.UAdd) else [{"op": _SYMBOL[type(node.op)]}])
    elif isinstance(node, ast.BinOp):
        kind = "number"
        out = _steps(node.left, kind) + _steps(node.right, kind) + [{"op": _SYMBOL[type(node.op)]}]
    elif isinstance(node, ast.Compare):
        kind = "bool"
        out = _steps(node.left, "number") + _steps(node.comparators[0], "number") + [{"op": _SYMBOL[type(node.ops[0])]}]
    else:
        assert isinstance(node, ast.BoolOp)
        kind, out = "bool", _steps(node.values[0], "bool")
        for v in node.values[1:]:
            out += _steps(v, "bool") + [{"op": _SYMBOL[type(node.op)]}]
    if kind != wanted:
        raise _Misuse
    return out


def rule_program(text: str) -> tuple[tuple[str, ...], list[dict]]:
    """Names and steps of a rule as data; see ``run_program``. A rule that misuses booleans always fails."""
    tree = _tree(text)
    _admit(tree)
    try:
        return _names(tree), _steps(tree, "bool")
    except _Misuse:
        return _names(tree), [{"op": "number", "num": 0.0}]


PROGRAM_TYPE = "array<struct<op:string,num:double,name:string>>"
_STATE = "struct<stack:array<double>,sound:boolean>"


def run_program(steps: Column, value_of: Callable[[Column], Column]) -> Column:
    """Fold the steps of a rule over a stack; TRUE when it holds, FALSE when it fails or errs. Booleans are 0 and 1.

    The rule is a value of the row, so one plan serves rules of any number and form.
    """

    def step(state: Column, x: Column) -> Column:
        stack, op = state["stack"], x["op"]
        a, b = F.try_element_at(stack, F.lit(-2)), F.try_element_at(stack, F.lit(-1))
        truth = lambda c: F.when(c, 1.0).otherwise(0.0)
        value = F.when(op == "number", x["num"]).when(op == "field", value_of(x["name"])).when(op == "neg", -b).when(op == "not", 1.0 - b)
        for kind, fn in _ARITHMETIC.items():
            value = value.when(op == _SYMBOL[kind], fn(a, b))
        for kind, fn in _COMPARE.items():
            value = value.when(op == _SYMBOL[kind], truth(fn(a, b)))
        value = value.when(op == "and", F.least(a, b)).when(op == "or", F.greatest(a, b))
        taken = F.when(op.isin("number", "field"), 0).when(op.isin("neg", "not"), 1).otherwise(2)
        below = F.slice(stack, F.lit(1), F.size(stack) - taken)
        # A zero divisor is an error even where a boolean operator would have hidden it.
        sound = state["sound"] & ~((op == "/") & (b == 0.0))
        return F.struct(F.concat(below, F.array(F.coalesce(value, F.lit(0.0)))).alias("stack"), sound.alias("sound")).cast(_STATE)

    start = F.struct(F.array().cast("array<double>").alias("stack"), F.lit(True).alias("sound")).cast(_STATE)
    return F.aggregate(steps, start, step, lambda s: s["sound"] & F.coalesce(F.try_element_at(s["stack"], F.lit(-1)) == 1.0, F.lit(False)))


def compile_rule(text: str) -> Rule:
    """Parse ``text``; raises :class:`RuleSyntaxError` when it is malformed."""
    tree = _tree(text)
    _admit(tree)

    def column(lookup: Callable[[str], Column]) -> Column:
        guards: list[Column] = []
        try:
            col, kind = _emit(tree, lookup, guards)
        except _Misuse:
            return F.lit(False)
        if kind != "bool":
            return F.lit(False)
        # A zero divisor is an error even where a boolean operator would have hidden it.
        for g in guards:
            col = col & g
        return F.coalesce(col, F.lit(False))

    return Rule(text, _names(tree), column)


def rule_column(text: str) -> Column:
    """The rule over columns of a wide table that carry the field names."""
    return compile_rule(text).column(F.col)


def rule_names(text: str) -> tuple[str, ...]:
    """Identifiers a rule refers to, sorted."""
    return compile_rule(text).names


_PLACEHOLDER = re.compile(r"\{([a-zA-Z0-9_]+)\}")


def interpolate(template: str, lookup: dict[str, Column]) -> Column:
    """Fill ``{field}`` marks; unknown marks stay as they are. Values may be numbers or texts."""
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos : m.start()]))
        known = lookup.get(m.group(1))
        parts.append(F.lit(m.group(0)) if known is None else known)
        pos = m.end()
    if pos < len(template) or not parts:
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


TEMPLATE_TYPE = "array<struct<text:string,name:string>>"


def template_parts(template: str, known: Sequence[str]) -> list[dict]:
    """A message as data: texts, and names of fields to be filled in. Unknown marks stay texts."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        parts.append({"text": template[pos : m.start()]})
        parts.append({"name": m.group(1)} if m.group(1) in known else {"text": m.group(0)})
        pos = m.end()
    return [p for p in [*parts, {"text": template[pos:]}] if p.get("text") or p.get("name")]


def filled(parts: Column, value_of: Callable[[Column], Column]) -> Column:
    """A message with its fields' values; NULL if one of them has none, as with ``interpolate``."""
    texts = F.transform(parts, lambda p: F.when(p["name"].isNotNull(), value_of(p["name"])).otherwise(p["text"]))
    return F.when(F.forall(texts, lambda t: t.isNotNull()), F.array_join(texts, ""))


def interpolate_numbers(template: str, lookup: dict[str, Column]) -> Column:
    return interpolate(template, {k: number_text(v.cast("double")) for k, v in lookup.items()})
