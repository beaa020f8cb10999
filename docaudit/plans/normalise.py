"""A checklist body repaired on the driver before a run, by the rules of the catalogue's normalisation."""

from __future__ import annotations

import re
from collections.abc import Mapping

from docaudit.operators import checklists as c

DEFAULT_RULES = ("required", "range_validation", "type_check")


def _text(value: object) -> str:
    return str(value or "").strip()


def _open_ended(name: str, entry: Mapping, moved: bool) -> dict:
    """Prompt and flags filled in; a field that was declared open-ended brings its description as prompt."""
    words = name.replace("_", " ").strip()
    given = [entry.get("extract_prompt"), *([entry.get("description"), f"Extract {words}"] if moved else [])]
    prompts = [*given, *(entry.get(p) for p in c.PROMPT_COLUMNS), f"Extract the {words} from the document."]
    out = dict(entry) | {"extract_prompt": next(filter(None, map(_text, prompts)))}
    if not _text(entry.get("evaluate_prompt")) and entry.get("informative_only") is not False:
        out["informative_only"] = True
    if entry.get("link_evidence") is None and out.get("informative_only"):
        out["link_evidence"] = True
    return out


def _equality(entry: Mapping) -> dict:
    """``equals`` rules of a field as bounds or as a literal pattern."""
    out = {k: v for k, v in entry.items() if k != "rules"}
    rules = entry.get("rules")
    for rule in rules if isinstance(rules, list) else ():
        if not isinstance(rule, Mapping) or _text(rule.get("rule_name")).lower() != "equals":
            continue
        wanted = rule.get("value")
        if entry.get("type") == "number":
            try:
                out["min"] = out["max"] = float(wanted)
            except (TypeError, ValueError):
                continue
        elif entry.get("type") == "string" and wanted is not None:
            out["regex_hint"] = "(?i)" + re.escape(str(wanted))
    return out


def _hinted(name: str, entry: Mapping) -> dict:
    """Default aliases, pattern, policy and hints of well-known fields where none are given."""
    if name not in c.DEFAULT_HINTS:
        return dict(entry)
    aliases, pattern, policy, gap_fill, hint = c.DEFAULT_HINTS[name]
    out = dict(entry)
    own, is_invoice = _text(entry.get("regex_hint")), name == "invoice_number"
    by_context = entry.get("llm_only") or is_invoice and (entry.get("llm_fallback") or _text(entry.get("extraction_hint")) and not own)
    if not entry.get("aliases"):
        out["aliases"] = list(aliases)
    if by_context:
        out.pop("regex_hint", None)
        out["llm_fallback"] = True
    else:
        anchored = re.search(r"(?i)(?:fecha|invoice|n[uú]mero|total|email|@)", own)
        if not own or not anchored and re.match(r"^(?:\(\?i\))?\[[^\]]+\]\+?$", own):
            out["regex_hint"] = pattern
        if entry.get("llm_fallback") is None and gap_fill is not None:
            out["llm_fallback"] = gap_fill
    if not _text(entry.get("on_ambiguity")) and policy:
        out["on_ambiguity"] = policy
    if not _text(entry.get("extraction_hint")) and (by_context or hint):
        out["extraction_hint"] = c.NO_PATTERN_HINT if by_context else hint
    return out


def _canonical(fields: Mapping) -> dict:
    """One entry for each canonical name: its own, else that of the first known synonym."""
    order = {"": 0} | {n: i for i, n in enumerate(c.FIELD_RENAMES, 1)}
    out: dict[str, tuple[int, dict]] = {}
    for name, entry in fields.items():
        target = c.FIELD_RENAMES.get(name, name)
        rank = order[name] if target != name else 0
        if target not in out or rank < out[target][0]:
            out[target] = (rank, entry)
    return {name: entry for name, (_, entry) in out.items()}


def _renamed(rule: object) -> object:
    """Canonical field names in a rule's text and list."""
    if not isinstance(rule, Mapping):
        return rule
    out = dict(rule)
    if isinstance(rule.get("expression"), str):
        out["expression"] = re.sub(r"\b(?:" + "|".join(map(re.escape, c.FIELD_RENAMES)) + r")\b", lambda m: c.FIELD_RENAMES[m[0]], rule["expression"])
    if isinstance(rule.get("fields"), list):
        out["fields"] = [c.FIELD_RENAMES.get(n, n) if isinstance(n, str) else n for n in rule["fields"]]
    return out


def normalised_body(body: Mapping) -> dict:
    """The body as a run reads it. Parts of the wrong shape stay as they are and are skipped later."""
    out = dict(body)
    fields = body.get("fields") if isinstance(body.get("fields"), Mapping) else {}
    good = {k: v for k, v in fields.items() if isinstance(v, Mapping)}
    open_ended = dict(body["open_ended"]) if isinstance(body.get("open_ended"), Mapping) else {}
    moved = {k: v for k, v in good.items() if _text(v.get("type")).lower() == "open_ended"}
    prompts = {k: _open_ended(k, v, False) for k, v in open_ended.items() if isinstance(v, Mapping) and k not in moved}
    prompts |= {k: _open_ended(k, v, True) for k, v in moved.items()}
    if prompts:
        out |= {"open_ended": prompts, "version": "3"}
    if not isinstance(body.get("rules"), list) or not body["rules"]:
        out["rules"] = list(DEFAULT_RULES)
    strict = {k: _equality(v) for k, v in good.items() if k not in moved}
    if fields:
        out["fields"] = {k: _hinted(k, v) for k, v in _canonical(strict).items()}
    if isinstance(body.get("cross_field_rules"), list):
        out["cross_field_rules"] = [_renamed(r) for r in body["cross_field_rules"]]
    return out
