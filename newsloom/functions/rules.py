"""Include/exclude keyword rules compiled to boolean Columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.columns import let
from newsloom.functions.text import fold, fold_text

# Bounds of one rule set, include and exclude together.
MAX_DEPTH = 8
MAX_NODES = 128
MAX_KEYWORDS = 500
MAX_KEYWORD_LENGTH = 256
GROUPS = ("all", "any")
LEAVES = ("contains_any", "contains_all")
FIELDS = ("title", "description", "link")


@dataclass(frozen=True)
class RuleSet:
    """Rule trees as plain dicts: {op, rules} for groups, {op, field, keywords} for leaves."""

    include: dict | None = None
    exclude: dict | None = None

    def __bool__(self) -> bool:
        return self.include is not None or self.exclude is not None


def _reads(rule: dict | None, field: str) -> bool:
    if rule is None:
        return False
    if rule["op"] in GROUPS:
        return any(_reads(r, field) for r in rule["rules"])
    return rule["field"] == field


def _escape(ch: str) -> str:
    return ch if ch.isalnum() else "\\" + ch if ord(ch) < 128 else ch


def keyword_pattern(words: list[str], depth: int = 12) -> str:
    """A regular expression for any of the words, with shared beginnings factored out.

    A text position is rejected by one character class instead of one test per word.
    A word that another one starts with makes the longer one redundant.
    """
    kept: list[str] = []
    for word in sorted(set(words)):
        if not (kept and word.startswith(kept[-1])):
            kept.append(word)

    def build(rest: list[str], level: int) -> str:
        if len(rest) == 1 or level == depth:
            return "|".join("".join(map(_escape, w)) for w in rest)
        heads: dict[str, list[str]] = {}
        for w in rest:
            heads.setdefault(w[0], []).append(w[1:])
        parts = []
        for ch, tails in heads.items():
            inner = "" if tails == [""] else build(tails, level + 1)
            parts.append(_escape(ch) + (f"(?:{inner})" if "|" in inner else inner))
        ahead = f"(?=[{''.join(map(_escape, heads))}])" if len(heads) > 2 else ""
        return ahead + (f"(?:{'|'.join(parts)})" if len(parts) > 1 and ahead else "|".join(parts))

    return build(kept, 0)


def leaf(value: Column, op: str, keywords: list[str]) -> Column:
    """Literal substrings of folded keywords in an already folded value."""
    folded = [fold_text(k) for k in keywords]
    if op == "contains_any" and len(folded) > 8:
        return value.rlike(keyword_pattern(folded))
    return reduce(or_ if op == "contains_any" else and_, [F.contains(value, F.lit(k)) for k in folded])


def _cost(rule: dict) -> int:
    return 1 if _reads(rule, "description") else 0


def matches(rule: dict, values: dict[str, Column]) -> Column:
    if rule["op"] in GROUPS:
        # Leaves on short fields first: And/Or stop at the first decisive side.
        parts = [matches(r, values) for r in sorted(rule["rules"], key=_cost)]
        return reduce(and_ if rule["op"] == "all" else or_, parts)
    return leaf(values[rule["field"]], rule["op"], rule["keywords"])


def reason_text(rule: dict, excluded: bool) -> str:
    """Why a story was dropped; never quotes keywords or source text."""
    if rule["op"] in GROUPS:
        return "an exclude rule applies" if excluded else "no include rule applies"
    name, side = rule["field"], "exclude" if excluded else "include"
    every = rule["op"] == "contains_all"
    if excluded:
        return f"{name} holds {'all' if every else 'some'} of the {side} keywords"
    return f"{name} lacks {'some' if every else 'all'} of the {side} keywords"


def decide(rules: RuleSet, title: Column, description: Column, link: Column) -> Column:
    """NULL for a kept story, else the reason it is dropped."""
    if not rules:
        return F.lit(None).cast("string")
    inputs = {"title": title, "description": description, "link": link}
    read = [f for f in FIELDS if _reads(rules.include, f) or _reads(rules.exclude, f)]
    if not read:
        return F.lit(None).cast("string")
    folded = F.struct(*[fold(F.coalesce(inputs[f], F.lit(""))).alias(f) for f in read])

    def verdict(v: Column) -> Column:
        values = {f: v[f] for f in read}
        out = F.lit(None).cast("string")
        if rules.exclude is not None:
            out = F.when(matches(rules.exclude, values), F.lit(reason_text(rules.exclude, True)))
        if rules.include is not None:
            out = F.when(~matches(rules.include, values), F.lit(reason_text(rules.include, False))).otherwise(out)
        return out

    return let(folded, verdict)


def problems(include: dict | None, exclude: dict | None) -> list[str]:
    """What is wrong with a rule set: bounds over both sides together, and malformed nodes."""
    found: dict[str, None] = {}
    counts = {"nodes": 0, "keywords": 0}

    def walk(rule: object, depth: int) -> None:
        counts["nodes"] += 1
        if depth > MAX_DEPTH:
            found["depth"] = None
            return
        if not isinstance(rule, dict) or rule.get("op") not in (*GROUPS, *LEAVES):
            found["operator"] = None
            return
        words, inner = rule.get("keywords") or [], rule.get("rules") or []
        if not isinstance(words, list) or not isinstance(inner, list) or set(rule) - {"op", "rules", "field", "keywords"}:
            found["shape"] = None
            return
        group = rule["op"] in GROUPS
        counts["keywords"] += len(words)
        if group and (not inner or words or rule.get("field")):
            found["group"] = None
        if not group and (inner or not words):
            found["leaf"] = None
        if not group and rule.get("field") not in FIELDS:
            found["field"] = None
        if any(not isinstance(w, str) or not w.strip() or len(w.strip()) > MAX_KEYWORD_LENGTH for w in words):
            found["keyword text"] = None
        for child in inner:
            walk(child, depth + 1)

    for side in (include, exclude):
        if side is not None:
            walk(side, 1)
    found |= {name: None for name, most in (("nodes", MAX_NODES), ("keywords", MAX_KEYWORDS)) if counts[name] > most}
    return list(found)


def combine(own: RuleSet | None, shared: list[RuleSet]) -> RuleSet:
    """Own rules and library filters as one set: includes under all, excludes under any."""

    def join(op: str, parts: list[dict]) -> dict | None:
        if len(parts) < 2:
            return parts[0] if parts else None
        rules: list[dict] = []
        for part in parts:
            rules.extend(part["rules"] if part["op"] == op else [part])
        return {"op": op, "rules": rules}

    if not shared:
        return own or RuleSet()
    sets = ([own] if own else []) + list(shared)
    return RuleSet(
        join("all", [s.include for s in sets if s.include is not None]),
        join("any", [s.exclude for s in sets if s.exclude is not None]),
    )
