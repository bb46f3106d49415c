"""CSS and XPath selectors as Column expressions over a page's node list.

A selector compiles, on the driver, to nested array filters: a compound selector
is a predicate on a node, a combinator asks for nodes below, beside or above the
matches of the step before, found by running maxima and sorts over the list. Matching
never joins or shuffles; the relational form (one row per node) is ``operators.dom.contains_join``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.columns import let
from newsloom.functions.markup import NODE, NODES, is_text, joined_text, subtree
from newsloom.functions.scans import among, grouped_places, marked, next_place, running_max
from newsloom.functions.text import collapse, strip



class Loose:
    """A node list with gaps, as cleanup leaves it: positions are no longer indexes."""

    def __init__(self, array: Column) -> None:
        self.array = array


Nodes = Column | Loose
Predicate = Callable[[Nodes, Column], Column]


def _list(nodes: Nodes) -> Column:
    return nodes.array if isinstance(nodes, Loose) else nodes


def _below(nodes: Nodes, node: Column) -> Column:
    if isinstance(nodes, Loose):
        return F.filter(nodes.array, lambda n: (node["pre"] <= n["pre"]) & (n["pre"] <= node["last"]))
    return subtree(nodes, node)


def _text_of(nodes: Nodes, node: Column) -> Column:
    return joined_text(_below(nodes, node))


_IDENT = r"(?:\\.|[\w-]|[^\x00-\x7F])+"
_COMPOUND = re.compile(
    r"(?P<tag>\*|" + _IDENT + r")|\#(?P<id>" + _IDENT + r")|\.(?P<cls>" + _IDENT + r")"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*!]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]"
    r"|:(?P<pseudo>[\w-]+)(?P<open>\()?"
)


class SelectorError(ValueError):
    """The selector is not one this library reads."""


class NotAsData(SelectorError):
    """The selector can be read, but not by the programs of ``functions.programs``."""


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _argument(text: str, start: int) -> tuple[str, int]:
    depth, at = 1, start
    quote = None
    while at < len(text):
        ch = text[at]
        if quote:
            quote = None if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                return text[start:at], at + 1
        at += 1
    raise SelectorError(f"unclosed parenthesis in {text!r}")


def _nth(formula: str, ordinal: Column) -> Column:
    formula = formula.replace(" ", "").lower()
    formula = {"odd": "2n+1", "even": "2n"}.get(formula, formula)
    found = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", formula)
    if not found or formula == "":
        raise SelectorError(f"bad position {formula!r}")
    step_text, shift = found.group(1), int(found.group(2) or 0)
    if step_text is None:
        return ordinal == shift
    step = int(step_text + "1") if step_text in ("", "+", "-") else int(step_text)
    if step == 0:
        return ordinal == shift
    return ((ordinal - shift) % abs(step) == 0) & ((ordinal - shift) * (1 if step > 0 else -1) >= 0)


def _attribute_test(node: Column, name: str, op: str | None, value: str) -> Column:
    held = F.try_element_at(node["attrs"], F.lit(name.lower()))
    present = held.isNotNull()
    if op is None:
        return present
    if op == "=":
        test = held == value
    elif op == "!=":
        return ~F.coalesce(held == value, F.lit(False))
    elif op == "~=":
        test = F.array_contains(F.split(held, "[ \\t\\n\\f\\r]+"), value) & F.lit(value != "")
    elif op == "|=":
        test = (held == value) | F.startswith(held, F.lit(value + "-"))
    elif op == "^=":
        test = F.startswith(held, F.lit(value)) & F.lit(value != "")
    elif op == "$=":
        test = F.endswith(held, F.lit(value)) & F.lit(value != "")
    else:
        test = held.contains(value) & F.lit(value != "")
    return present & F.coalesce(test, F.lit(False))


def _own_text(nodes: Nodes, node: Column) -> Column:
    return joined_text(F.filter(_below(nodes, node), lambda n: n["parent"] == node["pre"]))


def _pseudo(name: str, argument: str | None) -> Predicate:
    name = name.lower()
    positions = {
        "first-child": ("sib", "1"),
        "last-child": ("rsib", "1"),
        "first-of-type": ("tsib", "1"),
        "last-of-type": ("rtsib", "1"),
        "nth-child": ("sib", argument),
        "nth-last-child": ("rsib", argument),
        "nth-of-type": ("tsib", argument),
        "nth-last-of-type": ("rtsib", argument),
    }
    if name in positions:
        field, formula = positions[name]
        return lambda nodes, n: _nth(formula or "", n[field])
    if name == "only-child":
        return lambda nodes, n: (n["sib"] == 1) & (n["rsib"] == 1)
    if name == "only-of-type":
        return lambda nodes, n: (n["tsib"] == 1) & (n["rtsib"] == 1)
    if name == "root":
        return lambda nodes, n: n["parent"] == -1
    if name == "empty":
        return lambda nodes, n: n["last"] == n["pre"]
    text = _plain((argument or "").strip().strip("\"'"))
    if name == "contains":
        return lambda nodes, n: F.lower(_text_of(nodes, n)).contains(text.lower())
    if name in ("containsown", "contains-own"):
        return lambda nodes, n: F.lower(_own_text(nodes, n)).contains(text.lower())
    if name == "matches":
        return lambda nodes, n: _text_of(nodes, n).rlike(text)
    if name in ("matchesown", "matches-own"):
        return lambda nodes, n: _own_text(nodes, n).rlike(text)
    if name == "not":
        tests = [_compound(part.strip())[0] for part in _split(argument or "", ",")]
        return lambda nodes, n: ~_any([t(nodes, n) for t in tests])
    if name in ("is", "where"):
        tests = [_compound(part.strip())[0] for part in _split(argument or "", ",")]
        return lambda nodes, n: _any([t(nodes, n) for t in tests])
    if name in ("has", "haschild"):
        inner = [_steps(part.strip(), relative=True) for part in _split(argument or "", ",")]
        child_only = name == "haschild"

        def has(nodes: Nodes, n: Column) -> Column:
            found = []
            for steps in inner:
                if child_only:
                    steps = [(">", steps[0][1])] + steps[1:]
                # Only what lies below the node is walked.
                below = Loose(F.filter(_below(nodes, n), lambda s: s["pre"] != n["pre"]))
                found.append(F.size(_walk(below, steps, F.array(n))) > 0)
            return _any(found)

        return has
    raise SelectorError(f"unknown pseudo-class :{name}")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def _inside(node: Column, scope: Column) -> Column:
    return (scope["pre"] < node["pre"]) & (node["pre"] <= scope["last"])


def _compound(text: str) -> tuple[Predicate, int]:
    at, tests = 0, []
    while at < len(text):
        found = _COMPOUND.match(text, at)
        if not found or (found.group("tag") and at > 0):
            break
        at = found.end()
        if found.group("tag"):
            tag = _plain(found.group("tag")).lower()
            if tag != "*":
                tests.append(lambda nodes, n, tag=tag: n["tag"] == tag)
        elif found.group("id"):
            tests.append(lambda nodes, n, v=_plain(found.group("id")): F.coalesce(F.try_element_at(n["attrs"], F.lit("id")) == v, F.lit(False)))
        elif found.group("cls"):
            tests.append(lambda nodes, n, v=_plain(found.group("cls")): _attribute_test(n, "class", "~=", v))
        elif found.group("attr"):
            value = (found.group("val") or "").strip()
            value = value[1:-1] if value[:1] in "\"'" and value[:1] else value
            tests.append(lambda nodes, n, a=found.group("attr"), o=found.group("op"), v=value: _attribute_test(n, a, o, v))
        else:
            argument = None
            if found.group("open"):
                argument, at = _argument(text, at)
            tests.append(_pseudo(found.group("pseudo"), argument))
    if at == 0:
        raise SelectorError(f"cannot read selector at {text!r}")

    def predicate(nodes: Nodes, n: Column) -> Column:
        out = ~is_text(n)
        for test in tests:
            out = out & test(nodes, n)
        return out

    return predicate, at


def _split(text: str, separator: str) -> list[str]:
    parts, depth, quote, start = [], 0, None, 0
    for at, ch in enumerate(text):
        if quote:
            quote = None if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == separator and depth == 0:
            parts.append(text[start:at])
            start = at + 1
    return parts + [text[start:]]


def _steps(text: str, relative: bool = False) -> list[tuple[str, Predicate]]:
    steps, at, combinator = [], 0, " "
    lead = re.match(r"\s*([>+~])\s*", text) if relative else None
    if lead:
        combinator, at = lead.group(1), lead.end()
    text = text.rstrip()
    while at < len(text):
        predicate, used = _compound(text[at:])
        steps.append((combinator, predicate))
        at += used
        gap = re.match(r"\s*([>+~])\s*|\s+", text[at:])
        if at < len(text):
            if not gap:
                raise SelectorError(f"cannot read selector at {text[at:]!r}")
            combinator = gap.group(1) or " "
            at += gap.end()
            if at >= len(text):
                raise SelectorError(f"selector ends with a combinator: {text!r}")
    if not steps:
        raise SelectorError("empty selector")
    return steps


#: Anchors that are compared with every node one by one; more are looked up by scans.
FEW = 8
BELOW, CHILD, NEXT, LATER, EARLIER, PARENT, ABOVE = " ", ">", "+", "~", "preceding", "parent", "ancestor"


def _pair(relation: str, anchor: Column, node: Column) -> Column:
    """Whether node stands to anchor as the relation says."""
    if relation == BELOW:
        return _inside(node, anchor)
    if relation == ABOVE:
        return _inside(anchor, node)
    if relation == CHILD:
        return node["parent"] == anchor["pre"]
    if relation == PARENT:
        return anchor["parent"] == node["pre"]
    same = node["parent"] == anchor["parent"]
    if relation == NEXT:
        return same & (anchor["sib"] > 0) & (node["sib"] == anchor["sib"] + 1)
    return same & ((node["pre"] > anchor["pre"]) if relation == LATER else (node["pre"] < anchor["pre"]))


def _beside(listed: Column, flags: Column, relation: str) -> Column:
    """Flags of the nodes next to, after or before a flagged sibling: siblings meet in one sort by parent."""
    ahead = 1 if relation != EARLIER else -1
    rows = F.transform(listed, lambda n, i: F.struct(n["parent"].alias("parent"), (i * ahead).alias("at"), n["sib"].alias("sib"), F.get(flags, i).alias("on")))
    if relation == NEXT:
        # Elements only: text between two elements doesn't part them.
        rows = F.filter(rows, lambda r: r["sib"] > 0)

    def read(r: Column) -> Column:
        def one(seen: Column):
            def flag(x: Column, k: Column) -> Column:
                before = F.get(r, k - 1)
                hit = (before["on"] & (before["parent"] == x["parent"]) & (before["sib"] == x["sib"] - 1)) if relation == NEXT else F.get(seen, k - 1) == x["parent"]
                return F.struct((x["at"] * ahead).alias("i"), F.coalesce(hit, F.lit(False)).alias("on"))

            return F.transform(F.filter(F.transform(r, flag), lambda x: x["on"]), lambda x: x["i"])

        found = one(r) if relation == NEXT else let(running_max(F.transform(r, lambda x: F.when(x["on"], x["parent"]))), one)
        return marked(F.transform(listed, lambda n, i: i), found)

    return let(F.array_sort(rows), read)


def _related(nodes: Nodes, anchors: Column, relation: str) -> Column:
    """For every node of the list whether it stands to any anchor as the relation says."""
    listed = _list(nodes)

    def scan(flags: Column) -> Column:
        if relation == BELOW:
            last = running_max(F.transform(listed, lambda n, i: F.when(F.get(flags, i), n["last"]).otherwise(-1)))
            return let(last, lambda run: F.transform(listed, lambda n, i: F.coalesce(F.get(run, i - 1) >= n["pre"], F.lit(False))))
        if relation == ABOVE:
            return let(next_place(flags), lambda at: F.transform(listed, lambda n, i: F.coalesce(F.get(listed, F.get(at, i + 1))["pre"] <= n["last"], F.lit(False))))
        return _beside(listed, flags, relation)

    def far(found: Column) -> Column:
        if relation == CHILD:
            return among(F.transform(listed, lambda n: n["parent"]), F.transform(found, lambda a: a["pre"]))
        if relation == PARENT:
            return marked(F.transform(listed, lambda n: n["pre"]), F.transform(found, lambda a: a["parent"]))
        return let(marked(F.transform(listed, lambda n: n["pre"]), F.transform(found, lambda a: a["pre"])), scan)

    def choose(found: Column) -> Column:
        near = F.transform(listed, lambda n: F.exists(found, lambda a: _pair(relation, a, n)))
        return F.when(F.size(found) <= FEW, near).otherwise(far(found))

    return let(anchors, choose)


def _walk(nodes: Nodes, steps, anchors: Column) -> Column:
    (combinator, predicate), rest = steps[0], steps[1:]

    def match(near: Column) -> Column:
        return F.filter(_list(nodes), lambda n, i: F.get(near, i) & predicate(nodes, n))

    found = let(_related(nodes, anchors, combinator), match)
    return _walk(nodes, rest, found) if rest else found


def css(nodes: Nodes, selector: str) -> Column:
    """Nodes matching a CSS selector list, distinct, in document order."""
    groups = [_steps(part.strip()) for part in _split(selector, ",")]

    def one(steps) -> Column:
        first = F.filter(_list(nodes), lambda n: steps[0][1](nodes, n))
        return _walk(nodes, steps[1:], first) if len(steps) > 1 else first

    found = one(groups[0])
    for steps in groups[1:]:
        found = F.concat(found, one(steps))
    return found if len(groups) == 1 else document_union(found)


def document_union(found: Column) -> Column:
    """Distinct nodes in document order. Maps cannot be sorted or hashed, so order by ``pre`` alone; equal ones are neighbours then."""
    ordered = F.array_sort(found, lambda a, b: a["pre"] - b["pre"])
    return let(ordered, lambda s: F.filter(s, lambda n, i: (i == 0) | (F.get(s, i - 1)["pre"] != n["pre"])))


# ------------------------------------------------------------------- XPath

_AXIS = re.compile(r"(//|/)?(?:(following-sibling|preceding-sibling|ancestor|descendant|parent|self|child)::)?(\.\.|\.|@[\w:*-]+|text\(\)|node\(\)|\*|[\w:-]+)")


def _attribute_node(node: Column, name: str) -> Column:
    """An attribute result as a detached pseudo node."""
    fields = {"tag": F.lit("@" + name), "text": F.try_element_at(node["attrs"], F.lit(name)), "attrs": F.create_map().cast("map<string,string>")}
    return F.struct(*[fields.get(f, node[f]).alias(f) for f in NODE.names])


def _xpath_value(text: str, nodes: Nodes, n: Column) -> Column:
    """String value of an expression inside a predicate."""
    text = text.strip()
    if text[:1] in "\"'":
        return F.lit(text[1:-1])
    call = re.fullmatch(r"(normalize-space|string|translate|lower-case)\((.*)\)", text, re.S)
    if call:
        args = [a.strip() for a in _split(call.group(2), ",")]
        value = _xpath_value(args[0] or ".", nodes, n)
        if call.group(1) == "normalize-space":
            return collapse(value)
        if call.group(1) == "lower-case":
            return F.lower(value)
        if call.group(1) == "translate":
            return F.translate(value, args[1][1:-1], args[2][1:-1])
        return value
    if text.startswith("@"):
        return F.coalesce(F.try_element_at(n["attrs"], F.lit(text[1:].lower())), F.lit(""))
    if text in (".", "string()"):
        return _text_of(nodes, n)
    if text == "text()":
        texts = F.filter(_below(nodes, n), lambda t: is_text(t) & (t["parent"] == n["pre"]))
        return F.coalesce(F.try_element_at(texts, F.lit(1))["text"], F.lit(""))
    found = xpath(nodes, text if text.startswith(".") else "./" + text, n)
    return F.coalesce(let(found, lambda f: F.when(F.size(f) > 0, node_value(nodes, F.try_element_at(f, F.lit(1))))), F.lit(""))


def _logical(text: str, word: str) -> list[str]:
    parts, depth, quote, start, at = [], 0, None, 0, 0
    while at < len(text):
        ch = text[at]
        if quote:
            quote = None if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif depth == 0 and re.match(rf"\s{word}\s", text[at:]):
            parts.append(text[start:at])
            start = at = at + len(word) + 2
            continue
        at += 1
    return parts + [text[start:]]


def _xpath_test(text: str, nodes: Nodes, n: Column) -> Column:
    text = text.strip()
    for word in ("or", "and"):
        parts = _logical(text, word)
        if len(parts) > 1:
            tests = [_xpath_test(p, nodes, n) for p in parts]
            out = tests[0]
            for test in tests[1:]:
                out = (out | test) if word == "or" else (out & test)
            return out
    call = re.fullmatch(r"(not|contains|starts-with|ends-with)\((.*)\)", text, re.S)
    if call:
        if call.group(1) == "not":
            return ~_xpath_test(call.group(2), nodes, n)
        left, right = (_xpath_value(a, nodes, n) for a in _split(call.group(2), ","))
        return {"contains": F.contains, "starts-with": F.startswith, "ends-with": F.endswith}[call.group(1)](left, right)
    compare = re.fullmatch(r"(.+?)\s*(!?=)\s*(\"[^\"]*\"|'[^']*')", text, re.S)
    if compare:
        equal = _xpath_value(compare.group(1), nodes, n) == _xpath_value(compare.group(3), nodes, n)
        if compare.group(1).strip().startswith("@"):
            present = F.map_contains_key(n["attrs"], F.lit(compare.group(1).strip()[1:].lower()))
            return present & (equal if compare.group(2) == "=" else ~equal)
        return equal if compare.group(2) == "=" else ~equal
    if text.startswith("@"):
        return F.map_contains_key(n["attrs"], F.lit(text[1:].lower()))
    return F.size(xpath(nodes, text if text.startswith(".") else "./" + text, n)) > 0


def _position_test(text: str) -> Callable[[Column], Column] | None:
    """A test of struct(place, size) among the matches of one parent, or None for a predicate that isn't a position."""
    text = text.strip()
    if re.fullmatch(r"\d+", text):
        return lambda p: p["place"] == int(text)
    bound = re.fullmatch(r"position\(\)\s*(<=|>=|=|<|>)\s*(\d+)", text)
    if bound:
        limit = int(bound.group(2))
        return lambda p: {"=": p["place"] == limit, "<": p["place"] < limit, ">": p["place"] > limit, "<=": p["place"] <= limit, ">=": p["place"] >= limit}[bound.group(1)]
    if text == "last()":
        return lambda p: p["place"] == p["size"]
    return None


def _xpath_steps(path: str) -> list[tuple[bool, str | None, str, list[str]]]:
    steps, at = [], 0
    while at < len(path):
        found = _AXIS.match(path, at)
        if not found or found.end() == at:
            raise SelectorError(f"cannot read XPath at {path[at:]!r}")
        at = found.end()
        predicates = []
        while at < len(path) and path[at] == "[":
            depth, end, quote = 0, at, None
            while end < len(path):
                ch = path[end]
                if quote:
                    quote = None if ch == quote else quote
                elif ch in "\"'":
                    quote = ch
                elif ch == "[":
                    depth += 1
                elif ch == "]":
                    depth -= 1
                    if depth == 0:
                        break
                end += 1
            if depth:
                raise SelectorError(f"unclosed predicate in {path!r}")
            predicates.append(path[at + 1 : end])
            at = end + 1
        steps.append((found.group(1) == "//", found.group(2), found.group(3), predicates))
    return steps


def xpath(nodes: Nodes, path: str, scope: Column | None = None) -> Column:
    """XPath matches in document order; inside ``scope`` nothing outside it can be reached."""
    unions = _split(path.strip(), "|")
    if len(unions) > 1:
        return document_union(F.concat(*[xpath(nodes, p, scope) for p in unions]))
    path = path.strip()
    steps = _xpath_steps(path)
    if scope is None and not path.startswith("/"):
        steps[0] = (True if path.startswith(".//") else False, *steps[0][1:])

    def confined(n: Column) -> Column:
        return F.lit(True) if scope is None else ((scope["pre"] <= n["pre"]) & (n["pre"] <= scope["last"]))

    def within(current: Column) -> Column:
        """The current nodes and all below them."""
        return let(
            _related(nodes, current, BELOW),
            lambda near: let(
                marked(F.transform(_list(nodes), lambda n: n["pre"]), F.transform(current, lambda a: a["pre"])),
                lambda own: F.filter(_list(nodes), lambda n, i: confined(n) & (F.get(near, i) | F.get(own, i))),
            ),
        )

    def advance(current: Column | None, rest) -> Column:
        if not rest:
            return current
        deep, axis, test, predicates = rest[0]
        if test == "." or axis == "self":
            return advance(current, rest[1:])
        if test.startswith("@"):
            name = test[1:].lower()
            pool = current if current is not None else _list(nodes)
            if deep:
                pool = F.filter(_list(nodes), lambda n: confined(n)) if current is None else within(current)
            return F.transform(
                F.filter(pool, lambda n: F.coalesce(F.map_contains_key(n["attrs"], F.lit(name)), F.lit(False))),
                lambda n: _attribute_node(n, name),
            )

        def kind(n: Column) -> Column:
            if test == "text()":
                return is_text(n)
            if test == "node()" or test == "..":
                return F.lit(True)
            return ~is_text(n) if test == "*" else n["tag"] == test.lower()

        def select(bound: Column | None) -> Column:
            if bound is None:
                found = F.filter(_list(nodes), lambda n: kind(n) & (F.lit(True) if deep else n["parent"] == -1))
                return narrow(found, predicates)
            named = {"following-sibling": LATER, "preceding-sibling": EARLIER, "ancestor": ABOVE, "parent": PARENT, "descendant": BELOW}
            relation = PARENT if test == ".." else named.get(axis, BELOW if deep else CHILD)
            found = let(_related(nodes, bound, relation), lambda near: F.filter(_list(nodes), lambda n, i: confined(n) & kind(n) & F.get(near, i)))
            return narrow(found, predicates)

        def narrow(found: Column, left: list[str]) -> Column:
            if not left:
                return advance(found, rest[1:])

            def apply(bound: Column) -> Column:
                position = _position_test(left[0])
                if position is None:
                    return narrow(F.filter(bound, lambda n: _xpath_test(left[0], nodes, n)), left[1:])
                numbered = grouped_places(F.transform(bound, lambda n: n["parent"]))
                return narrow(let(numbered, lambda at: F.filter(bound, lambda n, i: position(F.get(at, i)))), left[1:])

            return let(found, apply)

        return select(None) if current is None else let(current, select)

    start = None if scope is None else F.array(scope)
    return advance(start, steps)


# ------------------------------------------------------------------ values


def node_value(nodes: Nodes, node: Column) -> Column:
    """Trimmed text of a match: of the attribute or text node itself, or of the element's subtree."""
    own = F.startswith(node["tag"], F.lit("@")) | is_text(node)
    return strip(F.when(own, node["text"]).otherwise(_text_of(nodes, node)))


def select(nodes: Nodes, selector: str, kind: str = "css") -> Column:
    return xpath(nodes, selector) if kind == "xpath" else css(nodes, selector)
