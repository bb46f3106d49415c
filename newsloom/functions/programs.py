"""Selectors as data: CSS and XPath selectors compiled to arrays, run by one expression for any number of them.

A program is a value: paths of steps, each an axis and tests on a node. ``hits`` interprets it over a page's node list,
so pages joined to a table of programs need one plan however many there are. A step keeps one flag for each node;
what lies below, beside or above the flagged nodes is found by running maxima and sorts, never node by node.

Covered: tag, id, class and attribute tests, positions, :root, :empty, :contains, :not(), :is(), :has() of one compound,
all four combinators and lists of selectors; XPath child, descendant, parent and following-sibling steps, unions,
a final attribute or text(), and predicates of attributes, text, positions, not(), and, or. ``SelectorError`` otherwise.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import selectors as S
from newsloom.functions.scans import ROUNDS

TAG, HAS, EQUAL, WORD, DASH, START, END, HOLDS, DIFFERS, NTH, ROOT, EMPTY, TEXT, NEVER, INNER, KIND, VALUE = range(17)
OPERATORS = {None: HAS, "=": EQUAL, "~=": WORD, "|=": DASH, "^=": START, "$=": END, "*=": HOLDS, "!=": DIFFERS}
ANY, TOP, BELOW, CHILD, NEXT, LATER, PARENT = "any", "top", "below", "child", "next", "later", "parent"
COMBINATORS = {" ": BELOW, ">": CHILD, "+": NEXT, "~": LATER}

ATOM = T.StructType(
    [T.StructField("kind", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]
)
TEST = T.StructType([T.StructField("holds", T.BooleanType()), T.StructField("alts", T.ArrayType(T.ArrayType(ATOM)))])
STEP = T.StructType([T.StructField("axis", T.StringType()), T.StructField("tests", T.ArrayType(TEST))])
PATH = T.StructType([T.StructField("steps", T.ArrayType(STEP)), T.StructField("attr", T.StringType())])
NEST = T.StructType([T.StructField("child", T.BooleanType()), T.StructField("tests", T.ArrayType(TEST))])
#: itself: the selector is '.', the card. A program without paths selects nothing.
PROGRAM = T.StructType([T.StructField("itself", T.BooleanType()), T.StructField("paths", T.ArrayType(PATH)), T.StructField("nests", T.ArrayType(NEST))])
HIT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("attr", T.StringType())])
HITS = T.ArrayType(HIT)


# ------------------------------------------------------------ from selectors


def atom(kind: int, name: str = "", value: str = "", a: int = 0, b: int = 0) -> dict:
    return {"kind": kind, "name": name, "value": value, "a": a, "b": b}


def test(*atoms: dict) -> dict:
    return {"holds": True, "alts": [list(atoms)]}


@dataclass
class _Compiler:
    nests: list[dict] = field(default_factory=list)
    within: bool = False

    def compound(self, text: str) -> tuple[list[dict], int]:
        """Tests of the compound selector at the start of the text, and how much of it they take."""
        at, tests = 0, [test(atom(KIND, "element"))]
        while at < len(text):
            found = S._COMPOUND.match(text, at)
            if not found or (found.group("tag") and at > 0):
                break
            at = found.end()
            if found.group("tag"):
                tag = S._plain(found.group("tag")).lower()
                tests += [] if tag == "*" else [test(atom(TAG, value=tag))]
            elif found.group("id"):
                tests.append(test(atom(EQUAL, "id", S._plain(found.group("id")))))
            elif found.group("cls"):
                tests.append(test(atom(WORD, "class", S._plain(found.group("cls")))))
            elif found.group("attr"):
                value = (found.group("val") or "").strip()
                value = value[1:-1] if value[:1] in ("'", '"') else value
                tests.append(test(atom(OPERATORS[found.group("op")], found.group("attr").lower(), value)))
            else:
                argument = None
                if found.group("open"):
                    argument, at = S._argument(text, at)
                tests.append(self.pseudo(found.group("pseudo").lower(), argument))
        if at == 0:
            raise S.SelectorError(f"cannot read selector at {text!r}")
        return tests, at

    def pseudo(self, name: str, argument: str | None) -> dict:
        fixed = {"first-child": ("sib",), "last-child": ("rsib",), "first-of-type": ("tsib",), "last-of-type": ("rtsib",), "only-child": ("sib", "rsib"), "only-of-type": ("tsib", "rtsib")}
        counted = {"nth-child": "sib", "nth-last-child": "rsib", "nth-of-type": "tsib", "nth-last-of-type": "rtsib"}
        if name in fixed:
            return test(*[atom(NTH, place, b=1) for place in fixed[name]])
        if name in counted:
            return test(atom(NTH, counted[name], "", *formula(argument or "")))
        if name in ("root", "empty"):
            return test(atom(ROOT if name == "root" else EMPTY))
        if name in ("contains", "containsown", "contains-own"):
            text = S._plain((argument or "").strip().strip("\"'")).lower()
            return test(atom(TEXT, "own" if name != "contains" else "", text))
        if name in ("not", "is", "where"):
            alts = []
            for part in S._split(argument or "", ","):
                tests, used = self.compound(part.strip())
                if used < len(part.strip()) or any(not t["holds"] or len(t["alts"]) > 1 for t in tests):
                    raise S.NotAsData(f"only simple selectors inside :{name}()")
                alts.append([a for t in tests for a in t["alts"][0]])
            return {"holds": name != "not", "alts": alts}
        if name in ("has", "haschild") and not self.within:
            alts = []
            for part in S._split(argument or "", ","):
                lead = re.match(r"\s*(>?)\s*", part)
                inner = part[lead.end() :].strip()
                self.within = True
                tests, used = self.compound(inner)
                self.within = False
                if used < len(inner):
                    raise S.NotAsData(f"only one compound inside :{name}()")
                alts.append([atom(INNER, a=len(self.nests))])
                self.nests.append({"child": bool(lead.group(1)) or name == "haschild", "tests": tests})
            return {"holds": True, "alts": alts}
        if name in ("matches", "matchesown", "matches-own", "has", "haschild"):
            raise S.NotAsData(f":{name} is not available as data")
        raise S.SelectorError(f"unknown pseudo-class :{name}")

    def css(self, text: str) -> dict:
        steps, at, axis, text = [], 0, ANY, text.strip()
        while at < len(text):
            tests, used = self.compound(text[at:])
            steps.append({"axis": axis, "tests": tests})
            at += used
            gap = re.match(r"\s*([>+~])\s*|\s+", text[at:])
            if at < len(text):
                if not gap or at + gap.end() >= len(text):
                    raise S.SelectorError(f"cannot read selector at {text[at:]!r}")
                axis = COMBINATORS[gap.group(1) or " "]
                at += gap.end()
        if not steps:
            raise S.SelectorError("empty selector")
        return {"steps": steps, "attr": ""}

    def xpath(self, path: str, scoped: bool) -> dict:
        path = path.strip()
        steps, attr = [], ""
        for number, (deep, axis, name, predicates) in enumerate(S._xpath_steps(path)):
            if attr:
                raise S.SelectorError(f"steps after an attribute in {path!r}")
            if name == "." or axis == "self":
                if predicates:
                    raise S.NotAsData(f"predicates of '.' are not available as data: {path!r}")
                if deep:
                    raise S.NotAsData(f"'//.' is not available as data: {path!r}")
                continue
            first = not steps and not scoped
            if name.startswith("@"):
                if predicates or axis or (deep and steps):
                    raise S.NotAsData(f"cannot read XPath {path!r} as data")
                if deep:
                    steps.append({"axis": ANY if first else BELOW, "tests": [test(atom(KIND, "element"))]})
                attr = name[1:].lower()
                continue
            if axis in ("ancestor", "preceding-sibling"):
                raise S.NotAsData(f"{axis} is not available as data")
            if first:
                relation = ANY if deep or (number == 1 and path.startswith(".//")) else TOP
            elif name == ".." or axis == "parent":
                relation = PARENT
            elif axis == "following-sibling":
                relation = LATER
            else:
                relation = BELOW if deep or axis == "descendant" else CHILD
            if name == "text()":
                kind = [test(atom(KIND, "text"))]
            elif name in ("node()", ".."):
                kind = []
            else:
                kind = [test(atom(KIND, "element"))] + ([] if name == "*" else [test(atom(TAG, value=name.lower()))])
            tests = list(kind)
            for at, predicate in enumerate(predicates):
                position = self.position(predicate, name, relation)
                if position and at:
                    raise S.NotAsData(f"positions after other predicates are not available as data: {path!r}")
                tests += [position] if position else self.predicate(predicate)
            steps.append({"axis": relation, "tests": tests})
        if not steps and not attr:
            raise S.SelectorError(f"XPath {path!r} selects nothing")
        return {"steps": steps, "attr": attr}

    def position(self, text: str, name: str, relation: str) -> dict | None:
        """A position among the children of a parent, which the node list numbers by tag and in all."""
        text = text.strip()
        found = re.fullmatch(r"(?:position\(\)\s*=\s*)?(\d+)", text)
        bound = re.fullmatch(r"position\(\)\s*(<=|>=|<|>)\s*(\d+)", text)
        if not found and not bound and text != "last()":
            return None
        if relation not in (CHILD, BELOW, ANY) or name in ("text()", "node()", ".."):
            raise S.NotAsData(f"position {text!r} is not available as data here")
        front, back = ("sib", "rsib") if name == "*" else ("tsib", "rtsib")
        if text == "last()":
            return test(atom(NTH, back, b=1))
        if found:
            return test(atom(NTH, front, b=int(found.group(1))))
        sign, limit = bound.group(1), int(bound.group(2)) + {"<": -1, ">": 1}.get(bound.group(1), 0)
        return test(atom(NTH, front, "", -1 if sign[0] == "<" else 1, limit))

    def predicate(self, text: str) -> list[dict]:
        """A predicate as tests that must all hold; ``or`` joins alternatives of simple ones."""
        text = text.strip()
        parts = S._logical(text, "or")
        if len(parts) > 1:
            alts = []
            for part in parts:
                tests = self.predicate(part)
                if any(not t["holds"] or len(t["alts"]) > 1 for t in tests):
                    raise S.NotAsData(f"predicate {text!r} is not available as data")
                alts.append([a for t in tests for a in t["alts"][0]])
            return [{"holds": True, "alts": alts}]
        parts = S._logical(text, "and")
        if len(parts) > 1:
            return [t for part in parts for t in self.predicate(part)]
        inner = re.fullmatch(r"not\((.*)\)", text, re.S)
        if inner:
            tests = self.predicate(inner.group(1))
            if len(tests) != 1:
                raise S.NotAsData(f"predicate {text!r} is not available as data")
            return [{"holds": not tests[0]["holds"], "alts": tests[0]["alts"]}]
        if re.fullmatch(r"@[\w:-]+", text):
            return [test(atom(HAS, text[1:].lower()))]
        call = re.fullmatch(r"(contains|starts-with|ends-with)\((.*)\)", text, re.S)
        same = re.fullmatch(r"(.+?)\s*(!?=)\s*(\"[^\"]*\"|'[^']*')", text, re.S)
        if call:
            left, right = (p.strip() for p in S._split(call.group(2), ","))
            kind = {"contains": HOLDS, "starts-with": START, "ends-with": END}[call.group(1)]
        elif same:
            left, right, kind = same.group(1).strip(), same.group(3), EQUAL
        else:
            raise S.NotAsData(f"predicate {text!r} is not available as data")
        if right[:1] not in ("'", '"'):
            raise S.NotAsData(f"predicate {text!r} is not available as data")
        value = right[1:-1]
        if re.fullmatch(r"@[\w:-]+", left):
            name = left[1:].lower()
            if same and same.group(2) == "!=":
                return [test(atom(HAS, name)), {"holds": False, "alts": [[atom(EQUAL, name, value)]]}]
            # XPath finds the empty text everywhere, also in an absent attribute; CSS finds it nowhere.
            return [] if call and value == "" else [test(atom(kind, name, value))]
        whole = {".": "", "string()": "", "string(.)": "", "text()": "first", "normalize-space()": "even", "normalize-space(.)": "even"}
        if left not in whole:
            raise S.NotAsData(f"predicate {text!r} is not available as data")
        tests = [{"holds": not (same and same.group(2) == "!="), "alts": [[atom(VALUE, whole[left], value, a=kind)]]}]
        return tests


def formula(text: str) -> tuple[int, int]:
    """Step and shift of an+b."""
    text = text.replace(" ", "").lower()
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    found = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not found or not text:
        raise S.SelectorError(f"bad position {text!r}")
    step, shift = found.group(1), int(found.group(2) or 0)
    return (0 if step is None else int(step + "1") if step in ("", "+", "-") else int(step)), shift


NOTHING = {"itself": False, "paths": [], "nests": []}


def program(selector: str, kind: str = "css", scoped: bool = False) -> dict:
    """The program of a selector; scoped XPath starts at the first node of the list it runs over."""
    if not selector:
        return NOTHING
    if selector == ".":
        return {"itself": True, "paths": [], "nests": []}
    compiler = _Compiler()
    if kind == "xpath":
        paths = [compiler.xpath(p, scoped) for p in S._split(selector.strip(), "|")]
    else:
        paths = [compiler.css(p) for p in S._split(selector, ",")]
    return {"itself": False, "paths": paths, "nests": compiler.nests}


def problem(selector: str, kind: str = "css", scoped: bool = False) -> str | None:
    """Why a selector can't be read at all; None for one that this library reads in either way."""
    try:
        program(selector, kind, scoped)
    except S.NotAsData:
        # Read by compiled expressions: those parse it here and build nothing.
        try:
            parts = S._split(selector, "|" if kind == "xpath" else ",")
            return next((f"nothing at {part!r}" for part in parts if not (S._xpath_steps(part.strip()) if kind == "xpath" else S._steps(part.strip()))), None)
        except (S.SelectorError, IndexError, re.error) as bad:
            return str(bad)
    except (S.SelectorError, IndexError, re.error) as bad:
        return str(bad)
    return None


def literal(value, kind: T.DataType) -> Column:
    """A nested Python value as a Column."""
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(value[f.name], f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


# ------------------------------------------------------------------- running
#
# The interpreter is SQL text over columns and lambda variables: a text of any size is parsed at once, while an
# expression put together call by call takes seconds of the driver for each use.

_names = itertools.count()


def fresh() -> str:
    """A variable name that no other part of a text uses."""
    return f"v{next(_names)}"


def let_sql(value: str, body: Callable[[str], str]) -> str:
    name = fresh()
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def running_max_sql(values: str) -> str:
    r, acc, d, x, i = (fresh() for _ in range(5))
    return let_sql(values, lambda h: f"aggregate(filter({ROUNDS}, {r} -> {r} < size({h})), {h}, ({acc}, {d}) -> transform({acc}, ({x}, {i}) -> greatest({x}, get({acc}, {i} - {d}))))")


def next_place_sql(flags: str, base: str = "0") -> str:
    """As ``scans.next_place``."""
    f, i, x = fresh(), fresh(), fresh()
    back = f"reverse(transform({flags}, ({f}, {i}) -> CASE WHEN {f} THEN -({i} + {base}) END))"
    return f"transform(reverse({running_max_sql(back)}), {x} -> -{x})"


def marked_sql(places: str, keys: str) -> str:
    """As ``scans.marked``."""
    k, p, e, i, h, g = (fresh() for _ in range(6))
    both = f"array_sort(concat(transform({keys}, {k} -> named_struct('at', {k}, 'kind', 0)), transform({places}, {p} -> named_struct('at', {p}, 'kind', 1))))"

    def read(events: str) -> str:
        hit = f"transform({events}, ({e}, {i}) -> named_struct('kind', {e}.kind, 'hit', coalesce(get({events}, {i} - 1).at = {e}.at, false)))"
        return f"transform(filter({hit}, {h} -> {h}.kind = 1), {g} -> {g}.hit)"

    return let_sql(both, read)


@dataclass(frozen=True)
class View:
    """A run of nodes of a page in document order, the place of its first node, and those to pass over, all as SQL."""

    nodes: str
    base: str = "0"
    gone: str | None = None

    def index(self, place: str) -> str:
        return f"({place} - {self.base})" if self.base != "0" else place

    def there(self, i: str) -> str:
        return "true" if self.gone is None else f"NOT get({self.gone}, {i})"

    def below(self, n: str) -> str:
        return f"slice({self.nodes}, {self.index(n + '.pre')} + 1, {n}.last - {n}.pre + 1)"

    def texts(self, n: str, where: Callable[[str], str] | None = None) -> str:
        """Joined texts below a node."""
        t, u = fresh(), fresh()
        tests = [f"{t}.tag = '#text'", *([self.there(self.index(f"{t}.pre"))] if self.gone else []), *([where(t)] if where else [])]
        return f"array_join(transform(filter({self.below(n)}, {t} -> {' AND '.join(tests)}), {u} -> {u}.text), '')"

    def places(self) -> str:
        n = fresh()
        return f"transform({self.nodes}, {n} -> {n}.pre)"

    def flagged(self, flags: str, field: str, other: str) -> str:
        """The field of flagged nodes, something else for the others."""
        n, i = fresh(), fresh()
        return f"transform({self.nodes}, ({n}, {i}) -> CASE WHEN get({flags}, {i}) THEN {n}.{field} ELSE {other} END)"

    def parents(self, flags: str) -> str:
        n, i, m = fresh(), fresh(), fresh()
        return f"transform(filter({self.nodes}, ({n}, {i}) -> get({flags}, {i})), {m} -> {m}.parent)"


def _atom(view: View, n: str, i: str, a: str, nests: str | None) -> str:
    held, said = f"try_element_at({n}.attrs, {a}.name)", f"{a}.value <> ''"
    place = f"CASE {a}.name WHEN 'sib' THEN {n}.sib WHEN 'rsib' THEN {n}.rsib WHEN 'tsib' THEN {n}.tsib ELSE {n}.rtsib END"
    nth = let_sql(place, lambda p: f"CASE WHEN {a}.a = 0 THEN {p} = {a}.b ELSE pmod({p} - {a}.b, abs(nullif({a}.a, 0))) = 0 AND ({p} - {a}.b) * signum({a}.a) >= 0 END")
    own = lambda t: f"{t}.parent = {n}.pre"
    t = fresh()
    first = f"coalesce(get(filter({view.below(n)}, {t} -> {t}.tag = '#text' AND {own(t)}), 0).text, '')"
    even = f"trim(regexp_replace({view.texts(n)}, r'[\\s\\x{{A0}}]+', ' '))"
    text = f"CASE {a}.name WHEN 'first' THEN {first} WHEN 'even' THEN {even} ELSE {view.texts(n)} END"
    compared = let_sql(text, lambda x: f"CASE {a}.a WHEN {EQUAL} THEN {x} = {a}.value WHEN {START} THEN startswith({x}, {a}.value) WHEN {END} THEN endswith({x}, {a}.value) ELSE contains({x}, {a}.value) END")
    shown = f"CASE {a}.name WHEN 'own' THEN {view.texts(n, own)} ELSE {view.texts(n)} END"
    cases = {
        KIND: f"({n}.tag = '#text') = ({a}.name = 'text')",
        TAG: f"{n}.tag = {a}.value",
        WORD: f"array_contains(split({held}, r'[ \\t\\n\\f\\r]+'), {a}.value) AND {said}",
        HAS: f"{held} IS NOT NULL",
        EQUAL: f"{held} = {a}.value",
        NTH: nth,
        START: f"startswith({held}, {a}.value) AND {said}",
        END: f"endswith({held}, {a}.value) AND {said}",
        HOLDS: f"contains({held}, {a}.value) AND {said}",
        DASH: f"{held} = {a}.value OR startswith({held}, concat({a}.value, '-'))",
        DIFFERS: f"coalesce({held} <> {a}.value, true)",
        ROOT: f"{n}.parent = -1",
        EMPTY: f"{n}.last = {n}.pre",
        TEXT: f"contains(lower({shown}), {a}.value)",
        VALUE: compared,
        **({INNER: f"get(get({nests}, {a}.a), {i})"} if nests else {}),
    }
    return f"coalesce(CASE {a}.kind {' '.join(f'WHEN {kind} THEN ({test})' for kind, test in cases.items())} END, false)"


def _holds(view: View, n: str, i: str, tests: str, nests: str | None) -> str:
    t, alt, a = fresh(), fresh(), fresh()
    return f"forall({tests}, {t} -> exists({t}.alts, {alt} -> forall({alt}, {a} -> {_atom(view, n, i, a, nests)})) = {t}.holds)"


def _nested(view: View, nest: str) -> str:
    """Flags of the nodes that hold a match of the nested compound."""
    n, i, m = fresh(), fresh(), fresh()
    found = f"transform({view.nodes}, ({n}, {i}) -> {view.there(i)} AND {_holds(view, n, i, f'{nest}.tests', None)})"

    def read(flags: str) -> str:
        last = running_max_sql(view.flagged(flags, "pre", "-1"))
        below = let_sql(last, lambda run: f"transform({view.nodes}, {m} -> get({run}, {view.index(m + '.last')}) > {m}.pre)")
        return f"CASE WHEN {nest}.child THEN {marked_sql(view.places(), view.parents(flags))} ELSE {below} END"

    return let_sql(found, read)


def _beside(view: View, flags: str, axis: str) -> str:
    """Flags, as 0 and 1, of the element after a flagged one, or of all later siblings of one."""
    n, i, x, k, y, z = (fresh() for _ in range(6))
    rows = f"array_sort(transform({view.nodes}, ({n}, {i}) -> named_struct('parent', {n}.parent, 'sib', {n}.sib, 'i', {i}, 'flag', get({flags}, {i}) AND {n}.sib > 0)))"

    def read(r: str) -> str:
        run = running_max_sql(f"transform({r}, {y} -> CASE WHEN {y}.flag THEN {y}.parent ELSE -2 END)")

        def beside(seen: str) -> str:
            before = f"get({r}, {k} - 1)"
            follows = f"{before}.flag AND {before}.parent = {x}.parent AND {before}.sib = {x}.sib - 1"
            hit = f"coalesce(CASE WHEN {axis} = '{NEXT}' THEN {follows} ELSE get({seen}, {k} - 1) = {x}.parent END, false)"
            return f"transform(array_sort(transform({r}, ({x}, {k}) -> named_struct('i', {x}.i, 'flag', int({hit})))), {z} -> {z}.flag)"

        return let_sql(run, beside)

    return let_sql(rows, read)


def _walk(view: View, steps: str, nests: str) -> str:
    """Flags of the nodes that the steps end at, from the first node of the view."""
    flags, s, n, i, f, m, j = (fresh() for _ in range(7))
    below = running_max_sql(view.flagged(flags, "last", "-1"))
    above = f"transform({marked_sql(view.places(), view.parents(flags))}, {f} -> int({f}))"
    # Either the last place below an earlier flagged node, or flags as 0 and 1.
    reach = f"CASE WHEN {s}.axis = '{BELOW}' THEN {below} WHEN {s}.axis IN ('{NEXT}', '{LATER}') THEN {_beside(view, flags, f'{s}.axis')} WHEN {s}.axis = '{PARENT}' THEN {above} END"

    def select(r: str) -> str:
        related = (
            f"CASE {s}.axis WHEN '{ANY}' THEN true WHEN '{TOP}' THEN {n}.parent = -1 WHEN '{CHILD}' THEN coalesce(get({flags}, {view.index(n + '.parent')}), false)"
            f" WHEN '{BELOW}' THEN coalesce(get({r}, {i} - 1) >= {n}.pre, false) ELSE get({r}, {i}) = 1 END"
        )
        return f"transform({view.nodes}, ({n}, {i}) -> {view.there(i)} AND {related} AND {_holds(view, n, i, f'{s}.tests', nests)})"

    return f"aggregate({steps}, transform({view.nodes}, ({m}, {j}) -> {j} = 0), ({flags}, {s}) -> {let_sql(reach, select)})"


def hits(view: View, prog: str) -> str:
    """Places and attributes a program selects, distinct, in document order, as SQL."""
    x, p, n, i, m, h, k = (fresh() for _ in range(7))

    def run(nests: str) -> str:
        def pick(flags: str) -> str:
            wanted = f"get({flags}, {i}) AND ({p}.attr = '' OR coalesce(map_contains_key({n}.attrs, {p}.attr), false))"
            return f"transform(filter({view.nodes}, ({n}, {i}) -> {wanted}), {m} -> named_struct('at', {m}.pre, 'attr', {p}.attr))"

        found = f"array_sort(flatten(transform({prog}.paths, {p} -> {let_sql(_walk(view, f'{p}.steps', nests), pick)})))"
        return let_sql(found, lambda f: f"filter({f}, ({h}, {k}) -> {k} = 0 OR get({f}, {k} - 1).at <> {h}.at)")

    return let_sql(f"transform({prog}.nests, {x} -> {_nested(view, x)})", run)


def first_places(view: View, found: str) -> str:
    """For each node of the view the first hit from it on, NULL if there is none."""
    h = fresh()
    return next_place_sql(marked_sql(view.places(), f"transform({found}, {h} -> {h}.at)"), view.base)
