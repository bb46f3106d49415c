"""HTML tokenizer: one page in, one flat pre-order node list out.

This is the only Python that touches page markup. It builds Arrow columns for a
batch of pages; selection, projection, cleanup and serialisation all happen
afterwards as Column expressions over the node list.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

import numpy as np
import pyarrow as pa

# HTML element classes from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE_TEXT = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta title script style template noscript".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE_WALL = frozenset("html table td th caption template object marquee applet body".split())
FORMATTING = frozenset("a b big code em font i nobr s small span strike strong tt u".split())
SPECIAL = VOID | RAW_TEXT | ESCAPABLE_TEXT | CLOSES_P | HEADINGS | frozenset("li dt dd option optgroup a button tr td th tbody thead tfoot".split())
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot caption".split())
ROOT, TABLE_WALL = frozenset(("html", "body")), frozenset(("html", "body", "table"))
BLOCK_WALL, BUTTON_WALL = SCOPE_WALL | CLOSES_P, SCOPE_WALL | {"button"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+[^\s>]*)))?", re.S)
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")

NODE_ARROW = pa.struct(
    [(name, pa.int32()) for name in ("pre", "last", "depth", "parent", "sib", "rsib", "tsib", "rtsib")]
    + [("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())]
)


def _attribute_text(value: str) -> str:
    """Character references in an attribute; a bare name before '=' is query text, not a reference."""
    if "&" not in value:
        return value

    def one(match: re.Match) -> str:
        ref = match.group(0)
        if ref[-1] != ";" and ref[1] != "#":
            if value[match.end() : match.end() + 1] == "=" or ref[1:] not in html5:
                return ref
        return unescape(ref)

    return REFERENCE.sub(one, value)


def _attributes(source: str) -> list[tuple[str, str]]:
    seen: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        name = name.lower()
        if name not in seen:
            seen[name] = _attribute_text(double or single or bare.rstrip("/") if bare else double or single)
    return list(seen.items())


class Columns:
    """Growing node columns of one Arrow batch."""

    def __init__(self) -> None:
        self.last, self.depth, self.parent = [], [], []
        self.tag, self.text, self.attrs = [], [], []

    def arrow(self, offsets: list[int]) -> pa.Array:
        attr_offsets, keys, values = [0], [], []
        for pairs in self.attrs:
            for key, value in pairs:
                keys.append(key)
                values.append(value)
            attr_offsets.append(len(keys))
        maps = pa.MapArray.from_arrays(pa.array(attr_offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        starts = np.repeat(np.array(offsets[:-1], dtype=np.int64), np.diff(offsets))
        pre = np.arange(len(self.tag)) - starts
        parent = np.array(self.parent, dtype=np.int64)
        ints = [pa.array(column, pa.int32()) for column in (pre, self.last, self.depth, parent, *_siblings(parent, starts, self.tag))]
        fields = ints + [pa.array(self.tag, pa.string()), maps, pa.array(self.text, pa.string())]
        structs = pa.StructArray.from_arrays(fields, fields=list(NODE_ARROW))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def read_page(markup: str, out: Columns) -> None:
    """Append the nodes of one page; indexes are local to the page."""
    origin = len(out.tag)
    stack: list[int] = []
    names: list[str] = []
    body_seen = head_done = False
    last, tags = out.last, out.tag
    add_last, add_depth, add_parent, add_tag, add_attrs, add_text = (
        column.append for column in (last, out.depth, out.parent, tags, out.attrs, out.text)
    )

    def add(tag: str, attrs=(), text: str | None = None) -> int:
        index = len(tags) - origin
        add_last(index)
        add_depth(len(stack))
        add_parent(stack[-1] if stack else -1)
        add_tag(tag)
        add_attrs(attrs)
        add_text(text)
        return index

    def push(tag: str, attrs=()) -> None:
        stack.append(add(tag, attrs))
        names.append(tag)

    def pop_to(size: int) -> None:
        end = len(tags) - origin - 1
        while len(stack) > size:
            last[origin + stack.pop()] = end
            names.pop()

    def close(tag: str, wall=SCOPE_WALL) -> bool:
        for at in range(len(names) - 1, 1, -1):
            if names[at] == tag:
                pop_to(at)
                return True
            if names[at] in wall:
                return False
        return False

    def ensure_body() -> None:
        nonlocal body_seen, head_done
        if not body_seen:
            if not head_done:
                if len(stack) == 1:
                    push("head")
                pop_to(1)
                head_done = True
            pop_to(1)
            push("body")
            body_seen = True

    pos, size = 0, len(markup)
    scan = TOKEN.match
    while pos < size:
        token = scan(markup, pos)
        pos = token.end()
        close_name, open_name, source = token.groups()
        if close_name is None and open_name is None:
            whole = token.group()
            if whole[0] == "<" and len(whole) > 1:
                continue  # comment, doctype or processing instruction
            if not body_seen and not whole.strip():
                continue
            if not body_seen:
                if not stack:
                    push("html")
                ensure_body()
            add("#text", (), unescape(whole) if "&" in whole else whole)
            continue
        if close_name is not None:
            name = close_name.lower()
            if name == "head" and names[-1:] == ["head"]:
                pop_to(1)
                head_done = True
            elif name == "p" and body_seen:
                if not close("p"):
                    push("p")
                    pop_to(len(stack) - 1)
            elif name == "br":
                if stack:
                    ensure_body()
                    add("br")
            elif name in ("html", "body", "head"):
                continue
            elif name in HEADINGS:
                for at in range(len(names) - 1, 1, -1):
                    if names[at] in HEADINGS:
                        pop_to(at)
                        break
                    if names[at] in SCOPE_WALL:
                        break
            elif name in TABLE_PARTS:
                close(name, ROOT if name == "table" else TABLE_WALL)
            elif name in FORMATTING:
                close(name, BLOCK_WALL)
            else:
                close(name)
            continue
        name = open_name.lower()
        attrs = _attributes(source) if source else ()
        if name == "html":
            if not stack:
                push("html", attrs)
            continue
        if not stack:
            push("html")
        if name == "head":
            if not head_done and len(stack) == 1:
                push("head", attrs)
            continue
        if name == "body":
            if not body_seen:
                ensure_body()
                out.attrs[origin + stack[1]] = attrs
            continue
        if not body_seen:
            if name in HEAD_ONLY and not head_done:
                if len(stack) == 1:
                    push("head")
            elif not (name in HEAD_ONLY and names[-1:] == ["head"]):
                ensure_body()
        if not source and name not in SPECIAL:
            push(name, attrs)
            continue
        if name in CLOSES_P and "p" in names:
            close("p", BUTTON_WALL)
        if name == "li":
            for at in range(len(names) - 1, 1, -1):
                if names[at] == "li":
                    pop_to(at)
                    break
                if names[at] in ("ul", "ol", "menu") or names[at] in SCOPE_WALL:
                    break
        elif name in ("dt", "dd"):
            for at in range(len(names) - 1, 1, -1):
                if names[at] in ("dt", "dd"):
                    pop_to(at)
                    break
                if names[at] == "dl" or names[at] in SCOPE_WALL:
                    break
        elif name in HEADINGS and names[-1] in HEADINGS:
            pop_to(len(stack) - 1)
        elif name in ("option", "optgroup") and names[-1] == "option":
            pop_to(len(stack) - 1)
        elif name in ("a", "button"):
            close(name)
        elif name in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            closing = ("td", "th") if name in ("td", "th") else ("td", "th", "tr")
            for inner in closing + (("tbody", "thead", "tfoot") if name[-1] in "ydt" and name[0] == "t" and len(name) == 5 else ()):
                close(inner, TABLE_WALL | ({"tr"} if inner in ("td", "th") and name in ("td", "th") else frozenset()))
            if name == "tr" and names[-1] == "table":
                push("tbody")
            elif name in ("td", "th") and names[-1] in ("table", "tbody", "thead", "tfoot"):
                if names[-1] == "table":
                    push("tbody")
                push("tr")
        if name in VOID or (source.endswith("/") and ("svg" in names or "math" in names)):
            add(name, attrs)
            continue
        push(name, attrs)
        if name in RAW_TEXT or name in ESCAPABLE_TEXT:
            end = re.compile("</" + name + r"(?=[\s/>])", re.I).search(markup, pos)
            stop = end.start() if end else size
            if stop > pos:
                raw = markup[pos:stop]
                add("#text", (), unescape(raw) if name in ESCAPABLE_TEXT and "&" in raw else raw)
            pos = size
            if end:
                close_at = markup.find(">", stop)
                pos = close_at + 1 if close_at >= 0 else size
            pop_to(len(stack) - 1)
    if stack:
        ensure_body()
        pop_to(0)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number among equal ones, from 1 in the order given, and from the back."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    size = np.diff(first, append=len(keys))
    front = np.empty(len(keys), dtype=np.int64)
    front[order] = np.arange(len(keys)) - np.repeat(first, size) + 1
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.repeat(size, size)
    return front, back - front + 1


def _siblings(parent: np.ndarray, starts: np.ndarray, tags: list[str]) -> list[np.ndarray]:
    """Element ordinals among siblings, from the front and from the back: of all and of those with the same tag."""
    known: dict[str, int] = {"#text": 0}
    kinds = np.array([known.setdefault(tag, len(known)) for tag in tags], dtype=np.int64)
    held = np.flatnonzero(kinds)
    # A page's root has no parent and shares no place with a node of another page, nor with the root itself.
    under = (starts + parent + 1)[held] * 2 + (parent[held] < 0)
    out = [np.zeros(len(tags), dtype=np.int64) for _ in range(4)]
    for at, keys in ((0, under), (2, under * len(known) + kinds[held])):
        for ordinals, found in zip(out[at : at + 2], _ranks(keys), strict=True):
            ordinals[held] = found
    return out


def read_batch(pages: pa.Array) -> pa.Array:
    out, offsets = Columns(), [0]
    for page in pages:
        markup = page.as_py()
        if markup:
            read_page(markup, out)
        offsets.append(len(out.tag))
    return out.arrow(offsets)
