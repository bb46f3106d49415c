"""XML entry reader: one syndication document in, its entries out.

The only Python that touches feed XML. It keeps element names, attributes and
text; every rule about what they mean is Column work in ``entries``.
"""

from __future__ import annotations

import re
from html.entities import html5
from xml.parsers import expat

import pyarrow as pa

MAX_ENTRIES = 1000
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML_NS = "http://www.w3.org/XML/1998/namespace"

_LOOSE = re.compile(r"<!\[CDATA\[.*?\]\]>|<!--.*?-->|&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", re.S)
_PREDEFINED = frozenset(("amp;", "lt;", "gt;", "quot;", "apos;"))

_ATTRS = pa.map_(pa.string(), pa.string())
_KID = pa.struct([("ns", pa.string()), ("local", pa.string()), ("attrs", _ATTRS), ("text", pa.string())])
_CHILD = pa.struct(
    [("ns", pa.string()), ("local", pa.string()), ("attrs", _ATTRS), ("text", pa.string()), ("inner", pa.string()), ("kids", pa.list_(_KID))]
)
_ENTRY = pa.struct([("ns", pa.string()), ("attrs", _ATTRS), ("children", pa.list_(_CHILD))])
DOCUMENT_ARROW = pa.struct(
    [
        ("format", pa.string()),
        ("bases", pa.list_(pa.string())),
        ("entries", pa.list_(_ENTRY)),
        ("more", pa.int32()),
        ("error", pa.string()),
    ]
)


def _tolerant(text: str) -> str:
    """HTML entities become characters and stray ampersands literal ones; CDATA is left alone."""

    def fix(match: re.Match) -> str:
        whole, ref = match.group(0), match.group(1)
        if whole[0] == "<":
            return whole
        if ref is None:
            return "&amp;"
        if ref[0] == "#" or ref in _PREDEFINED:
            return whole
        return html5.get(ref, "&amp;" + ref)

    return _LOOSE.sub(fix, text)


class _Enough(Exception):
    pass


class _NotFeed(Exception):
    pass


class _Reader:
    def __init__(self) -> None:
        self.scopes: list[dict[str, str]] = [{"xml": XML_NS}]
        self.depth = 0
        self.format = None
        self.channel = False
        self.bases: list[str] = []
        self.entries: list[dict] = []
        self.more = 0
        self.entry = self.child = self.kid = None
        self.entry_depth = 0
        self.done = False

    def name(self, raw: str, attribute: bool = False) -> tuple[str, str]:
        prefix, _, local = raw.rpartition(":")
        if not prefix:
            return ("" if attribute else self.scopes[-1].get("", "")), local
        return self.scopes[-1].get(prefix, prefix), local

    def attributes(self, flat: list[str]) -> list[tuple[str, str]]:
        out = {}
        for key, value in zip(flat[::2], flat[1::2]):
            if key == "xmlns" or key.startswith("xmlns:"):
                continue
            ns, local = self.name(key, True)
            prefix = {XML_NS: "xml:", RDF_NS: "rdf:", "rdf": "rdf:", "": ""}.get(ns)
            if prefix is not None:
                out.setdefault(prefix + local, value)
        return list(out.items())

    def start(self, raw: str, flat: list[str]) -> None:
        if self.done:
            raise _Enough
        scope = self.scopes[-1]
        declared = {k[6:] if k != "xmlns" else "": v for k, v in zip(flat[::2], flat[1::2]) if k == "xmlns" or k.startswith("xmlns:")}
        self.scopes.append({**scope, **declared} if declared else scope)
        self.depth += 1
        ns, local = self.name(raw)
        attrs = self.attributes(flat)
        if self.entry is not None:
            level = self.depth - self.entry_depth
            if level == 1:
                self.child = {"ns": ns, "local": local, "attrs": attrs, "text": [], "kids": [], "begin": None, "empty": False}
            elif level == 2:
                self.kid = {"ns": ns, "local": local, "attrs": attrs, "text": []}
            if level == 1:
                self.child["begin"] = self.content_start()
            return
        if self.depth == 1:
            if local == "rss":
                self.format = "rss"
            elif local == "RDF" and ns in (RDF_NS, "rdf"):
                self.format = "rdf"
            elif local == "feed":
                self.format = "atom"
            else:
                raise _NotFeed
            self.bases += [v for k, v in attrs if k == "xml:base"]
            return
        if self.depth == 2:
            self.channel = local == "channel"
            if self.format == "rss" and self.channel:
                self.bases += [v for k, v in attrs if k == "xml:base"]
        wanted = (
            (self.format == "rss" and local == "item" and (self.depth == 2 or (self.depth == 3 and self.channel)))
            or (self.format == "rdf" and local == "item" and self.depth == 2)
            or (self.format == "atom" and local == "entry" and self.depth == 2)
        )
        if wanted:
            if len(self.entries) == MAX_ENTRIES:
                self.more += 1  # counted, not kept
                return
            self.entry, self.entry_depth = {"ns": ns, "attrs": attrs, "children": []}, self.depth

    def content_start(self) -> int:
        at = self.parser.CurrentByteIndex
        quote = 0
        while True:
            byte = self.source[at]
            if quote:
                quote = 0 if byte == quote else quote
            elif byte in (34, 39):
                quote = byte
            elif byte == 62:
                return at + 1
            at += 1

    def end(self, raw: str) -> None:
        self.scopes.pop()
        if self.entry is not None:
            level = self.depth - self.entry_depth
            if level == 0:
                self.entries.append(self.entry)
                self.entry = None
            elif level == 1:
                child = self.child
                stop = self.parser.CurrentByteIndex
                inner = self.source[child.pop("begin") : stop].decode("utf-8") if child["kids"] else None
                child.pop("empty")
                child["text"] = "".join(child["text"])
                child["inner"] = inner if inner is not None else child["text"]
                self.entry["children"].append(child)
                self.child = None
            elif level == 2:
                self.kid["text"] = "".join(self.kid["text"])
                self.child["kids"].append(self.kid)
                self.kid = None
        self.depth -= 1
        if self.depth == 0:
            self.done = True

    def text(self, data: str) -> None:
        if self.entry is None:
            return
        level = self.depth - self.entry_depth
        if level == 1 and self.child is not None:
            self.child["text"].append(data)
        elif level == 2 and self.kid is not None:
            self.kid["text"].append(data)

    def read(self, text: str) -> dict:
        self.source = _tolerant(text).encode("utf-8")
        self.parser = parser = expat.ParserCreate("utf-8")
        parser.ordered_attributes = True
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.text
        error = None
        try:
            parser.Parse(self.source, True)
        except _Enough:
            pass
        except _NotFeed:
            error = "the document is no RSS, RDF or Atom feed"
        except expat.ExpatError as problem:
            if self.done or self.more:
                pass  # neither what follows the root element nor what follows the entries kept is part of the feed
            elif self.format is None and not text.lstrip("\ufeff \t\r\n").startswith("<?xml"):
                error = "the document is no RSS, RDF or Atom feed"
            else:
                error = f"broken XML in line {problem.lineno}"
        if error is None and self.format is None:
            error = "the document is no RSS, RDF or Atom feed"
        entries = [] if error else self.entries
        return {"format": self.format, "bases": self.bases, "entries": entries, "more": self.more, "error": error}


def read_documents(documents: pa.Array) -> pa.Array:
    rows = [None if d.as_py() is None else _Reader().read(d.as_py()) for d in documents]
    return pa.array(rows, DOCUMENT_ARROW)
