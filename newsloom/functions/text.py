"""Text normalisation, escaping, bounding and redaction as Column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.columns import col, let, nested

# White space as Unicode defines it for field splitting.
SPACE = "\\t\\n\\x0B\\f\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
# A run that is not already one plain space; texts are mostly single spaces, which stay untouched.
SPACE_RUN = f"[{SPACE.replace(' ', '', 1)}][{SPACE}]*| [{SPACE}]+"
ELLIPSIS = "\u2026"


def strip(value: Column | str) -> Column:
    return F.regexp_replace(col(value), f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(value: Column | str) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(value), SPACE_RUN, " "))


def _fold_pairs() -> tuple[str, str]:
    """Characters whose simple case fold differs from lower(), from Python's Unicode tables."""
    source, target = [], []
    for point in range(0x80, sys.maxunicode + 1):
        ch = chr(point)
        if unicodedata.category(ch) not in ("Ll", "Lu", "Lt", "Mn"):
            continue
        folded, lowered = ch.casefold(), ch.lower()
        if len(folded) == 1 and len(lowered) == 1 and folded != lowered:
            # Cherokee folds to upper case; lower() already maps both cases together.
            if folded.lower() != lowered:
                source.append(ch)
                target.append(folded.lower())
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_pairs()
# Capital sigma would otherwise lower to its final form at the end of a word.
_FOLD_FROM, _FOLD_TO = _FOLD_FROM + "\u03a3", _FOLD_TO + "\u03c3"
_DOTTED_I, _SHIELD = "\u0130", "\uE0F0"


def fold(value: Column | str) -> Column:
    """Collapsed white space and Unicode simple case folding (no accent removal, sharp s stays)."""


    def folded(text: Column) -> Column:
        shielded = F.translate(text, _FOLD_FROM + _DOTTED_I, _FOLD_TO + _SHIELD)
        special = F.translate(F.lower(shielded), _SHIELD, _DOTTED_I)
        # Per-character translation is slow and almost never needed.
        return F.when(text.rlike(f"[{_FOLD_FROM}{_DOTTED_I}]"), special).otherwise(F.lower(text))

    return let(collapse(value), folded)


def fold_text(value: str) -> str:
    """The same fold for a keyword known on the driver."""
    collapsed = " ".join(value.split())
    table = dict(zip(_FOLD_FROM, _FOLD_TO))
    return "".join(ch if ch == _DOTTED_I else table.get(ch, ch).lower() for ch in collapsed)


def readable(value: Column | str) -> Column:
    """Valid UTF-8 without NUL, as text is stored."""
    return F.replace(F.make_valid_utf8(col(value)), F.lit("\x00"), F.lit("\ufffd"))


def ellipsize(value: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when something was cut."""
    value = col(value)
    return F.when(F.char_length(value) > limit, F.concat(F.left(value, F.lit(limit - 1)), F.lit(ELLIPSIS))).otherwise(value)


def clip_bytes(value: Column | str, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes, never ending inside a character."""
    value = col(value)
    clipped = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(value, "UTF-8"), 1, limit).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(value) > limit, clipped).otherwise(value)


def escape_html(value: Column | str) -> Column:
    return nested([("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")], col(value))


def unescape_html(value: Column | str) -> Column:
    return nested(
        [("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&#34;", '"'), ("&quot;", '"'), ("&amp;", "&")], col(value)
    )


def escape_xml(value: Column | str) -> Column:
    """Character data or attribute value of an XML document."""
    legal = F.regexp_replace(col(value), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "\ufffd")
    return nested(
        [
            ("&", "&amp;"),
            ("'", "&#39;"),
            ("<", "&lt;"),
            (">", "&gt;"),
            ('"', "&#34;"),
            ("\t", "&#x9;"),
            ("\n", "&#xA;"),
            ("\r", "&#xD;"),
        ],
        legal,
    )


def escape_label(value: Column | str) -> Column:
    """A label value of the metrics text format."""
    return nested([("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")], col(value))


def one_line(value: Column | str) -> Column:
    return F.regexp_replace(col(value), "[\\r\\n]+", " ")


def sha(value: Column, prefix: str = "") -> Column:
    digest = F.sha2(F.encode(value, "UTF-8"), 256)
    return F.concat(F.lit(prefix), digest) if prefix else digest


# What counts as an address, a credential header and a secret.
URL_PATTERN = "(?i)\\b(?:https?|postgres(?:ql)?|wss?)://[^\\s<>\"']+"
HEADER_PATTERN = "(?im)\\b(authorization|proxy-authorization|cookie|set-cookie)\\s*:\\s*[^\\r\\n]+"
SECRET_PATTERN = (
    "(?i)\\b(password|access[_-]?token|refresh[_-]?token|api[_-]?key)\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s,;]+)"
)


def redact(value: Column | str, limit: int | None = None) -> Column:
    """Addresses, credential headers and secrets removed; control characters replaced; bytes bounded."""
    value = F.make_valid_utf8(col(value))
    value = F.regexp_replace(value, URL_PATTERN, "[URL omitted]")
    value = F.regexp_replace(value, HEADER_PATTERN, "$1: [redacted]")
    value = F.regexp_replace(value, SECRET_PATTERN, "$1=[redacted]")
    value = F.regexp_replace(value, "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]", "\ufffd")
    return value if limit is None else clip_bytes(value, limit)


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), nested([("\\", "\\\\"), ('"', '\\"')], value), F.lit('"'))


def field_sample(raw: Column) -> Column:
    """A bounded, redacted sample of a selected value, marked when it is an address."""

    def sample(text: Column) -> Column:
        network = F.startswith(text, F.lit("//"))
        absolute = text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
        relative_query = text.contains("?") & ~text.rlike("[ \\t\\r\\n]")
        kind = F.when(network | absolute, F.lit("URL ")).otherwise(F.lit(""))
        shown = (
            F.when(network, F.lit("[URL omitted]"))
            .when(~absolute & relative_query, F.regexp_replace(text, "[?#].*$", ""))
            .otherwise(text)
        )

        def bounded(clean: Column) -> Column:
            cut = F.concat(clip_bytes(F.left(clean, F.lit(119)), 317), F.lit(ELLIPSIS))
            return F.when((F.char_length(clean) > 120) | (F.octet_length(clean) > 320), cut).otherwise(clean)

        return F.concat(kind, quoted(let(collapse(redact(shown)), bounded)))

    return let(strip(raw), sample)
