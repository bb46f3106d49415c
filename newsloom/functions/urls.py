"""URL resolution and safety (RFC 3986) as Column expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.columns import col, groups, let, nested
from newsloom.functions.text import strip

# Scheme, '//' with authority, path, '?' with query, fragment.
REFERENCE = "(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\\?[^#]*)?(?:#(.*))?$"
SAFE_PATH = "^(?:[A-Za-z0-9\\-._~!$&'()*+,;=:@\\[\\]/]|%[0-9A-Fa-f]{2})*$"
HOST = "^(?:\\[[0-9A-Fa-f:.]+\\]|[^\\s\"<>\\\\^`{|}%@\\[\\]:]+)(?::[0-9]*)?$"
BAD_PERCENT = "%(?![0-9A-Fa-f]{2})"
MAX_URL = 8192
MAX_PAGE_URL = 1 << 20


def _encode_path(path: Column) -> Column:
    """Percent-encode what a path may not hold; existing escapes stay."""
    encoded = nested(
        [
            ("+", "%20"),
            ("*", "%2A"),
            ("%7E", "~"),
            ("%24", "$"),
            ("%26", "&"),
            ("%2B", "+"),
            ("%2C", ","),
            ("%2F", "/"),
            ("%3A", ":"),
            ("%3B", ";"),
            ("%3D", "="),
            ("%40", "@"),
            ("%25", "%"),
        ],
        F.url_encode(path),
    )
    return F.when(path.rlike(SAFE_PATH), path).otherwise(encoded)


def _remove_dots(path: Column) -> Column:
    """Dot segments of a path that starts with '/'."""
    parts = F.split(path, "/")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    start = F.array(F.lit("")).cast("array<string>")
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)
    joined = F.array_join(F.concat(kept, tail), "/")
    return F.when(path.rlike("/\\.\\.?(?:/|$)"), F.when(joined == "", "/").otherwise(joined)).otherwise(path)


def resolve_url(base: Column | str, raw: Column | str) -> Column:
    """``raw`` against ``base``: an http(s) address without credentials or fragment, or ''."""
    base = col(base)

    def build(both: Column) -> Column:
        ref, scheme, authority, path, query = (both["r"][i] for i in range(5))
        own_host = authority != ""
        own = (scheme != "") | own_host
        base_path = both["b"][2]
        merged = (
            F.when(path == "", F.when(own, F.lit("")).otherwise(base_path))
            .when(F.startswith(path, F.lit("/")), path)
            .when(own, F.concat(F.lit("/"), path))
            .otherwise(F.concat(F.regexp_extract(base_path, "^(.*/)?", 0), path))
        )
        absolute = F.when((merged == "") | F.startswith(merged, F.lit("/")), merged).otherwise(F.concat(F.lit("/"), merged))
        return F.struct(
            F.lower(F.when(scheme != "", scheme).otherwise(both["b"][0])).alias("scheme"),
            F.substring(F.when(own, authority).otherwise(both["b"][1]), 3, MAX_PAGE_URL).alias("host"),
            let(absolute, lambda p: _remove_dots(_encode_path(p))).alias("path"),
            F.when(~own & (path == "") & (query == ""), both["b"][3]).otherwise(query).alias("query"),
            (
                ((scheme != "") & ~own_host)
                | (~own & path.rlike("^[^/]*:"))
                | path.rlike(BAD_PERCENT)
                | both["r"][5].rlike(BAD_PERCENT)
            ).alias("bad"),
        )

    def parse(ref: Column) -> Column:
        parts = F.struct(F.concat(F.array(ref), groups(ref, REFERENCE, 5)).alias("r"), groups(base, REFERENCE, 5).alias("b"))
        address = let(
            let(parts, build),
            lambda u: F.when(
                ~u["bad"] & u["scheme"].isin("http", "https") & u["host"].rlike(HOST),
                F.concat(u["scheme"], F.lit("://"), u["host"], u["path"], u["query"]),
            ).otherwise(F.lit("")),
        )
        return F.when((ref == "") | ref.rlike("[\\x00-\\x1F\\x7F]"), F.lit("")).otherwise(address)

    return F.coalesce(let(strip(raw), parse), F.lit(""))


def is_http_url(value: Column | str) -> Column:
    """Absolute http(s) address without credentials or white space."""
    value = col(value)
    return value.rlike("^(?i:https?)://[^/?#@\\s]+(?:[/?#]|$)") & ~value.rlike("\\s")


def url_host(value: Column | str) -> Column:
    return F.regexp_extract(col(value), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def without_fragment(value: Column | str) -> Column:
    return F.regexp_replace(col(value), "#.*$", "")
