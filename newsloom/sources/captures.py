"""Captured pages: scans, decoding to text, and the streaming form."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.columns import first_of, let

MAX_BODY = 4 << 20
PRESCAN_BYTES = 1024

CAPTURE_SCHEMA = (
    "page_id bigint, feed_id string, url string, status int, content_type string, html string, captured_at timestamp"
)


def read_captures(captures: DataFrame) -> DataFrame:
    """Usable page bodies: status 200 and at most 4 MiB."""
    return captures.filter((F.col("status") == 200) & (F.octet_length("html") <= MAX_BODY))


def capture_outcomes(captures: DataFrame) -> DataFrame:
    """What each capture gives: a body, 'unchanged', or a failure."""
    outcome = (
        F.when(F.col("status") == 304, "unchanged")
        .when(F.col("status") != 200, "failed")
        .when(F.octet_length("html") > MAX_BODY, "too large")
        .otherwise("read")
    )
    return captures.withColumn("outcome", outcome)


def changed_captures(captures: DataFrame, seen: DataFrame) -> DataFrame:
    """Captures whose body differs from the one read before; the rest need no parse at all."""
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    return captures.withColumn("digest", digest).join(seen.select("url", "digest"), ["url", "digest"], "left_anti").drop("digest")


def captures_stream(spark: SparkSession, folder: str, schema: str = CAPTURE_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


# ------------------------------------------------------------------ decoding


def charset_labels() -> dict[str, str]:
    """Label to encoding name. Regular families are generated; irregular labels are listed."""
    labels: dict[str, str] = {}
    for part in list(range(2, 9)) + [10, 13, 14, 15, 16]:
        name = f"iso-8859-{part}"
        for label in (name, f"iso8859-{part}", f"iso8859{part}", f"iso_8859-{part}"):
            labels[label] = name
    for page in range(1250, 1259):
        for label in (f"windows-{page}", f"cp{page}", f"x-cp{page}"):
            labels[label] = f"windows-{page}"
    # Labels that follow no rule.
    irregular = {
        "windows-1252": "ascii us-ascii iso-8859-1 iso8859-1 iso88591 iso_8859-1 latin1 l1 cp819 ibm819 csisolatin1 iso-ir-100",
        "windows-1254": "iso-8859-9 iso8859-9 iso88599 latin5 l5",
        "windows-874": "windows-874 iso-8859-11 tis-620 dos-874",
        "iso-8859-2": "latin2 l2",
        "iso-8859-5": "cyrillic",
        "iso-8859-7": "greek greek8",
        "koi8-r": "koi8-r koi8 koi cskoi8r",
        "koi8-u": "koi8-u koi8-ru",
        "macintosh": "macintosh mac x-mac-roman",
        "shift_jis": "shift_jis shift-jis sjis x-sjis ms_kanji windows-31j ms932 csshiftjis",
        "euc-jp": "euc-jp x-euc-jp cseucpkdfmtjapanese",
        "iso-2022-jp": "iso-2022-jp csiso2022jp",
        "gbk": "gbk gb2312 gb_2312 gb_2312-80 chinese csgb2312 x-gbk",
        "gb18030": "gb18030",
        "big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
        "euc-kr": "euc-kr korean ks_c_5601-1987 ksc5601 ks_c_5601-1989 cseuckr windows-949",
        "utf-8": "utf-8 utf8 unicode-1-1-utf-8 x-unicode20utf8",
        "utf-16le": "utf-16le utf-16 unicode ucs-2 csunicode unicodefeff",
        "utf-16be": "utf-16be unicodefffe",
        "replacement": "replacement iso-2022-kr iso-2022-cn iso-2022-cn-ext hz-gb-2312 csiso2022kr",
        "x-user-defined": "x-user-defined",
    }
    for name, words in irregular.items():
        for label in words.split():
            labels[label] = name
    return labels


# Encoding names the JVM spells differently.
JVM_NAMES = {"macintosh": "x-MacRoman", "windows-874": "x-windows-874", "shift_jis": "windows-31j", "euc-kr": "x-windows-949", "gbk": "GB18030"}


def _lookup(label: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(charset_labels())), "map<string,string>")
    return F.try_element_at(table, F.lower(F.trim(label)))


def _quoted_value(source: Column, name: str) -> Column:
    """The value of one attribute inside a tag's attribute text."""
    pattern = f"(?is)(?:^|[\\s/\"'])(?:{name})\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
    return F.regexp_replace(F.regexp_extract(source, pattern, 1), "^[\"']|[\"']$", "")


def _meta_charset(head: Column) -> Column:
    tags = F.regexp_extract_all(F.regexp_replace(head, "(?s)<!--.*?(?:-->|$)", ""), F.lit("(?is)<meta([\\s/][^>]*)>"), F.lit(1))

    def name(tag: Column) -> Column:
        bare = F.regexp_replace(tag, "(?is)[\\s/\"']content\\s*=\\s*(?:\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)", " ")
        declared = _quoted_value(bare, "charset")
        pragma = F.lower(_quoted_value(tag, "http-equiv")) == "content-type"
        inner = F.regexp_extract(F.lower(_quoted_value(tag, "content")), "charset\\s*=\\s*[\"']?([^\"'\\s;]+)", 1)
        return _lookup(F.when(declared != "", declared).when(pragma, inner))

    return first_of(F.filter(F.transform(tags, name), lambda n: n.isNotNull()))


# The grammar of an XML declaration: EncodingDecl ::= S 'encoding' Eq quote EncName quote, after the version.
_S = "[\\x20\\x09\\x0D\\x0A]"
XML_ENCODING = f"^{_S}*<[?]xml(?:{_S}+version{_S}*={_S}*(?:'[^'<>]*'|\"[^\"<>]*\"))?{_S}+encoding{_S}*={_S}*(['\"])([A-Za-z][A-Za-z0-9._-]*)\\1"


def declared_charset(body: Column, content_type: Column, xml: bool = False) -> Column:
    """Encoding name from the header, else from the start of the document; NULL when none is known."""
    header = _lookup(F.regexp_extract(F.lower(F.coalesce(content_type, F.lit(""))), "charset\\s*=\\s*[\"']?([^\"'\\s;]+)", 1))
    head = F.decode(F.substring(body, 1, PRESCAN_BYTES), "ISO-8859-1")
    if xml:
        declared = _lookup(
            F.regexp_extract(head, XML_ENCODING, 2)
        )
    else:
        declared = _meta_charset(head)
    # Text readable as ASCII is not UTF-16, whatever it says.
    declared = F.when(F.startswith(declared, F.lit("utf-16")), "utf-8").when(declared == "x-user-defined", "windows-1252").otherwise(declared)
    return F.coalesce(header, declared)


def mostly_utf8(body: Column) -> Column:
    """More valid multi-byte characters than bytes that are not UTF-8."""

    def compare(text: Column) -> Column:
        replaced = F.char_length(text) - F.char_length(F.replace(text, F.lit("\ufffd"), F.lit("")))
        invalid = F.octet_length(body) - (F.octet_length(text) - 3 * replaced)
        valid = F.char_length(F.regexp_replace(text, "[\\x00-\\x7F\\uFFFD]", ""))
        return valid > invalid

    return let(F.make_valid_utf8(body.cast("string")), compare)


def decode_captures(captures: DataFrame, xml: bool = False) -> DataFrame:
    """captures(body BINARY, content_type) -> adds charset, html and decode_status."""
    body = F.col("body")
    mark = F.hex(F.substring(body, 1, 3))
    marked = (
        F.when(mark == "EFBBBF", "utf-8")
        .when(F.startswith(mark, F.lit("FEFF")), "utf-16be")
        .when(F.startswith(mark, F.lit("FFFE")), "utf-16le")
    )
    declared = declared_charset(body, F.col("content_type"), xml)
    keep = declared.isNull() | declared.isin("utf-8", "replacement") | mostly_utf8(body)
    named = captures.withColumn("_declared", declared).withColumn(
        "charset", F.coalesce(marked, F.when(~keep, declared), F.lit("utf-8"))
    )
    skip = F.when(F.startswith(mark, F.lit("FEFF")) | F.startswith(mark, F.lit("FFFE")), F.substring(body, 3, MAX_BODY)).otherwise(body)
    decoded = F.when(F.col("charset") == "utf-8", body.cast("string"))
    # One branch per encoding in use: decode() then has a constant name and stays compiled.
    for name in sorted(set(charset_labels().values()) - {"utf-8", "replacement", "x-user-defined"}):
        decoded = decoded.when(F.col("charset") == name, F.decode(skip, JVM_NAMES.get(name, name)))
    out = named.withColumn("html", decoded).drop("_declared")
    fits = F.octet_length("html") <= MAX_BODY
    return out.withColumn("decode_status", F.when(fits, "ok").otherwise("too large")).withColumn("html", F.when(fits, F.col("html")))
