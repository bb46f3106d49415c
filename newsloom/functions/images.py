"""Choosing a story's image: attribute cascade, srcset candidates, address checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.columns import col, first_of, let
from newsloom.functions.text import escape_html, strip
from newsloom.functions.urls import resolve_url

MAX_IMAGE_ADDRESS = 8192
MAX_SRCSET = 256 << 10
MAX_LAZY_SRCSET = 16 << 10

# Attribute order of the image cascade.
USUAL_ATTRIBUTES = ("data-src", "data-lazy-src", "src")
USUAL_SRCSETS = ("data-srcset", "srcset")
LAZY_ATTRIBUTES = (
    "data-original",
    "data-orig-src",
    "data-orig-file",
    "data-original-src",
    "data-lazy-original",
    "data-wpfc-original-src",
    "data-lazy",
    "data-lazyload",
    "data-flickity-lazyload",
    "data-flickity-lazyload-src",
    "data-echo",
    "data-breeze",
    "nitro-lazy-src",
    "data-pagespeed-lazy-src",
    "data-cfsrc",
    "data-ezsrc",
    "data-actualsrc",
    "data-image",
    "data-image-src",
    "data-img",
    "data-img-src",
    "data-img-url",
    "data-webp",
    "data-avif",
    "data-thumb",
)
LAZY_SRCSETS = (
    "data-lazy-srcset",
    "data-original-srcset",
    "data-original-set",
    "data-flickity-lazyload-srcset",
    "data-brsrcset",
    "nitro-lazy-srcset",
)
# Image file extensions, and extensions that are certainly something else.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "jfif", "png", "gif", "webp", "avif", "heic", "svg", "bmp", "tif", "tiff")
OTHER_EXTENSIONS = tuple(
    "mp4 m4v webm mov ogv mkv avi wmv flv mpg mpeg ts 3gp m3u8 mpd m4s mp3 m4a ogg oga opus wav flac aac "
    "pdf html htm js mjs css json xml txt zip".split()
)
_IMAGE = "|".join(IMAGE_EXTENSIONS)
_OTHER = "|".join(OTHER_EXTENSIONS)
JOINED = f"(?<=\\.(?i:{_IMAGE})),|,(?=/|(?i:https?://))"
CANDIDATE = "([^\\s,]\\S*?)(?:,+(?=\\s|$)|\\s[^,]*(?:,|$)|$)"


def joined_addresses(value: Column) -> Column:
    """Split addresses joined by a bare comma; a data: payload stays whole."""
    return F.when(value.rlike("^(?i:data:)"), F.array(value)).otherwise(F.split(value, JOINED))


def srcset_candidates(value: Column | str) -> Column:
    """Addresses of a srcset value in order, split the way browsers split it."""
    value = col(value)
    tail = F.regexp_replace(F.regexp_replace(F.right(value, F.lit(MAX_SRCSET)), "^\\s+", ""), "^\\S*(?=\\S\\s)", "")
    bounded = F.when(F.octet_length(value) > MAX_SRCSET, F.regexp_extract(tail, "(?s)^[^,]*,(.*)$", 1)).otherwise(value)
    runs = F.regexp_extract_all(bounded, F.lit(CANDIDATE), F.lit(1))
    return F.flatten(F.transform(runs, joined_addresses))


def is_image_address(value: Column | str) -> Column:
    """A lazy-loading attribute's value can be one image address."""

    def check(v: Column) -> Column:
        path = F.regexp_extract(v, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
        file = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
        web = v.rlike("^(?i:https?)://")
        has_scheme = v.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
        image = file.rlike(f"\\.(?i:{_IMAGE})$")
        named = file.rlike(f"^.+\\.(?i:{_IMAGE})$")
        other = file.rlike(f"\\.(?i:{_OTHER})$")
        single = F.size(joined_addresses(v)) == 1
        bare_path = (
            (file != "")
            & ~file.isin(".", "..")
            & ~F.endswith(path, F.lit("/"))
            & (web | v.rlike("^(?:/|\\./|\\.\\./)"))
        )
        return (
            (v != "")
            & (F.octet_length(v) <= MAX_IMAGE_ADDRESS)
            & ~F.startswith(v, F.lit("/9j/"))
            & ~v.rlike("[{}|<>\"'\\s\\x00-\\x1F\\x7F]")
            & single
            & ~path.rlike("%(?![0-9A-Fa-f]{2})")
            & ~other
            & (web | ~has_scheme)
            & F.when(image, named).otherwise(bare_path)
        )

    return F.coalesce(let(strip(col(value)), check), F.lit(False))


# How a candidate may be used: as it stands, as one of a list, or only when it looks like an image.
DIRECT, LISTED, LAZY = 0, 1, 2


def _tagged(values: Column, kind: int) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(kind).alias("kind")))


def _present(attrs: Column, names: tuple[str, ...]) -> Column:
    """Values of the attributes an element has, in the order of ``names``."""
    listed = F.expr("array(" + ",".join(f"'{n}'" for n in names) + ")")
    return F.filter(F.transform(listed, lambda k: F.try_element_at(attrs, k)), lambda v: v.isNotNull())


def _from_sets(values: Column) -> Column:
    """Candidates of srcset values, the last (normally the largest) of each first."""
    return F.flatten(F.transform(values, lambda v: F.reverse(srcset_candidates(v))))


def _usual(attrs: Column) -> Column:
    return F.concat(
        _tagged(_present(attrs, USUAL_ATTRIBUTES), DIRECT), _tagged(_from_sets(_present(attrs, USUAL_SRCSETS)), LISTED)
    )


def _lazy(attrs: Column) -> Column:
    sets = F.filter(_present(attrs, LAZY_SRCSETS), lambda v: F.octet_length(v) <= MAX_LAZY_SRCSET)
    return _tagged(F.concat(_present(attrs, LAZY_ATTRIBUTES), _from_sets(sets)), LAZY)


def _first_usable(base: Column, candidates: Column) -> Column:
    def address(c: Column) -> Column:
        def usable(resolved: Column) -> Column:
            too_long = (c["kind"] != DIRECT) & (F.octet_length(resolved) > MAX_IMAGE_ADDRESS)
            return F.when(too_long, F.lit("")).otherwise(resolved)

        return F.when((c["kind"] == LAZY) & ~is_image_address(c["value"]), F.lit("")).otherwise(
            let(resolve_url(base, c["value"]), usable)
        )

    return F.coalesce(first_of(F.filter(F.transform(candidates, address), lambda a: a != "")), F.lit(""))


def srcset_address(base: Column, value: Column) -> Column:
    """The last usable candidate of a srcset value, or ''."""
    return _first_usable(base, _tagged(F.reverse(srcset_candidates(value)), LISTED))


def content_image(node: Column, base: Column) -> Column:
    """Address from the attributes images normally keep it in."""
    return _first_usable(base, _usual(node["attrs"]))


def story_image(node: Column, base: Column) -> Column:
    """Usual attributes first; an img element then its lazy-loading attributes."""
    attrs = node["attrs"]
    usual = _usual(attrs)
    return _first_usable(base, F.when(node["tag"] == "img", F.concat(usual, _lazy(attrs))).otherwise(usual))


def image_tag(address: Column) -> Column:
    return F.concat(F.lit('<p><img src="'), escape_html(address), F.lit('" alt=""></p>'))


def with_image(html: Column | str, image: Column | str) -> Column:
    """Prepend the image unless the description already displays that very address."""
    html, image = col(html), col(image)
    shown = html.contains("<img") & html.contains(F.concat(F.lit('src="'), escape_html(image), F.lit('"')))
    return F.when((image == "") | shown, html).otherwise(F.concat(image_tag(image), html))


def image_media_type(address: Column | str) -> Column:
    path = F.regexp_replace(col(address), "(?s)[?#].*$", "")
    out = F.when(F.endswith(path, F.lit(".png")), "image/png")
    for ending, kind in ((".gif", "gif"), (".webp", "webp"), (".svg", "svg+xml"), (".avif", "avif")):
        out = out.when(F.endswith(path, F.lit(ending)), f"image/{kind}")
    return out.otherwise("image/jpeg")


def is_pixel(node: Column) -> Column:
    """Declares itself 0 or 1 pixel wide or high, as tracking images do."""

    def tiny(name: str) -> Column:
        size = F.regexp_replace(strip(F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))), "px$", "")
        return size.isin("0", "1")

    return tiny("width") | tiny("height")
