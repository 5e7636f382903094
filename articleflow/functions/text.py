"""Column expressions over text, identifiers, HTML and dates."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow import constants as C


# The same white space; most characters of a text are told to be none by the first comparison.
_WHITE = rf"[\x00-\x20\x7F-\uFFFF&&{C.WHITESPACE}]"
_SOLID = f"[^{C.WHITESPACE[1:]}"


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(text, _WHITE + "+"), "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers: the keyword index's terms."""
    return F.array_remove(F.split(F.lower(text), C.TOKEN_BREAK), "")


def token_text(text: Column) -> Column:
    """The words of ``tokens`` as one text, with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), C.TOKEN_BREAK, " "))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends, not just blanks."""
    # From the first to the last solid character; the text between is not searched for white space.
    return F.regexp_extract(text, f"(?s)^{_WHITE}*+(.*{_SOLID})", 1)


def blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space; read up to its first other character."""
    return ~F.rlike(F.coalesce(text, F.lit("")), F.lit(_SOLID))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


# ---------------------------------------------------------------- identifiers

def url_uuid(url: Column) -> Column:
    """Version-5 UUID of a URL."""
    h = F.sha1(F.concat(F.unhex(F.lit(C.URL_NAMESPACE_HEX)), F.encode(url, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def chunk_key(url: Column, chunk_id: Column) -> Column:
    """Stable identifier of one chunk, so that re-processing overwrites instead of duplicating."""
    return F.sha1(F.concat_ws("#", url, chunk_id.cast("string")))


def cache_key(query: Column) -> Column:
    return F.concat(F.lit(C.CACHE_PREFIX), F.sha2(query, 256))


def source_name(feed_url: Column) -> Column:
    """Feed host without ``www.``, first label, in title case (a capital after every non-letter)."""
    host = F.replace(F.get(F.split(feed_url, "/"), 2), F.lit("www."), F.lit(""))
    runs = F.regexp_extract_all(F.get(F.split(host, r"\."), 0), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


# ----------------------------------------------------------------------- HTML

# Text nodes are cut at every tag or comment; script, style and template bodies are not text.
_HIDDEN = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>"
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"""(?s)<[/!?]?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_NODE_BREAK = "\u0001"


_COMMON_NAMES = ("&amp;", "&lt;", "&gt;", "&quot;", "&nbsp;")
# A text in parts: character references, runs without "&", and each remaining "&".
_PARTS = r"(&#[0-9]+;|&#[xX][0-9a-fA-F]+;|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&)"


def _decode_entities(text: Column) -> Column:
    """Character references decoded once, from left to right.

    Unknown names stay as they are; numbers that are no character (or the node mark) become U+FFFD.
    """
    # A look-up walks through the map: names that texts are full of have a short one, met first.
    common = F.create_map(*[F.lit(x) for name in _COMMON_NAMES for x in (name, C.NAMED_REFERENCES[name])])
    names = F.from_json(F.lit(json.dumps(C.NAMED_REFERENCES)), "map<string,string>")

    def decode(part: Column) -> Column:
        hexed = F.conv(F.regexp_extract(part, r"^&#[xX]0*([0-9a-fA-F]+);$", 1), 16, 10)
        digits = F.when(F.substring(part, 3, 1).isin("x", "X"), hexed).otherwise(F.regexp_extract(part, "([0-9]+)", 1))
        code = digits.try_cast("bigint")
        valid = code.between(2, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # The number 65 stands where the branch is not taken: decoding refuses impossible code points.
        safe = F.lpad(F.hex(F.when(valid, code).otherwise(65)), 8, "0")
        char = F.when(valid, F.decode(F.unhex(safe), "UTF-32")).otherwise("\ufffd")
        return (
            F.when(~F.startswith(part, F.lit("&")), part)
            .when(F.startswith(part, F.lit("&#")) & (F.length(part) > 2), char)
            .otherwise(F.coalesce(F.try_element_at(common, part), F.try_element_at(names, part), part))
        )

    parts = F.transform(F.regexp_extract_all(text, F.lit(_PARTS), 1), decode)
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Stripped text nodes joined by one blank."""
    body = html
    for pattern in (_HIDDEN, _COMMENT, _TAG):
        body = F.regexp_replace(body, pattern, _NODE_BREAK)
    nodes = F.transform(F.split(bind(body, _decode_entities), _NODE_BREAK), strip)
    return F.array_join(F.array_remove(nodes, ""), " ")


# ---------------------------------------------------------------------- dates

# Forms accepted after an optional weekday has been cut off (a weekday pattern is refused by Spark's parser).
DATE_FORMATS = (
    "dd MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss Z",
    "dd MMM yyyy HH:mm:ss z",
    "d MMM yyyy HH:mm:ss z",
    "yyyy/MM/dd HH:mm:ss",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)


def lenient_timestamp(text: Column, as_of: Column) -> Column:
    """Any recognised date; ``as_of`` when there is none."""
    bare = F.regexp_replace(text, r"^[A-Za-z]{3,9}, *", "")
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries, as_of)
