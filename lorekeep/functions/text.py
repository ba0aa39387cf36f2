"""Turning marked-up text into plain text and plain text into tokens."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word-break classes after Unicode UAX #29.  Letters may be
# joined by MidLetter/MidNumLet, digits by MidNum/MidNumLet; an ideograph or a
# hiragana sign is a word by itself.  Possessive quantifiers keep the JVM
# matcher iterative, whatever the length of the text.
_LETTER = r"[^\P{L}\p{IsHan}\p{IsHiragana}]\p{M}*+"
_LETTERS = rf"(?:[a-z]|{_LETTER})++"
TOKEN = (
    rf"(?:{_LETTERS}(?:[.:·'‘’]{_LETTERS})*+"
    r"|\p{N}++(?:[.,;'‘’]\p{N}++)*+"
    r"|_++)++"
    r"|[\p{IsHan}\p{IsHiragana}]"
)
MAX_TOKEN_LENGTH = 255

# Tags that do not break a word; every other tag does.
INLINE_TAGS = [
    "a", "abbr", "acronym", "b", "basefont", "bdo", "big", "cite", "code",
    "dfn", "em", "font", "i", "img", "input", "kbd", "label", "q", "s", "samp",
    "select", "small", "span", "strike", "strong", "sub", "sup", "textarea",
    "tt", "u", "var",
]
# The named entities that occur most.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
]
HIDDEN_BLOCKS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
COMMENTS = r"(?s)<!--.*?-->"
INLINE_TAG = r"(?i)</?(?:" + "|".join(INLINE_TAGS) + r")(?:\s[^>]*|/)?>"
ANY_TAG = r"<[/!?]?[A-Za-z][^>]*>"
# A numeric or named reference; the names are those of the published table.
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMES = "\x02".join(f"{name[:-1]}\x01{sign}" for name, sign in html5.items() if name.endswith(";"))

# The default English stop words of the search server.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in",
    "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the",
    "their", "then", "there", "these", "they", "this", "to", "was", "will",
    "with",
]


def _with(value: Column, build) -> Column:
    """Bind a computed value to a name, so that it is worked out once only."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _named(name: Column) -> Column:
    """Sign of a named reference, the common ones first; null for an unknown name."""
    common = F.when(name == "", None)
    for entity, sign in ENTITIES:
        common = common.when(name == entity[1:-1], F.lit(sign))
    return F.coalesce(common, F.try_element_at(F.str_to_map(F.lit(NAMES), F.lit("\x02"), F.lit("\x01")), name))


def _code_point(code: Column) -> Column:
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    hexed = F.lpad(F.hex(F.when(valid, code).otherwise(F.lit(0xFFFD))), 8, "0")
    return F.decode(F.unhex(hexed), "UTF-32")


def _sign(reference: Column) -> Column:
    """What a reference, without its ampersand and semicolon, stands for."""
    return (
        F.when(F.lower(reference).startswith("#x"), _code_point(F.conv(F.substr(reference, F.lit(3)), 16, 10).cast("int")))
        .when(reference.startswith("#"), _code_point(F.substr(reference, F.lit(2)).cast("int")))
        .otherwise(F.coalesce(_named(reference), F.concat(F.lit("&"), reference, F.lit(";"))))
    )


def _decoded(text: Column) -> Column:
    signs = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 1), _sign)
    whole = F.array_join(
        F.zip_with(F.split(text, REFERENCE), signs, lambda piece, sign: F.concat(piece, F.coalesce(sign, F.lit("")))), ""
    )
    return F.when(text.contains("&"), whole).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Decode named, decimal and hexadecimal references in one pass over the text."""
    return _with(text, _decoded)


def strip_tags(html: Column) -> Column:
    """Drop scripts, styles, comments and tags; only block tags part words."""
    text = F.regexp_replace(html, HIDDEN_BLOCKS, "\n")
    text = F.regexp_replace(text, COMMENTS, "")
    text = F.regexp_replace(text, INLINE_TAG, "")
    text = F.regexp_replace(text, ANY_TAG, "\n")
    return F.when(html.contains("<"), text).otherwise(html)


def strip_html(html: Column) -> Column:
    """The character filter of the content analyzer: no markup, signs decoded."""
    return decode_entities(strip_tags(html))


def plain_text(html: Column) -> Column:
    """Marked-up text to readable text: stripped, decoded, blanks collapsed."""
    lines = F.regexp_replace(strip_html(html), r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(lines, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def _capped(words: Column) -> Column:
    cut = F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(f".{{1,{MAX_TOKEN_LENGTH}}}"), 0))
    return F.when(F.exists(words, lambda w: F.length(w) > MAX_TOKEN_LENGTH), F.flatten(cut)).otherwise(words)


def tokens(text: Column) -> Column:
    """Words of a text in order, in their own case; none longer than the cap."""
    return _with(F.regexp_extract_all(text, F.lit(TOKEN), 0), _capped)
