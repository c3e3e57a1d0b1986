"""Text expressions, all built-in and JVM-side."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens.functions.binding import bind
from faultlens.functions.wordlists import ENGLISH_STOP_WORDS

# Headings that the report template puts into every description.
TEMPLATE_PHRASES = (
    "Detailed problem description:",
    "Step by step, how to reproduce:",
    "Available workarounds:",
)

# Possessive runs: read in a loop, without a step on the stack for each character.
_ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
# Where a text node ends: script and style with their content (an open one runs to the end; one that closes itself
# has none), comments, declarations, tags.
_NODE_BREAK = (
    rf"(?is)<(script|style)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?(?:</\1(?=[\s/>])[^>]*+>|\z)"
    rf"|<!--.*?-->|<[!?][^>]*>|</?[a-z]{_ATTRIBUTES}>"
)
_EDGE_BLANKS = r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$"


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_BLANKS, "")


# Character references as in the HTML standard. The names, and the numbers that do not stand for
# their own character, come from Python's tables; names without ';' count as beginnings of longer words.
_NAMES = json.dumps(html5)
_BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_SPECIAL_NUMBERS = json.dumps(
    {
        str(code): shown
        for code in [*range(160), *range(0xFDD0, 0xFDF0), *(plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF))]
        if (shown := html.unescape(f"&#{code};")) != chr(code)
    }
)
_REPLACEMENT = "\ufffd"  # for surrogates and numbers beyond the last character


def _numbered(code: Column, special: Column) -> Column:
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD).cast("int")), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(special, code.cast("string")), F.when(valid, plain).otherwise(_REPLACEMENT))


def _number(digits: Column, base: int, longest: int) -> Column:
    """Value of a run of digits of any length; one too long for a character is a large number."""
    short = F.regexp_replace(digits, "^0+", "")
    value = F.coalesce(F.conv(F.substring(short, 1, longest), base, 10).try_cast("long"), F.lit(0).cast("long"))
    return F.when(F.length(short) > longest, F.lit(0x110000).cast("long")).otherwise(value)


def _decode_piece(piece: Column, names: Column, special: Column) -> Column:
    """A piece is what follows an '&': decode the reference it starts with, if it is one."""
    digits = F.regexp_extract(piece, r"^#([0-9]++);?", 1)
    hexa = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]++);?", 1)
    word = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)
    bare = F.regexp_extract(piece, rf"^(?:{_BARE_NAMES})", 0)
    after = lambda pattern: F.regexp_replace(piece, pattern, "")
    behind = lambda start: F.substring(piece, F.length(start) + 1, F.length(piece))
    return (
        F.when(digits != "", F.concat(_numbered(_number(digits, 10, 7), special), after(r"^#[0-9]++;?")))
        .when(hexa != "", F.concat(_numbered(_number(hexa, 16, 6), special), after(r"^#[xX][0-9a-fA-F]++;?")))
        .when(F.try_element_at(names, word).isNotNull(), F.concat(F.try_element_at(names, word), behind(word)))
        .when(bare != "", F.concat(F.try_element_at(names, bare), behind(bare)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def decode_entities(text: Column) -> Column:
    """Decode character references in one left-to-right pass; what is none stays as it is."""
    table = lambda text: F.from_json(F.lit(text), "map<string,string>")

    def join_decoded(pieces: Column) -> Column:
        later = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        decoded = F.transform(later, lambda p: _decode_piece(p, table(_NAMES), table(_SPECIAL_NUMBERS)))
        return F.concat(F.element_at(pieces, 1), F.array_join(decoded, ""))

    return F.when(~text.contains("&"), text).otherwise(bind(F.split(text, "&"), join_decoded))


def html_to_text(html: Column) -> Column:
    """Text nodes without script and style, each trimmed, empty ones dropped, one per line."""
    nodes = F.filter(F.split(html, _NODE_BREAK), lambda n: n.rlike(r"\S"))
    clean = F.transform(nodes, lambda n: strip_blanks(decode_entities(n)))
    return F.array_join(F.filter(clean, lambda n: n != ""), "\n")


def combine_text(title: Column, description: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def strip_template(text: Column, phrases=TEMPLATE_PHRASES) -> Column:
    any_phrase = "|".join("\\Q" + p + "\\E" for p in phrases)
    return F.regexp_replace(text, rf"(?i)(?:{any_phrase})\s*:?\s*", "")


def decamelcase(text: Column) -> Column:
    """Blank before an upper-case letter after a lower-case one, or (not first) before a lower-case one."""
    return F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])|(?<!\A)(?=[A-Z][a-z])", " ")


def clean_text(text: Column) -> Column:
    """Lower case; everything but a-z and blanks deleted; blanks squeezed and trimmed."""
    letters = F.regexp_replace(F.lower(text), r"(?U)[^a-z\s]+", "")
    return F.trim(F.regexp_replace(letters, r"(?U)\s+", " "))


def tokenize(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def remove_stopwords(tokens: Column, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """A long literal IN list is turned into a hash-set test by the optimiser."""
    words = list(stop_words)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def content_tokens(text: Column, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """Raw text to cleaned tokens: every cleaning step that needs no table."""
    cleaned = clean_text(decamelcase(strip_template(F.coalesce(text, F.lit("")))))
    return remove_stopwords(tokenize(cleaned), stop_words)


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def _gram_at(tokens: Column, n: int):
    return lambda start: F.array_join(F.slice(tokens, start, n), " ")


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """Word n-grams for every length in low..high."""

    def all_lengths(words: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
            starts = F.coalesce(starts, F.array().cast("array<int>"))
            parts.append(words if n == 1 else F.transform(starts, _gram_at(words, n)))
        return F.concat(*parts)

    return tokens if (low, high) == (1, 1) else bind(tokens, all_lengths)
