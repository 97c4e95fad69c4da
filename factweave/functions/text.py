"""Text expressions: HTML to text, sentences, excerpts, wording checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

_COMMENT = r"(?s)<!--.*?-->"
_SILENT = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>"
# A tag ends at the first > outside a quoted attribute value.
_TAG = r"""<[a-zA-Z/!?][^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|)[^>=]*+)*+>"""
# White space of Unicode beyond ASCII, whose classes are fast; a lone blank stays as it is.
_WIDE_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANKS = r"[\t-\r]\s*+| \s++"


# --- fixed values: numeric references that stand for another character ----------
REPLACED = {
    0x00: "\ufffd", 0x0D: "\r", 0x80: "\u20ac", 0x81: "\x81", 0x82: "\u201a", 0x83: "\u0192", 0x84: "\u201e", 0x85: "\u2026", 0x86: "\u2020", 0x87: "\u2021",
    0x88: "\u02c6", 0x89: "\u2030", 0x8A: "\u0160", 0x8B: "\u2039", 0x8C: "\u0152", 0x8D: "\x8d", 0x8E: "\u017d", 0x8F: "\x8f", 0x90: "\x90", 0x91: "\u2018",
    0x92: "\u2019", 0x93: "\u201c", 0x94: "\u201d", 0x95: "\u2022", 0x96: "\u2013", 0x97: "\u2014", 0x98: "\u02dc", 0x99: "\u2122", 0x9A: "\u0161",
    0x9B: "\u203a", 0x9C: "\u0153", 0x9D: "\x9d", 0x9E: "\u017e", 0x9F: "\u0178",
}
# Code points that a reference may not name: control characters and non-characters.
BARRED = [(0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF), *[(p << 16 | 0xFFFE, p << 16 | 0xFFFF) for p in range(17)]]


def _numbered(code: Column) -> Column:
    """Character of a code point as HTML reads it."""
    replaced = F.try_element_at(F.create_map(*[x for k, v in REPLACED.items() for x in (F.lit(k).cast("long"), F.lit(v))]), code)
    barred = reduce(lambda a, b: a | b, [code.between(low, high) for low, high in BARRED])
    outside = code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.coalesce(replaced, F.when(outside, F.lit("\ufffd")).when(barred, F.lit("")).otherwise(character))


def unescaped(text: Column) -> Column:
    """Text with its character references decoded: numbers, and the named references of HTML 5.

    A name without its semicolon is read as far as a name is known that may go without one.
    """
    # One literal: a map of some thousand literals would cost more to plan than to use.
    table = F.str_to_map(F.lit("\x01".join(f"{name}\x02{value}" for name, value in html5.items())), F.lit("\x01"), F.lit("\x02"))
    loose = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))

    def decoded(part: Column) -> Column:
        """A part of the text that stood after an ampersand."""
        digits, hexadecimal = F.regexp_extract(part, "^#([0-9]+)", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+)", 1)
        numeric = F.regexp_extract(part, "^(?:#[0-9]+|#[xX][0-9a-fA-F]+);?", 0)
        # More than nine figures lie beyond all code points, leading zeros aside.
        tail = lambda c, keep: F.regexp_replace(c, "^0+(?=.)", "").substr(F.lit(1), F.lit(keep))
        code = F.when(digits != "", tail(digits, 9).try_cast("long")).otherwise(F.conv(tail(hexadecimal, 9), 16, 10).try_cast("long"))
        name = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
        exact = F.try_element_at(table, name)
        short = F.regexp_extract(part, f"^(?:{loose})", 0)
        rest = lambda head: F.substring(part, F.length(head) + 1, F.length(part))
        return (
            F.when(numeric != "", F.concat(_numbered(code), rest(numeric))).when(exact.isNotNull(), F.concat(exact, rest(name)))
            .when((short != "") & (name != ""), F.concat(F.try_element_at(table, short), rest(short))).otherwise(F.concat(F.lit("&"), part)))

    parts = F.split(text, "&")
    later = F.transform(F.slice(parts, 2, F.size(parts)), decoded)
    return F.when(F.contains(text, F.lit("&")), F.concat(parts[0], F.array_join(later, ""))).otherwise(text)


def collapse_blanks(c: Column) -> Column:
    plain = F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, _WIDE_BLANKS, " " * len(_WIDE_BLANKS)))
    return F.trim(F.regexp_replace(plain, _BLANKS, " "))


def with_html_text(df: DataFrame, content: str, output: str = "text") -> DataFrame:
    """Add the visible text of an HTML document, entities decoded, blanks collapsed.

    Markup is removed by regular expressions and references are decoded by built-in
    functions, all in the JVM. The stripped text is a column of its own so that it is
    computed once.
    """
    html_column = F.col(content)
    uncommented = F.when(F.contains(html_column, F.lit("<!--")), F.regexp_replace(html_column, _COMMENT, " ")).otherwise(html_column)
    bare = F.regexp_replace(F.regexp_replace(uncommented, _SILENT, " "), _TAG, " ")
    stripped = df.withColumn("_bare", bare)
    return stripped.withColumn("_plain", unescaped(F.col("_bare"))).withColumn(output, collapse_blanks(F.col("_plain"))).drop("_bare", "_plain")


def sentences(text: Column) -> Column:
    """Array of trimmed sentences, split before a capital or digit."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])")
    # F.trim takes a second argument: passed as it is, it would get the position as the characters to trim.
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def match_start(text: Column, pattern: str) -> Column:
    """1-based position of the first match, 0 when there is none."""
    return F.regexp_instr(text, F.lit(pattern))


def match_text(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 0)


def excerpt(text: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """The sentence around a match: from the previous `. ` to the next, else a fixed reach.

    `start` is 1-based.
    """
    head = F.substring(text, F.lit(1), start - 1)
    tail_from = start + length
    tail = F.substring(text, tail_from, F.length(text))
    left = F.when(F.contains(head, F.lit(". ")), start - F.length(F.substring_index(head, ". ", -1))).otherwise(
        F.greatest(F.lit(1), start - before))
    stop = F.instr(tail, ". ")
    right = F.when(stop > 0, tail_from + stop - 1).otherwise(F.least(F.length(text), tail_from + after - 1))
    return F.trim(F.substring(text, left, right - left + 1))


def word_pattern(words: Sequence[str]) -> str:
    """Whole words in any case, Unicode-aware, inner blanks of any length."""
    escaped = [r"\s+".join(w.split()) for w in words]
    return r"(?iuU)\b(?:" + "|".join(escaped) + r")\b"


def uses_words(c: Column, words: Sequence[str]) -> Column:
    return c.rlike(word_pattern(words))


def has_part(c: Column, parts: Sequence[str]) -> Column:
    """Whether the lower-cased text holds one of the parts, inside words too."""
    lowered = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in parts])


def claim_kind(statement: Column, families: Mapping[str, str]) -> Column:
    """The only pattern family that matches, else `other`."""
    hits = {kind: statement.rlike(pattern) for kind, pattern in families.items()}
    count = reduce(lambda a, b: a + b, [h.cast("int") for h in hits.values()])
    chosen = F.coalesce(*[F.when(h, F.lit(kind)) for kind, h in hits.items()])
    return F.when(count == 1, chosen).otherwise(F.lit("other"))
