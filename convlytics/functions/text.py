"""Column helpers for line- and word-oriented text work.

Everything here is a native Catalyst expression: text is read where the row lives and
nothing is exploded or shuffled.  Plain byte searches (``contains``, ``trim``, ``split``
on one character) do the common work; regular expressions run only where a cheap test
says they can match, and are written to be linear and without deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\p{IsWhite_Space}"
HSPACE = rf"[{WS}&&[^\n]]"
ALNUM = r"\p{IsAlphabetic}\p{N}"

# The code points with the Unicode White_Space property.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A code fence from its opening line to its closing line, or to the end of the text.
FENCE = r"(?smd)^```.*?(?:\n```[^\n]*+|\z)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    return F.trim(text, F.lit(WS_CHARS))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{WS}]")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def lines(text: Column) -> Column:
    """Lines without their ending; no extra empty line after a final newline."""

    def of(t: Column) -> Column:
        # The piece after a final newline, and the one piece of an empty text, are dropped.
        extra = (t.endswith("\n") | (t == "")).cast("int")
        mixed = F.split(F.regexp_replace(t, r"\r?\n\z", ""), r"\r?\n")
        unix = let(F.split(t, "\n"), lambda p: F.slice(p, 1, F.size(p) - extra))
        return F.when(t.contains("\r\n"), mixed).otherwise(unix)

    return let(text, of)


def fold_case(text: Column) -> Column:
    """Case-insensitive form: both directions, so that no special letter is missed."""
    return F.lower(F.upper(text))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    out = None
    for needle in needles:
        hit = text.contains(needle)
        out = hit if out is None else out | hit
    return out


def starts_with_any(text: Column, needles: Iterable[str]) -> Column:
    out = None
    for needle in needles:
        hit = text.startswith(needle)
        out = hit if out is None else out | hit
    return out


def without_code_spans(text: Column) -> Column:
    """Blank out back-ticked spans; an unclosed one runs to the end."""
    return let(
        text,
        lambda t: F.when(t.contains("`"), F.regexp_replace(t, r"`[^`]*+(?:`|\z)", " ")).otherwise(t),
    )


def words(text: Column) -> Column:
    """Lower-cased words of more than two bytes, stripped of outer punctuation."""
    cores = F.regexp_extract_all(text, F.lit(rf"[{ALNUM}](?:[^{WS}]*[{ALNUM}])?"), F.lit(0))
    return F.filter(F.transform(cores, F.lower), lambda w: F.octet_length(w) > 2)


def has_marker_line(text: Column, markers: str) -> Column:
    """Some line is one of the marker characters followed by whitespace or its end."""
    return text.rlike(rf"(?md)^[{markers}](?:[{WS}]|\z)")


def last_nonblank_line(text: Column) -> Column:
    """The last line with a visible character ('' when there is none)."""
    return F.substring_index(trim_end(text), "\n", -1)


def without_fences(text: Column) -> Column:
    """Replace each fenced block by a neutral, non-blank line."""
    return let(
        text, lambda t: F.when(t.contains("```"), F.regexp_replace(t, FENCE, "`")).otherwise(t)
    )


def normalized_hash(text: Column) -> Column:
    """SHA-256 of the text with every line right-trimmed."""
    return F.sha2(F.array_join(F.transform(lines(text), trim_end), "\n").cast("binary"), 256)


def is_json(text: Column) -> Column:
    """Strict JSON check: one document and nothing after it.

    The text is parsed once inside an array and once inside an object; a stray closing
    bracket can satisfy one of the wrappers but never both.
    """
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

    def parses_once(before: str, body: Column, after: str, schema: str) -> Column:
        wrapped = F.concat(F.lit(before), body, F.lit(after))
        return F.coalesce(F.size(F.from_json(wrapped, schema, options)) == 1, F.lit(False))

    return let(
        text,
        lambda t: parses_once("[", t, "]", "array<string>")
        & parses_once('{"v":', t, "}", "map<string,string>"),
    )
