"""Scalar text expressions (all JVM-side, inside whole-stage codegen).

Character classes are spelled out instead of using ``\\s``/``\\w``/``\\b``:
Java, RE2 (DuckDB) and Python disagree on what those mean for non-ASCII text,
while explicit classes behave the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace set (what Python's str.split()/str.strip() use).
WS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_CLASS = f"[{WS}]"
NON_WS_CLASS = f"[^{WS}]"
# Word characters: letters, digits, underscore (Unicode aware).
WORD = r"\p{L}\p{N}_"
WORD_CLASS = f"[{WORD}]"
NON_WORD_CLASS = f"[^{WORD}]"
TOKEN_PATTERN = f"{WORD_CLASS}{{2,}}"      # tokens of two or more word characters
ANY_TOKEN_PATTERN = f"{WORD_CLASS}+"       # tokens of any length
WORD_RUNS_PATTERN = f"{WORD_CLASS}+|{NON_WORD_CLASS}+"  # alternating word / separator runs


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def has_text(col) -> Column:
    """text is neither null nor the empty string (blank text is kept)."""
    c = _c(col)
    return c.isNotNull() & (c != F.lit(""))


def not_blank(col) -> Column:
    """text holds at least one non-whitespace character."""
    return F.coalesce(_c(col).rlike(NON_WS_CLASS), F.lit(False))


# Non-ASCII members of the whitespace set, folded to a space with ``translate``
# (a per-character map) so the split below can use a short ASCII class.
UNICODE_WS = "".join(chr(c) for c in [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                        0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_ASCII_WS_RUN = r"[\t\n\x0B\f\r ]+"


def word_count(col) -> Column:
    """Whitespace-separated word count (Python ``len(text.split())``)."""
    folded = F.translate(_c(col), UNICODE_WS, " " * len(UNICODE_WS))
    return F.size(F.filter(F.split(folded, _ASCII_WS_RUN), lambda w: w != F.lit("")))


def _split_at_least(c: Column, n: int) -> Column:
    pieces = F.split(c, f"{WS_CLASS}+", n + 2)    # stops after n + 1 splits
    return F.size(F.filter(pieces, lambda w: w != F.lit(""))) >= n


def word_count_at_least(col, n: int, prefix_chars: int = 4000) -> Column:
    """``word_count(col) >= n`` without scanning whole texts.

    A split limited to n + 2 pieces holds at least n non-empty pieces exactly
    when the text has at least n words (the last piece is the unsplit rest).
    It is tried on the first ``prefix_chars`` characters first: a word cut at the
    prefix end still counts once, so n words in the prefix imply n in the text;
    only texts that are longer and fall short in the prefix are split in full.
    """
    c = _c(col)
    return (F.when(_split_at_least(F.substring(c, 1, prefix_chars), n), F.lit(True))
            .when(F.length(c) > prefix_chars, _split_at_least(c, n))
            .otherwise(F.lit(False)))


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def restore_paragraphs(col) -> Column:
    """Closing paragraph tags become blank lines (before tag stripping)."""
    return F.replace(_c(col), F.lit("</p>"), F.lit("\n\n"))


def strip_tags(col) -> Column:
    """Every ``<...>`` tag becomes one space, then the ends are stripped."""
    return strip_ws(F.regexp_replace(_c(col), "<[^>]+>", " "))


def tokens(col, min_len: int = 2) -> Column:
    """Lower-cased word tokens of at least ``min_len`` word characters.

    Same tokens as extracting ``[\\p{L}\\p{N}_]{min_len,}``, computed as a split on
    non-word runs plus a length filter (about a third faster on long texts).
    """
    parts = F.split(F.lower(_c(col)), f"{NON_WORD_CLASS}+")
    return F.filter(parts, lambda t: F.length(t) >= min_len)


def word_runs(col) -> Column:
    """Alternating runs of word and non-word characters; joined they give the text back."""
    return F.regexp_extract_all(_c(col), F.lit(WORD_RUNS_PATTERN), 0)


def bigrams(tok: Column) -> Column:
    """Adjacent token pairs joined by one space."""
    n = F.size(tok)
    return F.when(
        n >= 2,
        F.zip_with(F.slice(tok, 1, n - 1), F.slice(tok, 2, n - 1),
                   lambda a, b: F.concat(a, F.lit(" "), b)),
    ).otherwise(F.array().cast("array<string>"))


def clip(col, n: int) -> Column:
    """The first ``n`` characters (code points)."""
    return F.substring(_c(col), 1, n)


def model_slug(col) -> Column:
    """K2: model name made safe for file names (``/`` and ``:`` become ``-``)."""
    return F.regexp_replace(_c(col), "[/:]", "-")


def last_segment(col) -> Column:
    """Short model name: the part after the last ``/``."""
    return F.element_at(F.split(_c(col), "/"), -1)
