"""Keyword screening expressions.

Whole-word matching is expressed with explicit word classes so Java (Spark) and
RE2 (the SQL oracle) agree.  Java needs ``(?iud)``: ``i`` case-insensitive,
``u`` Unicode case folding, ``d`` so that only ``\\n`` ends a line (``.`` then
crosses ``\\r`` exactly like Python).  RE2 is Unicode-aware and treats only
``\\n`` as a line end by default, so it needs ``(?i)`` only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NON_WORD_CLASS, WORD, tokens as _tokens

FLAGS = {"spark": "(?iud)", "duckdb": "(?i)"}
NOT_WORD_NOR_NL = f"[^{WORD}\\n]"


def _alt(words) -> str:
    return "(" + "|".join(words) + ")"


def whole_word_pattern(words, engine: str = "spark") -> str:
    """Any of ``words`` as a whole word (words may hold regex such as ``\\s*``)."""
    return f"{FLAGS[engine]}(^|{NON_WORD_CLASS}){_alt(words)}({NON_WORD_CLASS}|$)"


def proximity_pattern(first, second, engine: str = "spark") -> str:
    """A whole word of ``first`` followed on the same line by a whole word of ``second``."""
    return (f"{FLAGS[engine]}(^|{NON_WORD_CLASS}){_alt(first)}{NOT_WORD_NOR_NL}"
            f"(.*{NOT_WORD_NOR_NL})?{_alt(second)}({NON_WORD_CLASS}|$)")


def lexicon_pattern(words, adjectives, nouns, engine: str = "spark") -> list[str]:
    """F8: word list OR adjective..noun OR noun..adjective (three patterns, OR-ed)."""
    return [
        whole_word_pattern(words, engine),
        proximity_pattern(adjectives, nouns, engine),
        proximity_pattern(nouns, adjectives, engine),
    ]


def matches_any(col, patterns) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for p in patterns:
        m = c.rlike(p)
        out = m if out is None else (out | m)
    return F.coalesce(out, F.lit(False))


def split_keywords(keywords) -> tuple[list[str], list[str]]:
    """Single-word keywords (matched on tokens) vs multi-word phrases (regex)."""
    single = [k.lower() for k in keywords if re.fullmatch(r"[^\s]+", k)]
    phrases = [k.lower() for k in keywords if not re.fullmatch(r"[^\s]+", k)]
    return single, phrases


def vocabulary(*lists) -> list[str]:
    """The distinct plain words of several word and phrase lists: what a text has to be looked up for."""
    return sorted({w for words in lists for entry in words for w in entry.lower().split() if _plain(w)})


def present(text_col, words: list[str]) -> Column:
    """Which of ``words`` a text has as tokens.  Taken once as a column of its own, it is all that
    the screens below need of the text's tokens (their ``toks``), however many lists there are."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    toks = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), 0)
    return F.array_intersect(toks, F.array(*[F.lit(w) for w in words]))


def distinct_hits(text_col, keywords_col: Column | None = None, keywords=None, toks: Column | None = None) -> Column:
    """Number of distinct keywords present as whole words (case-insensitive).

    ``keywords_col`` is an ``array<string>`` column of single lower-case words
    (e.g. from a joined per-language config table); ``keywords`` a Python list
    whose multi-word entries are matched with one regex each.
    """
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    toks = _tokens(text, min_len=1) if toks is None else toks
    total = F.lit(0)
    single, phrases = split_keywords(keywords or [])
    if keywords_col is not None:
        total = total + F.size(F.array_intersect(toks, keywords_col))
    if single:
        total = total + F.size(F.array_intersect(toks, F.array(*[F.lit(k) for k in single])))
    for p in phrases:
        # the phrase regex can only match when each of its words is a token
        present = None
        for w in p.split():
            c = F.array_contains(toks, w)
            present = c if present is None else (present & c)
        pat = whole_word_pattern([re.escape(p).replace("\\ ", " ")])
        total = total + F.when(present & text.rlike(pat), 1).otherwise(0)
    return total


def highlight(text_col, keywords, open_mark: str = "**", close_mark: str = "**") -> Column:
    """Wrap every whole-word keyword or phrase occurrence (case-insensitive) in markers.

    One replacement over the screen's own boundary rule, by lookaround, so adjacent
    matches never compete for a boundary character; longer entries go first."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    words = "|".join(re.escape(k).replace("\\ ", " ") for k in sorted(keywords, key=len, reverse=True))
    pattern = f"(?iu)(?<![{WORD}])(?:{words})(?![{WORD}])"
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{open_mark}$0{close_mark}"))


def _plain(word: str) -> bool:
    return re.fullmatch(r"[^\W]+", word) is not None


def lexicon_match(text_col, words, adjectives, nouns, toks: Column | None = None) -> tuple[Column, Column]:
    """F8 as (word_hit, proximity_hit), same results as the three regexes of
    :func:`lexicon_pattern` but cheaper on long texts:

    * plain words are looked up in the row's token set (one hash probe per token
      instead of one alternation per character);
    * a proximity rule can only match when both an adjective and a noun occur as
      tokens, so its ``.*`` regex runs only on those rows.
    """
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    toks = _tokens(text, min_len=1) if toks is None else toks
    plain = [w.lower() for w in words if _plain(w)]
    other = [w for w in words if not _plain(w)]
    hit = F.arrays_overlap(toks, F.array(*[F.lit(w) for w in plain])) if plain else F.lit(False)
    if other:
        hit = hit | F.coalesce(text.rlike(whole_word_pattern(other)), F.lit(False))
    both = (F.arrays_overlap(toks, F.array(*[F.lit(a.lower()) for a in adjectives]))
            & F.arrays_overlap(toks, F.array(*[F.lit(n.lower()) for n in nouns])))
    prox = F.when(both, F.coalesce(text.rlike(proximity_pattern(adjectives, nouns))
                                   | text.rlike(proximity_pattern(nouns, adjectives)), F.lit(False))
                  ).otherwise(F.lit(False))
    return F.coalesce(hit, F.lit(False)), prox


def phrase_match(text_col, phrases, toks: Column | None = None) -> Column:
    """Any phrase as whole words (case-insensitive); the regex runs only on rows
    whose token set holds every word of at least one phrase."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    toks = _tokens(text, min_len=1) if toks is None else toks
    parts = [p.lower().split() for p in phrases]
    possible = None
    for ws in parts:
        cond = None
        for w in ws:
            c = F.array_contains(toks, w)
            cond = c if cond is None else (cond & c)
        possible = cond if possible is None else (possible | cond)
    return F.when(F.coalesce(possible, F.lit(False)),
                  F.coalesce(text.rlike(whole_word_pattern(phrases)), F.lit(False))).otherwise(F.lit(False))
