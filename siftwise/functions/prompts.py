"""Prompt construction, truncation and chat rendering.

Messages are ``ARRAY<STRUCT<role STRING, content STRING>>``.  The few-shot
block is the same for every item, so it is computed once (a scalar subquery)
and concatenated per row; no join and no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_MAX_TOKENS, TRUNCATION_BUDGETS
from .text import UNICODE_WS

ASCII_WS = "[\\t\\n\\x0B\\f\\r ]"

# Default chat layout; a model-specific template is a parameter of render_chat.
CHAT_TEMPLATE = ("<|{role}|>\n", "\n", "<|assistant|>\n")


def message(role, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def few_shot_block(examples: DataFrame, n: int = 5, id_col: str = "item_id",
                   text_col: str = "text") -> Column:
    """The first ``n`` examples as alternating user/assistant messages (scalar).

    The assistant answer is a valid contract response whose label alternates.
    """
    picked = examples.select(id_col, text_col).orderBy(id_col).limit(n)
    pairs = picked.select(F.sort_array(F.collect_list(F.struct(
        F.col(id_col).alias("k"),
        F.col(text_col).alias("user"),
        F.concat(F.lit('{"reasoning": "example '), F.col(id_col).cast("string"),
                 F.lit('", "label": '), (F.col(id_col) % 2).cast("string"), F.lit("}")).alias("answer"),
    ))).alias("p"))
    flat = pairs.select(F.flatten(F.transform("p", lambda x: F.array(
        message("user", x["user"]), message("assistant", x["answer"])))).alias("m"))
    return flat.scalar()


def build_messages(system_col, shots: Column, text_col) -> Column:
    """X11: system message + few-shot turns + the target text as last user turn."""
    sys_c = F.col(system_col) if isinstance(system_col, str) else system_col
    # a language without a prompt is an error, not a row that goes missing
    sys_c = F.coalesce(sys_c, F.raise_error(F.lit("no system prompt for the item's language")))
    txt = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.concat(F.array(message("system", sys_c)), shots, F.array(message("user", txt)))


def render_chat(messages, template=CHAT_TEMPLATE) -> Column:
    """Messages -> one prompt string, generation prompt appended."""
    head, tail, gen = template
    pre, post = head.split("{role}")
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.concat(
        F.array_join(F.transform(m, lambda x: F.concat(F.lit(pre), x["role"], F.lit(post),
                                                       x["content"], F.lit(tail))), ""),
        F.lit(gen))


def word_prefix(text_col, max_words) -> Column:
    """The text from its first word up to and including its ``max_words``-th
    whitespace word (and the whitespace after it).

    Offsets are measured on a copy whose non-ASCII whitespace is folded to a
    space by ``translate`` (one code point for one, so positions line up) and cut
    from the original text: the short ASCII class keeps the regex fast.
    """
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    folded = F.translate(t, UNICODE_WS, " " * len(UNICODE_WS))
    lead = F.length(F.regexp_extract(folded, f"^{ASCII_WS}*", 0))
    runs = F.regexp_extract_all(folded, F.lit(f"[^{ASCII_WS[1:-1]}]+{ASCII_WS}*"), 0)
    kept = F.length(F.array_join(F.slice(runs, 1, max_words), ""))
    return F.substring(t, lead + 1, kept)


def budget_structs() -> Column:
    """The intended per-model budget table (character budgets for the three
    named models, a word budget for every other model)."""
    rows = [F.struct(F.lit(m).alias("model"), F.lit(c).cast("int").alias("max_chars"),
                     F.lit(t).cast("int").alias("max_tokens")) for m, c, t in TRUNCATION_BUDGETS]
    rows.append(F.struct(F.lit("default").alias("model"), F.lit(None).cast("int").alias("max_chars"),
                         F.lit(DEFAULT_MAX_TOKENS).alias("max_tokens")))
    return F.array(*rows)


def truncate_for_model(text_col, max_chars: Column, max_tokens: Column) -> Column:
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.when(max_chars.isNotNull(), F.substring(t, F.lit(1), max_chars)) \
        .otherwise(word_prefix(t, max_tokens))
