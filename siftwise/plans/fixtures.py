"""Deterministic annotators derived from the supplied tables.

The test corpus has no model verdicts, so five rule annotators (plus a sixth
copy) vote on every document.  Each carries one irregularity that the vote
operators must handle (duplicate vote, truncated text, padded label, missing
vote, null label).  The rules are plain column expressions, so the same votes
are produced by Spark and by the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count_at_least
from ..sources.tables import table


def _flip(doc_id, q, k):
    return F.when(doc_id % k == 0, 1 - q).otherwise(q).cast("string")


def rule_votes(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Long votes table ``(id, model, model_rank, label STRING, text, seq)``.

    ``with_text=False`` leaves the text out of the exploded ballots (NULL), so
    vote-only queries do not copy every document seven times.
    """
    d = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    gold = table(spark, sf_dir, "labels", "doc_id", "quality")
    base = d.join(gold, "doc_id", "left")
    doc = F.col("doc_id")
    q = F.coalesce(F.col("quality"), (doc % 2).cast("int"))
    text = F.col("text") if with_text else F.lit(None).cast("string")
    flip7 = _flip(doc, q, 7)

    def vote(model, rank, label, txt, seq, keep):
        return F.struct(F.lit(model).alias("model"), F.lit(rank).alias("model_rank"),
                        label.alias("label"), txt.alias("text"), F.lit(seq).alias("seq"),
                        keep.alias("keep"))

    ballots = F.array(
        vote("a/flip7", 1, flip7, text, 1, F.lit(True)),
        vote("a/flip7", 1, (1 - flip7.cast("int")).cast("string"), text, 2, doc % 13 == 0),
        vote("a/flip5", 2, _flip(doc, q, 5), F.substring(text, 1, 2040), 1, F.lit(True)),
        vote("b/long", 3, F.when(F.col("n_chars") >= 1500, F.lit(" 1")).otherwise(F.lit(" 0")),
             text, 1, F.lit(True)),
        vote("b/words", 4, F.when(word_count_at_least(F.col("text"), 100), F.lit("1")).otherwise(F.lit("0")),
             text, 1, doc % 11 != 0),
        vote("c/flip3", 5, F.when(doc % 17 == 0, F.lit(None).cast("string")).otherwise(_flip(doc, q, 3)),
             text, 1, F.lit(True)),
        vote("d/flip7", 6, flip7, text, 1, F.lit(True)),
    )
    return (base.select(doc.alias("id"), F.explode(ballots).alias("v"))
            .where(F.col("v.keep"))
            .select("id", "v.model", "v.model_rank", "v.label", "v.text", "v.seq"))


# Raw model responses, one literal case per document, cycled by doc_id.
RESPONSE_CASES = [
    '{"reasoning":"x","label":1}',
    '{"reasoning":"x","label":0}',
    ' {"reasoning":"x","label":1} ',
    '{"reasoning":"x"}',
    '{"label":1}',
    '{"reasoning":"trunc',
    'not json',
    '{"reasoning":"x","label":"1"}',
    '{"reasoning":"x","label":2}',
    '{"reasoning":"x","label":1} trailing text',
    '{"reasoning":"x","label":1}{"reasoning":"y","label":0}',
    "{'reasoning':'x','label':1}",
    '{"reasoning":"x","label":1,"confidence":0.9}',
    '{"reasoning":"one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen","label":0}',
    '{"reasoning":"x","label":null}',
    '{"reasoning":"x","label":[1]}',
]


# Sentences with words of the fixed topic lists (and near misses), one per document in turn:
# the invented prose holds none of them.
TOPIC_SNIPPETS = [
    "", "Pea soup, licorice and KALE.", "nederlandse keuken", "de Hollandse en andere keuken", "eten-drop; lekker!",
    "dutch people like food", "foods and kaleidoscopes", "Vaderlansd eten", "chocolate sprinkles on a dish", "keuken, nederlands",
    "pea  soup stamppot", "hollandse\nkeuken",
]


# Damaged text and what it was, one per document in turn: UTF-8 read as cp1252 or Latin-1, once or
# twice, between clean accents and other scripts; entities; text that only looks damaged.
DAMAGED = [
    ("", ""),
    ("caf\u00c3\u00a9 \u00c3\u00a0 la cr\u00c3\u00a8me", "caf\u00e9 \u00e0 la cr\u00e8me"),
    ("d\u00e9j\u00e0 vu, caf\u00c3\u00a9", "d\u00e9j\u00e0 vu, caf\u00e9"),
    ("\u65e5\u672c caf\u00c3\u00a9 \u65e5", "\u65e5\u672c caf\u00e9 \u65e5"),
    ("it\u00e2\u20ac\u2122s \u00e2\u20ac\u0153so\u00e2\u20ac\u009d", "it\u2019s \u201cso\u201d"),
    ("\u00c3\u0192\u00c2\u00a9t\u00c3\u0192\u00c2\u00a9 et caf\u00c3\u00a9", "\u00e9t\u00e9 et caf\u00e9"),
    ("\u00abCAF\u00c9\u00bb \u00c7A", "\u00abCAF\u00c9\u00bb \u00c7A"),
    ("\u00d0\u00bf\u00d1\u20ac\u00d0\u00b8\u00d0\u00b2\u00d0\u00b5\u00d1\u201a!", "\u043f\u0440\u0438\u0432\u0435\u0442!"),
    ("10\u00e2\u201a\u00ac &amp; \u00c2\u00a9 &eacute;", "10\u20ac & \u00a9 \u00e9"),
    ("na\u00efve fa\u00e7ade \u00c0 \u00c3 \u00c2", "na\u00efve fa\u00e7ade \u00c0 \u00c3 \u00c2"),
    ("\u00f0\u0178\u02dc\u20ac ok", "\U0001f600 ok"),
]


def topic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: every document with one of the snippets after it."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    snippet = F.element_at(F.array(*[F.lit(s) for s in TOPIC_SNIPPETS]), (F.col("doc_id") % len(TOPIC_SNIPPETS) + 1).cast("int"))
    return d.select("doc_id", F.concat("text", F.lit(" "), snippet).alias("text"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, model, raw_response, text)``: a scorer's raw output per document."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    cases = F.array(*[F.lit(c) for c in RESPONSE_CASES])
    return d.select(
        F.col("doc_id").alias("id"),
        F.lit("stub/scorer").alias("model"),
        F.element_at(cases, (F.col("doc_id") % len(RESPONSE_CASES) + 1).cast("int")).alias("raw_response"),
        "text",
    )
