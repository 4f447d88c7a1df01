"""Quality rules: a threshold table compiled into one projection, DataFrame functions only.

``RULES`` is the table: (name, measure, bound, value, smallest number of words or
lines).  ``compile_rules`` turns it into one Boolean expression over the measures,
which are built-in functions of the whole text; there is no shuffle and no state,
so each split is judged on its own and a hot key cannot matter.

The stop words are those of seven western European languages, and the bounds on word length
are for scripts that put spaces between words: texts in other languages break ``stop_words`` as a
rule, unspaced ones ``long_words`` too.  A corpus of such languages needs a table of its own
(``rules``), or goes without those two rules.

Repeated three-word windows are found by sorting a document's windows next to their
positions: equal neighbours are repeats, and the words under them are counted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, read, words
from .registry import query

# Frequent function words of the languages the rules know.
STOP_WORDS = (
    "the of and to in is that for it on with as by at be this are from an was "
    "der die das und zu den von mit ist im nicht ein eine des auf für dem "
    "le la les et des du un une que est pour dans en qui pas sur au "
    "el los las y de por con una para del se lo como no su al "
    "il che di per non sono gli o os da não em uma van het een dat niet"
).split()

SYMBOLS = "[#*$%&|<>]"       # fixed value of the contract
MIN_WORDS, MAX_REPEAT_PCT = 50, 50   # fixed values of the contract's base rule

# (name, measure, bound, value): a document is rejected when the measure is beyond the bound.
RULES = [
    ("long_words", "mean_word", "max", 15.0),
    ("short_words", "mean_word", "min", 2.0),
    ("symbols", "symbol_ratio", "max", 0.15),
    ("letters", "letter_word_ratio", "min", 0.5),
    ("stop_words", "stop_ratio", "min", 0.005),
    ("repeated_lines", "dup_line_ratio", "max", 0.5),
    ("bullet_lines", "bullet_line_ratio", "max", 0.9),
    ("ellipsis_lines", "ellipsis_line_ratio", "max", 0.3),
]


def _repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found at least twice in ``w``."""
    n = F.size(w)
    windows = F.sort_array(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(
        F.get(w, i - 1).alias("a"), F.get(w, i).alias("b"), F.get(w, i + 1).alias("c"), i.alias("at"))))

    def covered(s: Column) -> Column:
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        follows = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.coalesce(same(x, y), F.lit(False)))  # equal to the next
        starts = let(follows, lambda f: F.filter(F.transform(s, lambda x, i: F.when(
            F.get(f, i) | F.coalesce(F.get(f, i - 1), F.lit(False)), x["at"])), lambda p: p.isNotNull()))
        # sorted starts: each covers three words, less what the next one covers too
        return let(F.sort_array(starts), lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.size(s)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))),
            F.lit(0), lambda acc, x: acc + x))

    return F.when(n < 4, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def measures(text: Column, w: Column, lines: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """(counts of the text, ratios of those counts) by name; ``w``: the words, ``lines``: lines with a word."""
    n = F.size(w)
    n_lines = F.size(lines)
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    chars = F.length(F.array_join(w, ""))
    symbols = F.regexp_count(text, F.lit(SYMBOLS))
    return {
        "n_words": n.cast("long"),
        "word_chars": chars.cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(w),
        "n_lines": n_lines.cast("long"),
        "stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
        "letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long"),
        "bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•‣●]"))).cast("long"),
        "ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).cast("long"),
    }, {
        "mean_word": share(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": share(F.col("n_symbols"), F.col("word_chars")),
        "letter_word_ratio": share(F.col("letter_words"), F.col("n_words")),
        "stop_ratio": share(F.col("stop_words"), F.col("n_words")),
        "dup_line_ratio": share(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_ratio": share(F.col("bullet_lines"), F.col("n_lines")),
        "ellipsis_line_ratio": share(F.col("ellipsis_lines"), F.col("n_lines")),
    }


def compile_rules(rules, ratios: dict[str, Column]) -> Column:
    """The table as one expression: the names of the rules that a document breaks."""
    broken = [F.when(ratios[m] > v if bound == "max" else ratios[m] < v, F.lit(name)) for name, m, bound, v in rules]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def quality(docs: DataFrame, text: str = "text", rules=RULES, keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) with the measures, ``base_failed``, ``broken`` (names of
    the broken rules) and ``kept``.  Null and empty texts have no words and fail the base
    rule; rows are judged one by one, so repeats and ties get equal verdicts."""
    keep = keep or [F.col("doc_id")]
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*keep, t.alias("_qt"), words(F.col(text)).alias("_qw"),
                    F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_ql"))
    counts, ratios = measures(F.col("_qt"), F.col("_qw"), F.col("_ql"))
    kept_names = [c for c in d.columns if c not in ("_qt", "_qw", "_ql")]
    d = d.select(*kept_names, *[c.alias(k) for k, c in counts.items()])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    d = d.withColumn("base_failed", base).withColumn("broken", compile_rules(rules, ratios))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = quality(docs, text, rules, keep=[row])
    # row numbers are never negative; as they are not deterministic for the optimizer, the
    # filter stays above the projection, else the measures would be inlined into each other
    return judged.select("_row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("_kept")).where("_kept").select("_row.*")


def _sql() -> str:
    """The whole query in SQL, rules included."""
    quoted = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    space = r"[ \t\n\x0B\f\r]"
    ratio = {
        "mean_word": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "word_chars"),
        "letter_word_ratio": ("letter_words", "n_words"), "stop_ratio": ("stop_words", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"), "bullet_line_ratio": ("bullet_lines", "n_lines"),
        "ellipsis_line_ratio": ("ellipsis_lines", "n_lines"),
    }
    value = {k: f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0.0::DOUBLE END)" for k, (a, b) in ratio.items()}
    broken = ", ".join(f"CASE WHEN {value[m]} {'>' if bound == 'max' else '<'} {v}::DOUBLE THEN '{name}' END" for name, m, bound, v in RULES)
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM t),
tri AS (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({quoted})))::BIGINT AS stop_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) AS letter_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t]*[-*•‣●]'))) AS bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS ellipsis_lines
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
j AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
         array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ',') AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND broken = '' AS kept, n_lines, stop_words, broken
FROM j"""


@query("op1_quality", _sql())
def op1_quality(spark, sf_dir):
    """Every document's measures and verdict."""
    return quality(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "stop_words", F.array_join("broken", ",").alias("broken"))
