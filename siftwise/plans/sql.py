"""Building blocks for the DuckDB oracle SQL (one statement per registered query).

The snippets mirror the Spark expressions in ``siftwise.functions``; character
classes come from the same constants so both sides use one definition.
"""

from __future__ import annotations

from ..functions.text import NON_WS_CLASS, WS_CLASS, TOKEN_PATTERN

FIXTURE_RANKS = [3, 4, 5, 6]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q(f'^{WS_CLASS}+|{WS_CLASS}+$')}, '', 'g')"


def word_count(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(NON_WS_CLASS + '+')}))"


def tokens(expr: str, pattern: str = TOKEN_PATTERN) -> str:
    return f"regexp_extract_all(lower({expr}), {q(pattern)})"


def r6(expr: str) -> str:
    return f"(round(({expr}) * 1000000.0) / 1000000.0)"


def rfix(expr: str, digits: int) -> str:
    s = float(10 ** digits)
    return f"(round(({expr}) * {s}) / {s})"


def rhe(expr: str, digits: int = 3) -> str:
    s = float(10 ** digits)
    return f"(round_even(({expr}) * {s}, 0) / {s})"


def safe_div(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / ({den}) END)"


def f1(p: str, r: str) -> str:
    return f"(CASE WHEN ({p}) + ({r}) = 0 THEN 0.0 ELSE 2 * (({p}) * ({r})) / (({p}) + ({r})) END)"


def label_value(expr: str) -> str:
    return f"TRY_CAST({strip(f'CAST({expr} AS VARCHAR)')} AS DOUBLE)"


def canonical(expr: str) -> str:
    v = label_value(expr)
    return f"(CASE WHEN {v} = 1 THEN 1 WHEN {v} = 0 THEN 0 END)"


def numeric(expr: str) -> str:
    v = label_value(expr)
    return f"coalesce(TRY_CAST(trunc({v}) AS INTEGER), -1)"


def flip(k: int) -> str:
    return f"CAST(CASE WHEN doc_id % {k} = 0 THEN 1 - q ELSE q END AS VARCHAR)"


VOTES_CTE = f"""
fixture_base AS (
  SELECT d.doc_id, d.text, d.n_chars, coalesce(l.quality, CAST(d.doc_id % 2 AS INTEGER)) AS q
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
),
votes AS (
  SELECT doc_id AS id, 'a/flip7' AS model, 1 AS model_rank, {flip(7)} AS label, text, 1 AS seq FROM fixture_base
  UNION ALL SELECT doc_id, 'a/flip7', 1, CAST(1 - CAST({flip(7)} AS INTEGER) AS VARCHAR), text, 2 FROM fixture_base WHERE doc_id % 13 = 0
  UNION ALL SELECT doc_id, 'a/flip5', 2, {flip(5)}, substr(text, 1, 2040), 1 FROM fixture_base
  UNION ALL SELECT doc_id, 'b/long', 3, CASE WHEN n_chars >= 1500 THEN ' 1' ELSE ' 0' END, text, 1 FROM fixture_base
  UNION ALL SELECT doc_id, 'b/words', 4, CASE WHEN {word_count('text')} >= 100 THEN '1' ELSE '0' END, text, 1 FROM fixture_base WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 'c/flip3', 5, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {flip(3)} END, text, 1 FROM fixture_base
  UNION ALL SELECT doc_id, 'd/flip7', 6, {flip(7)}, text, 1 FROM fixture_base
),
first_votes AS (
  SELECT id, model, min(model_rank) AS model_rank, arg_min({strip('label')}, seq) AS label
  FROM votes WHERE label IS NOT NULL GROUP BY id, model
),
fv AS (
  SELECT *, {canonical('label')} AS vote, {numeric('label')} AS pred FROM first_votes
),
ballots AS (   -- every (id, model) with a row, its vote NULL where no label is given
  SELECT b.id, b.model, b.model_rank, fv.vote
  FROM (SELECT id, model, min(model_rank) AS model_rank FROM votes GROUP BY id, model) b
  LEFT JOIN fv ON b.id = fv.id AND b.model = fv.model
)"""

GOLD_EVAL_CTE = """
gold AS (SELECT doc_id AS id, quality AS gold FROM labels),
preds AS (SELECT fv.id, fv.model, fv.pred, gold.gold FROM fv JOIN gold ON fv.id = gold.id),
eval_ids AS (SELECT * FROM gold WHERE id IN (SELECT id FROM votes)),
totals AS (SELECT count(*) AS n, count(*) FILTER (WHERE gold = 0) AS t0,
                  count(*) FILTER (WHERE gold = 1) AS t1 FROM eval_ids),
cm AS (
  SELECT model,
    count(*) FILTER (WHERE gold = 0 AND pred = 0) AS tn,
    count(*) FILTER (WHERE gold = 0 AND pred = 1) AS fp,
    count(*) FILTER (WHERE gold = 1 AND pred = 0) AS fn,
    count(*) FILTER (WHERE gold = 1 AND pred = 1) AS tp
  FROM preds GROUP BY model
),
cmt AS (SELECT cm.*, totals.n, totals.t0, totals.t1 FROM cm, totals),
scored AS (
  SELECT *,
    {acc} AS accuracy, {p} AS precision_1, {r} AS recall_1, {f} AS f1_1,
    CASE WHEN {pe} = 1.0 THEN NULL ELSE ({acc} - {pe}) / (1 - {pe}) END AS kappa
  FROM cmt
)""".format(
    acc=safe_div("tp + tn", "n"), p=safe_div("tp", "tp + fp"), r=safe_div("tp", "tp + fn"),
    f=f1(safe_div("tp", "tp + fp"), safe_div("tp", "tp + fn")),
    pe="(CASE WHEN n = 0 THEN NULL ELSE CAST(t0 * (tn + fn) + t1 * (fp + tp) AS DOUBLE) / (n * n) END)",
)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
