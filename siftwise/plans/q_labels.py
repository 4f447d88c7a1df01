"""Queries over responses, prompts, label maps and training-set construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT_MAX_TOKENS, RESPONSE_MAX_REASONING_WORDS, RESPONSE_PARSE_ERROR, TRUNCATION_BUDGETS
from ..functions import prompts as P
from ..functions import text as X
from ..functions.responses import contract_violations, parse_response
from ..operators import labels as L
from ..operators import votes as V
from ..sources.config_tables import lang_config
from ..sources.tables import items, table
from . import sql as S
from ..operators.classify import score_with
from ..functions.scorers import length_parity_scorer
from .fixtures import RESPONSE_CASES, raw_responses
from .q_text import ITEMS_CTE, LANG_CTE
from .q_votes import fixture_first_votes
from .registry import query

# ----------------------------------------------------------------- X13 X15 X16
_CASES_SQL = "[" + ", ".join(S.q(c) for c in RESPONSE_CASES) + "]"
RESPONSES_CTE = f"""responses AS (
  SELECT doc_id AS id, 'stub/scorer' AS model, {S.strip(f'{_CASES_SQL}[CAST(doc_id % {len(RESPONSE_CASES)} AS INTEGER) + 1]')} AS raw
  FROM documents),
parsed AS (
  SELECT id, model, raw, coalesce(try(json_type(raw)) = 'OBJECT', false) AS valid_json,
         CASE WHEN coalesce(try(json_type(raw)) = 'OBJECT', false) THEN try(json_keys(raw)) END AS keys
  FROM responses),
parsed2 AS (
  SELECT *, valid_json AND list_contains(keys, 'label') AS has_label,
         valid_json AND list_contains(keys, 'reasoning') AS has_reasoning,
         CASE WHEN valid_json THEN try(json_type(raw, '$.label')) END AS vtype
  FROM parsed),
parsed3 AS (
  SELECT id, model, valid_json, keys,
    CASE WHEN NOT valid_json OR NOT has_label THEN '0' ELSE try(json_extract_string(raw, '$.label')) END AS label,
    CASE WHEN NOT valid_json THEN {S.q(RESPONSE_PARSE_ERROR)} WHEN NOT has_reasoning THEN ''
         ELSE try(json_extract_string(raw, '$.reasoning')) END AS reasoning,
    CASE WHEN NOT valid_json THEN 'invalid' WHEN NOT has_label THEN 'missing'
         WHEN vtype IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN vtype = 'VARCHAR' THEN 'string'
         WHEN vtype = 'NULL' THEN 'null' ELSE 'other' END AS label_kind
  FROM parsed2)"""


def parsed_responses(spark, sf_dir):
    r = raw_responses(spark, sf_dir)
    return r.select("id", "model", parse_response("raw_response").alias("p"))


@query("response_parse", S.with_ctes(RESPONSES_CTE) + f"""
SELECT id, model, valid_json, label, reasoning, label_kind, {S.numeric('label')} AS label_int,
       {S.canonical('label')} AS label_01
FROM parsed3""")
def response_parse(spark, sf_dir):
    """Raw responses -> (label, reasoning) with the fallback rules."""
    p = parsed_responses(spark, sf_dir)
    return p.select("id", "model", "p.valid_json", "p.label", "p.reasoning", "p.label_kind",
                    V.numeric_label("p.label").alias("label_int"),
                    V.canonical_label("p.label").alias("label_01"))


_VIOL_SQL = {
    "invalid_json": "NOT valid_json",
    "missing_label": "valid_json AND NOT list_contains(keys, 'label')",
    "missing_reasoning": "valid_json AND NOT list_contains(keys, 'reasoning')",
    "extra_keys": "valid_json AND len(list_filter(keys, lambda k: k NOT IN ('reasoning', 'label'))) > 0",
    "label_not_integer": "label_kind IN ('string', 'null', 'other')",
    "label_not_in_enum": "label_kind = 'integer' AND label NOT IN ('0', '1')",
    "reasoning_too_long": f"coalesce({S.word_count('reasoning')}, 0) > {RESPONSE_MAX_REASONING_WORDS}",
}


@query("response_quality", S.with_ctes(RESPONSES_CTE) + "SELECT model, count(*) AS n_responses, "
       + ", ".join(f"count(*) FILTER (WHERE {c}) AS n_{k}" for k, c in _VIOL_SQL.items())
       + ", count(*) FILTER (WHERE NOT (" + " OR ".join(f"coalesce({c}, false)" for c in _VIOL_SQL.values())
       + ")) AS n_valid FROM parsed3 GROUP BY model")
def response_quality(spark, sf_dir):
    """Contract violations per model (one partial aggregation)."""
    p = parsed_responses(spark, sf_dir).select("model", contract_violations(F.col("p")).alias("v"))
    aggs = [F.count("*").alias("n_responses")]
    aggs += [F.sum(F.when(F.array_contains("v", k), 1).otherwise(0)).alias(f"n_{k}") for k in _VIOL_SQL]
    aggs.append(F.sum(F.when(F.size("v") == 0, 1).otherwise(0)).alias("n_valid"))
    return p.groupBy("model").agg(*aggs)


# ----------------------------------------------------------------- X11 X12 D5
_FEWSHOT_SQL = """(SELECT flatten(list([{'role': 'user', 'content': text},
       {'role': 'assistant', 'content': '{"reasoning": "example ' || CAST(item_id AS VARCHAR)
                                        || '", "label": ' || CAST(item_id % 2 AS VARCHAR) || '}'}]
       ORDER BY item_id))
  FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 5))"""
_PRE, _POST = P.CHAT_TEMPLATE[0].split("{role}")


def _render_sql(msgs: str) -> str:
    return (f"array_to_string(list_transform({msgs}, lambda x: {S.q(_PRE)} || x.role || {S.q(_POST)} "
            f"|| x.content || {S.q(P.CHAT_TEMPLATE[1])}), '') || {S.q(P.CHAT_TEMPLATE[2])}")


@query("prompt_messages", S.with_ctes(ITEMS_CTE, LANG_CTE, f"""msgs AS (
  SELECT i.id, list_concat([{{'role': 'system', 'content': l.system_prompt}}], {_FEWSHOT_SQL},
                           [{{'role': 'user', 'content': i.text}}]) AS m
  FROM items i JOIN lang_config l ON i.lang = l.lang)""") + f"""
SELECT id, len(m) AS n_messages, m[1].role AS first_role, m[len(m)].role AS last_role,
       length({_render_sql('m')}) AS prompt_chars, md5({_render_sql('m')}) AS prompt_md5
FROM msgs""")
def prompt_messages(spark, sf_dir):
    """Per document the full message list and its rendered chat prompt."""
    it = items(spark, sf_dir)
    shots = P.few_shot_block(table(spark, sf_dir, "benchmark", "item_id", "text"))
    cfg = lang_config(spark)
    m = P.build_messages("system_prompt", shots, "text")
    rendered = P.render_chat(F.col("m"))
    return (it.join(cfg, "lang", "left").select("id", m.alias("m"))
            .select("id", F.size("m").cast("long").alias("n_messages"),
                    F.col("m")[0]["role"].alias("first_role"),
                    F.element_at("m", -1)["role"].alias("last_role"),
                    F.length(rendered).cast("long").alias("prompt_chars"),
                    F.md5(rendered).alias("prompt_md5")))


@query("scored_responses", S.with_ctes(ITEMS_CTE, LANG_CTE, f"""msgs AS (
  SELECT i.id, list_concat([{{'role': 'system', 'content': l.system_prompt}}], {_FEWSHOT_SQL},
                           [{{'role': 'user', 'content': i.text}}]) AS m
  FROM items i JOIN lang_config l ON i.lang = l.lang)""") + f"""
SELECT id, length({_render_sql('m')}) AS prompt_chars, CAST(length({_render_sql('m')}) % 2 AS INTEGER) AS label_01,
       'stub' AS reasoning
FROM msgs""")
def scored_responses(spark, sf_dir):
    """L13 -> X13: rendered prompts scored in Arrow batches by a pluggable batch
    scorer (here a deterministic stub), then parsed like any model response."""
    it = items(spark, sf_dir)
    shots = P.few_shot_block(table(spark, sf_dir, "benchmark", "item_id", "text"))
    prompts = (it.join(lang_config(spark), "lang", "left")
               .select("id", P.build_messages("system_prompt", shots, "text").alias("m"))
               .select("id", P.render_chat("m").alias("prompt")))
    scored = score_with(length_parity_scorer, prompts, "prompt")
    p = scored.select("id", F.length("prompt").cast("long").alias("prompt_chars"),
                      parse_response("raw_response").alias("r"))
    return p.select("id", "prompt_chars", V.canonical_label("r.label").alias("label_01"),
                    F.col("r.reasoning").alias("reasoning"))


_BUDGET_VALUES = ", ".join(
    f"({S.q(m)}, {c if c is not None else 'NULL'}, {t if t is not None else 'NULL'})"
    for m, c, t in TRUNCATION_BUDGETS) + f", ('default', NULL, {DEFAULT_MAX_TOKENS})"
_RUNS_SQL = S.q(f"{X.NON_WS_CLASS}+{X.WS_CLASS}*")


@query("prompt_truncate", S.with_ctes(f"""budgets AS (
  SELECT * FROM (VALUES {_BUDGET_VALUES}) t(model, max_chars, max_tokens))""") + f"""
SELECT d.doc_id AS id, b.model,
  length(CASE WHEN b.max_chars IS NOT NULL THEN substr(d.text, 1, b.max_chars)
         ELSE array_to_string(regexp_extract_all(d.text, {_RUNS_SQL})[1:b.max_tokens], '') END) AS kept_chars,
  length(d.text) AS full_chars
FROM documents d, budgets b""")
def prompt_truncate(spark, sf_dir):
    """The text each model would see under its budget (intended budgets;
    the full untruncated text stays the item's text)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    per_model = d.select("doc_id", "text", F.explode(P.budget_structs()).alias("b"))
    kept = P.truncate_for_model("text", F.col("b.max_chars"), F.col("b.max_tokens"))
    return per_model.select(F.col("doc_id").alias("id"), F.col("b.model").alias("model"),
                            F.length(kept).cast("long").alias("kept_chars"),
                            F.length("text").cast("long").alias("full_chars"))


# ----------------------------------------------------------------- S6 Q6
@query("label_map_scan", """
SELECT CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN doc_id % 23 = 0 THEN 2 ELSE quality END AS label,
  (CASE WHEN doc_id % 23 = 0 THEN 2 ELSE quality END) IN (0, 1) AS valid
FROM labels""")
def label_map_scan(spark, sf_dir):
    """Label maps ``{id: label}`` as JSON text, parsed and exploded; labels
    other than 0/1 are flagged (every 23rd entry carries a 2)."""
    maps = L.label_maps_from_labels(table(spark, sf_dir, "labels", "doc_id", "quality"))
    return L.parse_label_maps(maps, "json").select("id", "label", L.is_valid_label("label").alias("valid"))


# ----------------------------------------------------------------- K7
@query("annotation_upsert", """
WITH rounds AS (
  SELECT doc_id AS id, quality AS label, 1 AS round, 1 AS seq FROM labels
  UNION ALL SELECT doc_id, 1 - quality, 2, 1 FROM labels WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, quality, 2, 2 FROM labels WHERE doc_id % 6 = 0)
SELECT id, arg_max(label, round * 1000000 + seq) AS label, max(round) AS last_round,
       count(*) AS n_versions
FROM rounds GROUP BY id""")
def annotation_upsert(spark, sf_dir):
    """K7: labelling rounds merged; the last label per id wins (round, then order)."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    r1 = lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"),
                    F.lit(1).alias("round"), F.lit(1).alias("seq"))
    r2 = lab.where(F.col("doc_id") % 3 == 0).select(
        F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("label"), F.lit(2).alias("round"),
        F.lit(1).alias("seq"))
    r2b = lab.where(F.col("doc_id") % 6 == 0).select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.lit(2).alias("round"),
        F.lit(2).alias("seq"))
    return L.upsert_labels(r1.unionByName(r2).unionByName(r2b))


# ----------------------------------------------------------------- J6 J8 Q6
@query("resume_report", S.with_ctes(ITEMS_CTE, """ann AS (
  SELECT doc_id AS id, quality AS label FROM labels
  UNION ALL SELECT doc_id + 1000000000, quality FROM labels WHERE doc_id % 10 = 0)""") + """
SELECT CASE WHEN a.id IN (SELECT id FROM items) THEN 'matched' ELSE 'unknown' END AS status,
       a.label, count(*) AS n
FROM ann a GROUP BY ALL""")
def resume_report(spark, sf_dir):
    """Saved labels matched to the pool by id; unknown ids reported, not used."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    ann = (lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
           .unionByName(lab.where(F.col("doc_id") % 10 == 0)
                        .select((F.col("doc_id") + 1000000000).alias("id"), F.col("quality").alias("label"))))
    matched, unknown = L.resume(ann, items(spark, sf_dir).select("id"))
    return (matched.withColumn("status", F.lit("matched"))
            .unionByName(unknown.withColumn("status", F.lit("unknown")))
            .groupBy("status", "label").agg(F.count("*").alias("n")))


# ----------------------------------------------------------------- S5 J1 F11 F10 J4 L8
UNANIMOUS_MODELS = ["a/flip7", "c/flip3"]


@query("unanimous_train", S.with_ctes(S.VOTES_CTE) + f"""
SELECT u.id, u.label, length(d.text) AS n_chars FROM (
  SELECT id, min(vote) AS label FROM fv
  WHERE model IN ({', '.join(S.q(m) for m in UNANIMOUS_MODELS)}) AND vote IS NOT NULL
  GROUP BY id HAVING min(vote) = max(vote) AND count(*) = {len(UNANIMOUS_MODELS)}) u
JOIN documents d ON d.doc_id = u.id
WHERE u.id NOT IN (SELECT doc_id FROM labels) AND d.text IS NOT NULL""")
def unanimous_train(spark, sf_dir):
    """Items both named runs label identically, minus gold items, with text."""
    agreed = V.unanimous(fixture_first_votes(spark, sf_dir).where(F.col("model").isin(UNANIMOUS_MODELS)),
                         UNANIMOUS_MODELS)
    gold = table(spark, sf_dir, "labels", "doc_id").withColumnRenamed("doc_id", "id")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    return (agreed.join(gold, "id", "left_anti").join(docs, "id")
            .where(F.col("text").isNotNull())
            .select("id", "label", F.length("text").cast("long").alias("n_chars")))


@query("human_train", S.with_ctes(ITEMS_CTE) + """
SELECT a.id, a.label, length(t.text) AS n_chars FROM
  (SELECT doc_id AS id, quality AS label FROM labels WHERE doc_id % 3 <> 0) a
  JOIN (SELECT id, arg_max(text, source_rank * 10000000000 + seq) AS text FROM items GROUP BY id) t
    ON a.id = t.id
WHERE a.id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 1) AND t.text IS NOT NULL""")
def human_train(spark, sf_dir):
    """Active-learning labels minus gold ids, texts looked up by id (last wins)."""
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    al = lab.where(F.col("doc_id") % 3 != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    gold = lab.where(F.col("doc_id") % 3 != 1).select(F.col("doc_id").alias("id"))
    train = al.join(gold, "id", "left_anti")
    # dict-style lookup (last row wins) over the labelled ids only, not the whole corpus
    texts = L.last_per_id(items(spark, sf_dir).join(train.select("id"), "id", "left_semi"),
                          ["source_rank", "seq"], ["text"])
    return (train.join(texts, "id", "left")
            .where(F.col("text").isNotNull())
            .select("id", "label", F.length("text").cast("long").alias("n_chars")))
