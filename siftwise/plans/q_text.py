"""Queries of the text layer: ingest filters, article cleaning, screening, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import (KEYWORDS_EN, KEYWORDS_NL, LEXICON_EN_ADJECTIVES, LEXICON_EN_NOUNS, LEXICON_EN_WORDS,
                      LEXICON_NL_ADJECTIVES, LEXICON_NL_NOUNS, LEXICON_NL_WORDS, NEWSPAPER_PHRASES)
from ..config import (ADVERTISEMENT_TITLE, MIN_WORDS, QUERY_BATCH_NEWSPAPER, RANDOM_SEED,
                      SEED_MIN_CHARS, SEED_MIN_DISTINCT_HITS, SEED_SIZE, TEST_KEYWORDS,
                      TEST_LEXICON_ADJECTIVES, TEST_LEXICON_NOUNS, TEST_LEXICON_WORDS,
                      TEST_PHRASES)
from ..functions import keywords as K
from ..functions import text as X
from ..operators import sampling as Q
from ..sources.config_tables import SYSTEM_PROMPTS, lang_config
from ..sources import feeds as FD
from ..sources.tables import ITEM_SCHEMA, articles_from_pages, items, read_articles_json, table
from . import sql as S
from .cache import memo, persisted
from .fixtures import TOPIC_SNIPPETS, topic_documents
from .registry import query

HEAD_RATIO = 0.1
SEED_PHRASES = ["of the", "de la"]
PREVIEW_CHARS = 2000

# ----------------------------------------------------------------- shared SQL pieces
_LANG_VALUES = ", ".join(
    f"({S.q(lang)}, [{', '.join(S.q(k) for k in kws)}], {S.q(SYSTEM_PROMPTS.get(lang, SYSTEM_PROMPTS['en']))})"
    for lang, kws in sorted(TEST_KEYWORDS.items()))
LANG_CTE = f"lang_config AS (SELECT * FROM (VALUES {_LANG_VALUES}) t(lang, keywords, system_prompt))"

ITEMS_CTE = """items AS (
  SELECT doc_id AS id, text, lang, source,
         CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS source_rank, doc_id AS seq
  FROM documents)"""

ARTICLES_CTE = f"""articles AS (
  SELECT page_id AS article_id,
    CASE WHEN page_id % 5 = 0 THEN {S.q(ADVERTISEMENT_TITLE)} WHEN page_id % 11 = 0 THEN NULL
         ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title,
    url AS identifier, url AS ocr_url,
    CASE WHEN page_id % 7 = 0 THEN NULL ELSE html END AS ocr_xml,
    regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain_text
  FROM pages)"""


def _sql_hits(text: str, kw_col: str, phrases: list[str]) -> str:
    parts = [f"len(list_intersect({S.tokens(text, X.ANY_TOKEN_PATTERN)}, {kw_col}))"]
    for p in phrases:
        parts.append(f"(CASE WHEN regexp_matches({text}, {S.q(K.whole_word_pattern([p], 'duckdb'))}) "
                     f"THEN 1 ELSE 0 END)")
    return "(" + " + ".join(parts) + ")"


def _sql_any(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({text}, {S.q(p)}), false)" for p in patterns) + ")"


def _sql_highlight(text: str, words: list[str]) -> str:
    kw = "[" + ", ".join(S.q(w.lower()) for w in words) + "]"
    return (f"array_to_string(list_transform(regexp_extract_all({text}, {S.q(X.WORD_RUNS_PATTERN)}), "
            f"lambda r: CASE WHEN list_contains({kw}, lower(r)) THEN '**' || r || '**' ELSE r END), '')")


def _clean_article_sql(expr: str) -> str:
    return S.strip(f"regexp_replace(replace({expr}, '</p>', chr(10) || chr(10)), '<[^>]+>', ' ', 'g')")


# ----------------------------------------------------------------- S1 U1 F1 F2 F3
@query("items_union_clean", S.with_ctes(ITEMS_CTE) + f"""
SELECT id, lang, source, CASE WHEN source_rank % 2 = 0 THEN 'posts' ELSE 'comments' END AS feed,
       {S.word_count('text')} AS n_words, length(text) AS n_chars
FROM items
WHERE text IS NOT NULL AND text <> '' AND regexp_matches(text, {S.q(X.NON_WS_CLASS)})
  AND {S.word_count('text')} >= {MIN_WORDS}""")
def items_union_clean(spark, sf_dir):
    """Posts and comments feeds in one bag; keep texts that are non-empty, not
    blank and at least 100 whitespace words long."""
    it = items(spark, sf_dir)
    # both feeds come from one table here: one scan, the feed by its rank
    bag = it.withColumn("feed", F.when(F.col("source_rank") % 2 == 0, F.lit("posts")).otherwise(F.lit("comments")))
    return (bag.where(X.has_text("text") & X.not_blank("text"))
            .withColumn("n_words", X.word_count("text").cast("long"))
            .where(F.col("n_words") >= MIN_WORDS)
            .select("id", "lang", "source", "feed", "n_words",
                    F.length("text").cast("long").alias("n_chars")))


# ----------------------------------------------------------------- F4 F5 X1 X2 X17
def clean_articles(spark, sf_dir):
    a = articles_from_pages(spark, sf_dir)
    kept = a.where(~F.col("title").eqNullSafe(ADVERTISEMENT_TITLE) & F.col("ocr_xml").isNotNull())
    cleaned = kept.withColumn("text", X.strip_tags(X.restore_paragraphs("ocr_xml")))
    return cleaned.where(X.not_blank("text"))


@query("article_clean", S.with_ctes(ARTICLES_CTE) + f"""
SELECT article_id, upper(replace(title, 'ß', 'ss')) AS title_upper,
       length(text) AS n_chars, text
FROM (SELECT *, {_clean_article_sql('ocr_xml')} AS text FROM articles
      WHERE title IS DISTINCT FROM {S.q(ADVERTISEMENT_TITLE)} AND ocr_xml IS NOT NULL) c
WHERE regexp_matches(text, {S.q(X.NON_WS_CLASS)})""")
def article_clean(spark, sf_dir):
    """Drop advertisements and articles without OCR; restore paragraphs, strip tags."""
    return clean_articles(spark, sf_dir).select(
        "article_id", F.upper("title").alias("title_upper"),
        F.length("text").cast("long").alias("n_chars"), "text")


# ----------------------------------------------------------------- S2 S7 F15
@query("article_scan", S.with_ctes(ARTICLES_CTE, LANG_CTE) + """
SELECT a.article_id, a.identifier, a.title, l.lang, len(l.keywords) AS n_keywords,
       length(a.plain_text) AS plain_chars, a.ocr_xml IS NOT NULL AS has_ocr
FROM articles a
LEFT JOIN lang_config l ON regexp_extract(a.ocr_url, '/([a-z][a-z])/', 1) = l.lang""")
def article_scan(spark, sf_dir):
    """Newspaper rows (only the four read columns survive) with their language config."""
    a = articles_from_pages(spark, sf_dir).withColumn(
        "url_lang", F.regexp_extract("ocr_url", "/([a-z][a-z])/", 1))
    cfg = lang_config(spark)
    return (a.join(cfg, a.url_lang == cfg.lang, "left")
            .select("article_id", "identifier", "title", cfg.lang,
                    F.size("keywords").cast("long").alias("n_keywords"),
                    F.length("plain_text").cast("long").alias("plain_chars"),
                    F.col("ocr_xml").isNotNull().alias("has_ocr")))


@query("article_feed", S.with_ctes(ARTICLES_CTE) + f"""
SELECT identifier, title, length(plain_text) AS plain_chars, length(ocr_xml) AS ocr_chars FROM articles
WHERE title IS DISTINCT FROM {S.q(ADVERTISEMENT_TITLE)} AND ocr_xml IS NOT NULL""")
def article_feed(spark, sf_dir):
    """The newspaper rows as NDJSON files of the eight string fields, read with the fixed schema."""
    from .q_ml import scratch_dir
    base = f"{scratch_dir(spark, 'articles')}/feed"
    articles_from_pages(spark, sf_dir).drop("article_id").write.json(base)
    a = read_articles_json(spark, base)
    kept = a.where(~F.col("title").eqNullSafe(ADVERTISEMENT_TITLE) & F.col("ocr_xml").isNotNull())
    return kept.select("identifier", "title", F.length("plain_text").cast("long").alias("plain_chars"), F.length("ocr_xml").cast("long").alias("ocr_chars"))


@query("lang_config", S.with_ctes(LANG_CTE) + """
SELECT l.lang, count(d.doc_id) AS n_docs, len(l.keywords) AS n_keywords,
       length(l.system_prompt) AS prompt_chars
FROM lang_config l LEFT JOIN documents d ON d.lang = l.lang
GROUP BY l.lang, l.keywords, l.system_prompt""")
def lang_config_query(spark, sf_dir):
    """Documents per configured language, with the size of its keyword list and prompt."""
    counts = table(spark, sf_dir, "documents", "doc_id", "lang").groupBy("lang").agg(
        F.count("doc_id").alias("n_docs"))
    cfg = lang_config(spark)
    return (cfg.join(counts, "lang", "left")
            .select("lang", F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
                    F.size("keywords").cast("long").alias("n_keywords"),
                    F.length("system_prompt").cast("long").alias("prompt_chars")))


# ----------------------------------------------------------------- X6 X7 F6 Q2
def keyword_hit_table(spark, sf_dir):
    """``(id, lang, hits, n_chars)`` for every item, built once per application
    (read by the hit report, the seed candidates and the seed draw)."""
    def build():
        it = items(spark, sf_dir)
        cfg = lang_config(spark)
        kw = F.coalesce("keywords", F.array().cast("array<string>"))
        return persisted(it.join(cfg, "lang", "left").select(
            "id", "lang", K.distinct_hits("text", kw, SEED_PHRASES).cast("long").alias("hits"),
            F.length("text").cast("long").alias("n_chars")))
    return memo(spark, ("keyword_hits", sf_dir), build)


_HITS_SQL = _sql_hits("i.text", "coalesce(l.keywords, [])", SEED_PHRASES)


@query("keyword_hits", S.with_ctes(ITEMS_CTE, LANG_CTE) + f"""
SELECT i.id, i.lang, {_HITS_SQL} AS hits
FROM items i LEFT JOIN lang_config l ON i.lang = l.lang""")
def keyword_hits(spark, sf_dir):
    """Distinct whole-word keyword hits per document (language's list plus phrases)."""
    return keyword_hit_table(spark, sf_dir).select("id", "lang", "hits")


def seed_candidate_table(spark, sf_dir):
    return (keyword_hit_table(spark, sf_dir)
            .where((F.col("hits") >= SEED_MIN_DISTINCT_HITS) & (F.col("n_chars") >= SEED_MIN_CHARS)))


CAND_SQL = S.with_ctes(ITEMS_CTE, LANG_CTE, f"""cand AS (
  SELECT i.id, i.lang, {_HITS_SQL} AS hits, length(i.text) AS n_chars
  FROM items i LEFT JOIN lang_config l ON i.lang = l.lang
  WHERE {_HITS_SQL} >= {SEED_MIN_DISTINCT_HITS} AND length(i.text) >= {SEED_MIN_CHARS})""")


@query("seed_candidates", CAND_SQL + "SELECT id, lang, hits, n_chars FROM cand")
def seed_candidates(spark, sf_dir):
    """at least four distinct keywords and at least 150 characters."""
    return seed_candidate_table(spark, sf_dir).select("id", "lang", "hits", "n_chars")


@query("seed_sample", CAND_SQL + f"""
, chosen AS (
  SELECT id FROM cand WHERE (SELECT count(*) FROM cand) >= {SEED_SIZE}
  UNION ALL SELECT id FROM items WHERE (SELECT count(*) FROM cand) < {SEED_SIZE})
SELECT id, md5('{RANDOM_SEED}:' || CAST(id AS VARCHAR)) AS draw_key FROM chosen
ORDER BY draw_key, id LIMIT {SEED_SIZE}""")
def seed_sample(spark, sf_dir):
    """Q2: 25 seeded draws from the candidates (or from the whole pool if too few)."""
    return Q.seed_sample(seed_candidate_table(spark, sf_dir), keyword_hit_table(spark, sf_dir), SEED_SIZE)


# ----------------------------------------------------------------- F7 F8 X8 X9
_PHRASE_DUCK = K.whole_word_pattern(TEST_PHRASES, "duckdb")


@query("phrase_screen", S.with_ctes(ARTICLES_CTE) + f"""
SELECT article_id, title FROM articles
WHERE coalesce(regexp_matches(plain_text, {S.q(_PHRASE_DUCK)}), false)
   OR regexp_matches(coalesce(title, ''), {S.q(_PHRASE_DUCK)})""")
def phrase_screen(spark, sf_dir):
    """any phrase (case-insensitive, whole words) in the body OR the title."""
    a = articles_from_pages(spark, sf_dir)
    hit = K.phrase_match("plain_text", TEST_PHRASES) | K.phrase_match(F.coalesce("title", F.lit("")), TEST_PHRASES)
    return a.where(hit).select("article_id", "title")


_LEX_DUCK = K.lexicon_pattern(TEST_LEXICON_WORDS, TEST_LEXICON_ADJECTIVES, TEST_LEXICON_NOUNS, "duckdb")


@query("lexicon_proximity", f"""
SELECT doc_id AS id, {_sql_any('text', _LEX_DUCK[:1])} AS word_hit,
       {_sql_any('text', _LEX_DUCK[1:])} AS proximity_hit,
       {_sql_any('text', _LEX_DUCK)} AS screened
FROM documents""")
def lexicon_proximity(spark, sf_dir):
    """F8: word list OR adjective..noun / noun..adjective on one line."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    word, prox = K.lexicon_match("text", TEST_LEXICON_WORDS, TEST_LEXICON_ADJECTIVES, TEST_LEXICON_NOUNS)
    return d.select(F.col("doc_id").alias("id"), word.alias("word_hit"),
                    prox.alias("proximity_hit"), (word | prox).alias("screened"))


def _sql_highlight_phrases(text: str, phrases: list[str]) -> str:
    """Phrases marked in SQL without lookaround: every run of non-word characters is put
    between two separators, so neighbouring matches have one each."""
    sep = "chr(1)"
    split = f"regexp_replace({text}, {S.q('(' + X.NON_WORD_CLASS + '+)')}, {sep} || '\\1' || {sep}, 'g')"
    alt = "|".join(sep_words for sep_words in ("\x01 \x01".join(p.split()) for p in sorted(phrases, key=len, reverse=True)))
    marked = f"regexp_replace({split}, {S.q(f'(?i)(^|\x01)({alt})(\x01|$)')}, '\\1**\\2**\\3', 'g')"
    return f"replace({marked}, {sep}, '')"


@query("highlight_preview", f"""
SELECT doc_id AS id, {_sql_highlight(f'substr(text, 1, {PREVIEW_CHARS})', TEST_LEXICON_WORDS)} AS preview
FROM documents""")
def highlight_preview(spark, sf_dir):
    """X9 then X8: clip to the preview size, then mark every lexicon word."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select(F.col("doc_id").alias("id"),
                    K.highlight(X.clip("text", PREVIEW_CHARS), TEST_LEXICON_WORDS).alias("preview"))


# ----------------------------------------------------------------- F9 S3
@query("head_ratio_sample", S.with_ctes(ITEMS_CTE) + f"""
SELECT id, source_rank, seq, pos FROM (
  SELECT id, source_rank, seq, row_number() OVER (ORDER BY source_rank, seq) - 1 AS pos,
         count(*) OVER () AS n FROM items) t
WHERE pos < greatest(1, CAST(ceil(n * {HEAD_RATIO}) AS BIGINT))""")
def head_ratio_sample(spark, sf_dir):
    """the first ceil(10%) items in feed order (source, then position)."""
    it = items(spark, sf_dir).select("id", "source_rank", "seq")
    return Q.head_ratio(it, ["source_rank", "seq"], HEAD_RATIO).select("id", "source_rank", "seq", "pos")


HEAD_ROWS = 333


def item_feed(spark, sf_dir):
    """The items as a feed of NDJSON files, in the order of source and position: its folder."""
    from .q_ml import scratch_dir
    base = f"{scratch_dir(spark, 'feed')}/items"
    (items(spark, sf_dir).repartitionByRange(7, "source_rank", "seq").sortWithinPartitions("source_rank", "seq")
     .select(F.col("id").cast("string").alias("id"), "text").write.json(base))
    return base


_FEED_SQL = "SELECT id, len(text)::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (ORDER BY source_rank, seq) AS n, count(*) OVER () AS all_rows FROM items)"


@query("feed_head", S.with_ctes(ITEMS_CTE) + _FEED_SQL + f" WHERE n <= {HEAD_ROWS}")
def feed_head(spark, sf_dir):
    """S3: the first 333 records of the feed in file order; only the files they lie in are read."""
    got = FD.head(spark, item_feed(spark, sf_dir), ITEM_SCHEMA, HEAD_ROWS)
    return got.select(F.col("id").cast("long").alias("id"), F.length("text").cast("long").alias("n_chars"))


@query("feed_ratio_head", S.with_ctes(ITEMS_CTE) + _FEED_SQL + f" WHERE n <= greatest(1, ceil(all_rows * {HEAD_RATIO}))")
def feed_ratio_head(spark, sf_dir):
    """the first ceil(10%) records of the feed in file order."""
    got = FD.head_ratio(spark, item_feed(spark, sf_dir), ITEM_SCHEMA, HEAD_RATIO)
    return got.select(F.col("id").cast("long").alias("id"), F.length("text").cast("long").alias("n_chars"))


# ----------------------------------------------------------------- Q3 F12 Q5
_QUEUE_KW = "coalesce(l.keywords, [])"


@query("label_queue", S.with_ctes(ITEMS_CTE, LANG_CTE) + f"""
SELECT row_number() OVER (ORDER BY draw_key, id) AS ordinal, id, hits, n_keywords, preview FROM (
  SELECT i.id, md5('{RANDOM_SEED}:' || CAST(i.id AS VARCHAR)) AS draw_key,
         {_sql_hits('i.text', _QUEUE_KW, [])} AS hits, len({_QUEUE_KW}) AS n_keywords,
         {_sql_highlight(f'substr(i.text, 1, {PREVIEW_CHARS})', TEST_LEXICON_WORDS)} AS preview
  FROM items i LEFT JOIN lang_config l ON i.lang = l.lang
  WHERE i.id NOT IN (SELECT doc_id FROM labels)
  ORDER BY draw_key, i.id LIMIT {QUERY_BATCH_NEWSPAPER}) q""")
def label_queue(spark, sf_dir):
    """Next labelling batch: unlabelled items in seeded order, with keyword hint and
    highlighted preview.  The ordinal is taken on the 50-row batch only."""
    it = items(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels", "doc_id").withColumnRenamed("doc_id", "id")
    pool = it.join(labelled, "id", "left_anti")
    batch = (pool.withColumn("draw_key", Q.seeded_key("id"))
             .orderBy("draw_key", "id").limit(QUERY_BATCH_NEWSPAPER))
    cfg = lang_config(spark)
    kw = F.coalesce("keywords", F.array().cast("array<string>"))
    w = Window.orderBy("draw_key", "id")   # over the 50-row batch only
    return (batch.join(cfg, "lang", "left")
            .select(F.row_number().over(w).cast("long").alias("ordinal"), "id",
                    K.distinct_hits("text", kw).cast("long").alias("hits"),
                    F.size(kw).cast("long").alias("n_keywords"),
                    K.highlight(X.clip("text", PREVIEW_CHARS), TEST_LEXICON_WORDS).alias("preview")))



# ----------------------------------------------------------------- X6 F6 F7 F8 with the fixed lists
_KW_NL_SINGLE, _KW_NL_PHRASES = K.split_keywords(KEYWORDS_NL)
_KW_EN_SINGLE, _KW_EN_PHRASES = K.split_keywords(KEYWORDS_EN)
_LEX_NL = {"duckdb": K.lexicon_pattern(LEXICON_NL_WORDS, LEXICON_NL_ADJECTIVES, LEXICON_NL_NOUNS, "duckdb")}
_LEX_EN = {"duckdb": K.lexicon_pattern(LEXICON_EN_WORDS, LEXICON_EN_ADJECTIVES, LEXICON_EN_NOUNS, "duckdb")}
_NEWS = {"duckdb": K.whole_word_pattern(NEWSPAPER_PHRASES, "duckdb")}


def _list_sql(words):
    return "[" + ", ".join(S.q(w) for w in words) + "]"


TOPIC_CTE = f"""topic_docs AS (
  SELECT doc_id, text || ' ' || {_list_sql(TOPIC_SNIPPETS)}[CAST(doc_id % {len(TOPIC_SNIPPETS)} AS INTEGER) + 1] AS text
  FROM documents)"""


@query("topic_screen", S.with_ctes(TOPIC_CTE) + f"""
SELECT doc_id AS id,
  {_sql_hits('text', _list_sql(_KW_NL_SINGLE), _KW_NL_PHRASES)} AS hits_nl,
  {_sql_hits('text', _list_sql(_KW_EN_SINGLE), _KW_EN_PHRASES)} AS hits_en,
  {_sql_any('text', _LEX_NL['duckdb'])} AS lexicon_nl,
  {_sql_any('text', _LEX_EN['duckdb'])} AS lexicon_en,
  coalesce(regexp_matches(text, {S.q(_NEWS['duckdb'])}), false) AS newspaper_phrase
FROM topic_docs""")
def topic_screen(spark, sf_dir):
    """The configured topic lists on every document: distinct seed keywords (both
    languages), the wide labelling lexicons with their proximity rules, and the
    newspaper phrase screen."""
    lists = (KEYWORDS_NL, KEYWORDS_EN, LEXICON_NL_WORDS, LEXICON_NL_ADJECTIVES, LEXICON_NL_NOUNS, LEXICON_EN_WORDS, LEXICON_EN_ADJECTIVES,
             LEXICON_EN_NOUNS, NEWSPAPER_PHRASES)
    # every text is tokenised once, for all lists together
    d = topic_documents(spark, sf_dir).select("doc_id", "text", K.present("text", K.vocabulary(*lists)).alias("words"))
    toks = F.col("words")
    nl_word, nl_prox = K.lexicon_match("text", LEXICON_NL_WORDS, LEXICON_NL_ADJECTIVES, LEXICON_NL_NOUNS, toks)
    en_word, en_prox = K.lexicon_match("text", LEXICON_EN_WORDS, LEXICON_EN_ADJECTIVES, LEXICON_EN_NOUNS, toks)
    return d.select(
        F.col("doc_id").alias("id"),
        K.distinct_hits("text", keywords=KEYWORDS_NL, toks=toks).cast("long").alias("hits_nl"),
        K.distinct_hits("text", keywords=KEYWORDS_EN, toks=toks).cast("long").alias("hits_en"),
        (nl_word | nl_prox).alias("lexicon_nl"),
        (en_word | en_prox).alias("lexicon_en"),
        K.phrase_match("text", NEWSPAPER_PHRASES, toks).alias("newspaper_phrase"))


# ----------------------------------------------------------------- F7 Q3 F12 Q5 X8 X9 X17 (newspaper queue)
@query("article_label_queue", S.with_ctes(ARTICLES_CTE) + f"""
SELECT row_number() OVER (ORDER BY draw_key, article_id) AS ordinal, article_id, title_upper, preview FROM (
  SELECT article_id, md5('{RANDOM_SEED}:' || CAST(article_id AS VARCHAR)) AS draw_key,
         upper(replace(coalesce(title, ''), 'ß', 'ss')) AS title_upper,
         {_sql_highlight_phrases(f'substr(plain_text, 1, {PREVIEW_CHARS})', TEST_PHRASES)} AS preview
  FROM articles
  WHERE (coalesce(regexp_matches(plain_text, {S.q(_PHRASE_DUCK)}), false)
         OR regexp_matches(coalesce(title, ''), {S.q(_PHRASE_DUCK)}))
    AND article_id % 4 <> 0
  ORDER BY draw_key, article_id LIMIT {QUERY_BATCH_NEWSPAPER}) q""")
def article_label_queue(spark, sf_dir):
    """Newspaper labelling batch: phrase-screened articles (body or title), minus
    those already labelled (every fourth article here), in seeded order, with the
    upper-cased title and a highlighted preview.  Ordinals on the 50-row batch."""
    a = articles_from_pages(spark, sf_dir)
    hit = K.phrase_match("plain_text", TEST_PHRASES) | K.phrase_match(F.coalesce("title", F.lit("")), TEST_PHRASES)
    batch = (a.where(hit & (F.col("article_id") % 4 != 0))
             .withColumn("draw_key", Q.seeded_key("article_id"))
             .orderBy("draw_key", "article_id").limit(QUERY_BATCH_NEWSPAPER))
    w = Window.orderBy("draw_key", "article_id")   # over the 50-row batch only
    return batch.select(F.row_number().over(w).cast("long").alias("ordinal"), "article_id",
                        F.upper(F.coalesce("title", F.lit(""))).alias("title_upper"),
                        K.highlight(X.clip("plain_text", PREVIEW_CHARS), TEST_PHRASES).alias("preview"))
