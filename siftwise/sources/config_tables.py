"""Per-language configuration as a small DataFrame.

One row per supported language: keyword list, stop-word list and prompt
template.  The table is bounded by the number of languages, so broadcasting it
is safe whatever the corpus size.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXTRA_STOP_WORDS_NL, TEST_KEYWORDS

STOP_WORD_LANGS = {"en": "english", "fr": "french", "de": "german", "es": "spanish",
                   "nl": "dutch"}

SYSTEM_PROMPTS = {
    "en": ("You decide whether a text is explicitly about the topic under study. "
           "Be strict: indirect or passing mentions are 0. Answer in JSON with a short "
           "'reasoning' (at most 15 words) followed by 'label' (1 or 0)."),
    "nl": ("Je beslist of een tekst expliciet over het onderzochte onderwerp gaat. "
           "Wees streng: indirecte of terloopse vermeldingen zijn 0. Antwoord in JSON met "
           "een korte 'reasoning' (maximaal 15 woorden) en daarna 'label' (1 of 0)."),
}


@functools.lru_cache(maxsize=None)
def _spark_stop_list(name: str) -> tuple[str, ...]:
    """The list ``StopWordsRemover.loadDefaultStopWords(name)`` returns, read from
    the Spark ML jar directly so no JVM is needed to build SQL text."""
    roots = [os.path.join(os.path.dirname(pyspark.__file__), "jars")]
    if os.environ.get("SPARK_HOME"):
        roots.append(os.path.join(os.environ["SPARK_HOME"], "jars"))
    jars = [j for r in roots for j in glob.glob(os.path.join(r, "spark-mllib_*.jar"))]
    if not jars:
        return ()          # SQL texts only: Spark plans ask the session (spark_stop_words)
    with zipfile.ZipFile(jars[0]) as z:
        raw = z.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode("utf-8")
    return tuple(w for w in raw.splitlines() if w)


def spark_stop_words(lang: str) -> list[str]:
    """The list for the language as the running session gives it."""
    from pyspark.ml.feature import StopWordsRemover
    return stop_words(lang, StopWordsRemover.loadDefaultStopWords)


def stop_words(lang: str, load=_spark_stop_list) -> list[str]:
    """Spark's built-in list for the language (Dutch gets five extra words)."""
    name = STOP_WORD_LANGS.get(lang)
    if name is None:
        return []
    words = list(load(name))
    if lang == "nl":
        words = sorted(set(words) | set(EXTRA_STOP_WORDS_NL))
    return list(words)


def lang_config(spark: SparkSession, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """``(lang, keywords ARRAY<STRING>, system_prompt STRING)``, one row per language."""
    kw = keywords or TEST_KEYWORDS
    rows = [(lang, [k.lower() for k in words], SYSTEM_PROMPTS.get(lang, SYSTEM_PROMPTS["en"]))
            for lang, words in sorted(kw.items())]
    df = spark.createDataFrame(rows, "lang string, keywords array<string>, system_prompt string")
    return F.broadcast(df)
