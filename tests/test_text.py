"""Text edge cases (Unicode word boundaries, whitespace, tags, entities)."""
from pyspark.sql import functions as F

from siftwise.functions import keywords as K
from siftwise.functions import text as X
from siftwise.functions.normalise import normalise_text


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("r")).first()["r"]


def test_whole_word_unicode(spark):
    assert not one(spark, "caféten", F.col("t").rlike(K.whole_word_pattern(["ten"])))
    assert one(spark, "ÉÉN", F.col("t").rlike(K.whole_word_pattern(["één"])))


def test_distinct_hits(spark):
    assert one(spark, "Eten drop DROP haring", K.distinct_hits("t", keywords=["eten", "drop", "haring"])) == 3
    assert one(spark, "we ate pea soup", K.distinct_hits("t", keywords=["pea soup", "meal"])) == 1


def test_proximity_same_line(spark):
    pats = K.lexicon_pattern(["zzz"], ["nederlandse"], ["keuken"])
    assert not one(spark, "nederlandse\nkeuken", K.matches_any("t", pats))
    assert one(spark, "nederlandse\rkeuken", K.matches_any("t", pats))
    assert one(spark, "de keuken is nederlandse", K.matches_any("t", pats))


def test_tokens(spark):
    assert one(spark, "één à l'été co-op x 42 Ça_va", X.tokens("t")) == ["één", "été", "co", "op", "42", "ça_va"]


def test_paragraphs_before_tags(spark):
    assert one(spark, "<p>a</p><p>b</p>", X.strip_tags(X.restore_paragraphs("t"))) == "a\n\n b"


def test_entities_and_ligature():
    assert normalise_text("&gt; ﬁn") == "> fin"
    assert normalise_text("cafÃ©") == "café"


def test_code_point_length_and_words(spark):
    assert one(spark, "a😀é", F.length("t")) == 3
    assert one(spark, " ".join(["w"] * 99), X.word_count("t")) == 99
    assert one(spark, " ".join(["w"] * 100) + "\u00a0x", X.word_count("t")) == 101
    assert one(spark, "  \u00a0 ", X.not_blank("t")) is False
    assert one(spark, "  ", X.has_text("t")) is True


def test_highlight_phrases(spark):
    assert one(spark, "Pea soup and kale, kale pea soup", K.highlight("t", ["pea soup", "kale"])) == (
        "**Pea soup** and **kale**, **kale** **pea soup**")
    assert one(spark, "speak pea soups", K.highlight("t", ["pea soup", "pea"])) == "speak **pea** soups"


def test_highlight_adjacent(spark):
    assert one(spark, "That this, THIS", K.highlight("t", ["this", "that"])) == "**That** **this**, **THIS**"


def test_fixed_lists_on_hand_examples(spark):
    import duckdb

    from siftwise.config import (KEYWORDS_NL, LEXICON_EN_ADJECTIVES, LEXICON_EN_NOUNS, LEXICON_EN_WORDS,
                                 LEXICON_NL_ADJECTIVES, LEXICON_NL_NOUNS, LEXICON_NL_WORDS, NEWSPAPER_PHRASES)
    nl = K.lexicon_pattern(LEXICON_NL_WORDS, LEXICON_NL_ADJECTIVES, LEXICON_NL_NOUNS)
    en = K.lexicon_pattern(LEXICON_EN_WORDS, LEXICON_EN_ADJECTIVES, LEXICON_EN_NOUNS)
    cases = [  # (text, nl lexicon, en lexicon, newspaper phrase)
        ("Lekker STAMPPOT met worst", True, True, False),
        ("De Nederlandse eetcultuur en de keuken", True, False, True),
        ("de keuken, zei hij, is typisch hollandse", True, False, False),
        ("Dutch\nkitchen", False, False, False),
        ("Dutch food culture", False, True, False),
        ("we had pea soup", False, True, False),
        ("vaderlansd eten", True, False, True),
        ("stamppotten", False, False, False),
    ]
    con = duckdb.connect()
    for text, want_nl, want_en, want_news in cases:
        got_nl = one(spark, text, K.matches_any("t", nl))
        got_en = one(spark, text, K.matches_any("t", en))
        got_news = one(spark, text, F.col("t").rlike(K.whole_word_pattern(NEWSPAPER_PHRASES)))
        assert (got_nl, got_en, got_news) == (want_nl, want_en, want_news), text
        w, p = K.lexicon_match("t", LEXICON_NL_WORDS, LEXICON_NL_ADJECTIVES, LEXICON_NL_NOUNS)
        w2, p2 = K.lexicon_match("t", LEXICON_EN_WORDS, LEXICON_EN_ADJECTIVES, LEXICON_EN_NOUNS)
        assert one(spark, text, w | p) == want_nl and one(spark, text, w2 | p2) == want_en, text
        assert one(spark, text, K.phrase_match("t", NEWSPAPER_PHRASES)) == want_news, text
        duck = [con.execute("SELECT regexp_matches(?, ?)", [text, p]).fetchone()[0]
                for p in K.lexicon_pattern(LEXICON_NL_WORDS, LEXICON_NL_ADJECTIVES, LEXICON_NL_NOUNS, "duckdb")]
        assert any(duck) == want_nl, text
    assert one(spark, "Eten, eten en nog eens ETEN; haring!", K.distinct_hits("t", keywords=KEYWORDS_NL)) == 2


def test_word_prefix_keeps_original_characters(spark):
    from siftwise.functions.prompts import word_prefix
    text = "  a\u00a0b c\u2003d"
    assert one(spark, text, word_prefix("t", F.lit(2))) == "a\u00a0b "
    assert one(spark, text, word_prefix("t", F.lit(10))) == "a\u00a0b c\u2003d"


def test_word_count_at_least_is_exact(spark):
    cases = ["", "   ", "w", " w ", " ".join(["w"] * 99), " ".join(["w"] * 100), "\n" + " ".join(["w"] * 100) + "  ",
             " ".join(["w"] * 101), " ".join(["w"] * 100)]
    for c in cases:
        assert one(spark, c, X.word_count_at_least("t", 100)) == (len(c.split()) >= 100), repr(c[:20])


def test_repair_of_damaged_runs():
    from siftwise.functions.normalise import normalise_text, repair_mojibake
    from siftwise.plans.fixtures import DAMAGED

    for damaged, clean in DAMAGED:
        assert normalise_text(damaged) == clean
        assert normalise_text(clean) == clean
    for text in ("\u00e9t\u00e9 \u65e5\u672c \u20ac", "\u00c9\u00bb", "\u00df\u00bb \u00d6\u00b0", "", "plain"):
        assert repair_mojibake(text) == text
    for text in ("\u00e9t\u00e9 \u20ac\u2019", "\u043f\u0440\u0438\u0432\u0435\u0442", "\U0001f600"):
        once = text.encode().decode("cp1252", "ignore") if "\u20ac" in text else text.encode().decode("latin-1")
        twice = once.encode().decode("latin-1")
        assert repair_mojibake(once) == text and repair_mojibake(twice) == text
    long = "x \u00c3\u00a9 " * 50000
    assert repair_mojibake(long) == "x \u00e9 " * 50000


def test_texts_travel_in_bounded_batches(spark):
    """a session with Spark's default sends at most 1,000 texts a batch to Python."""
    from siftwise.plans import QUERIES

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for name in ("text_repair", "scored_responses"):
            spark.conf.set(key, "10000")
            QUERIES[name](spark, "/root/testdata/sf0.001")
            assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, was)


def test_ngram_partitions_follow_the_text(spark, monkeypatch):
    """F8: n-grams are counted, joined and sorted in partitions in proportion to the text, with equal weights."""
    from pyspark.sql import functions as F

    from siftwise.operators import tfidf as T

    docs = spark.createDataFrame([(i, f"common word{i % 7} word{i % 3} only{i}") for i in range(200)], "id long, text string")
    cores = spark.sparkContext.defaultParallelism
    assert T.partitions_for(docs) is None and T.partitions_for(docs.where("id < 0")) is None
    monkeypatch.setattr(T, "PART_BYTES", docs.agg(F.sum(F.length("text"))).first()[0] // (2 * cores))
    parts = T.partitions_for(docs)
    assert parts > cores

    def weights(parts):
        terms = T.doc_terms(docs, ngrams=(1, 2), partitions=parts)
        vocab = T.fit_vocabulary(terms, F.lit(200), min_df=2, partitions=parts)
        return T.transform(terms, vocab, sublinear=True, partitions=parts)

    assert weights(parts).rdd.getNumPartitions() == parts
    plain, spread = ({(r["id"], r["term"]): round(r["weight"], 9) for r in weights(p).collect()} for p in (None, parts))
    assert plain == spread and len(plain) > 900


def test_pool_ids_are_kept(spark):
    """what is in the pool is told from kept ids, not from the texts again."""
    from siftwise.plans.q_models import pool_docs, pool_features

    docs, _, _ = pool_features(spark, "/root/testdata/sf0.001", persist=True, reuse_weights=True)
    assert docs.columns == ["id"] and docs.is_cached
    assert sorted(docs.collect()) == sorted(pool_docs(spark, "/root/testdata/sf0.001").select("id").collect())
