"""Fixed values and parameters.

Values under "FIXED VALUES" must equal the behaviour being re-created (word
lists, phrase lists, budgets, thresholds).  They are stated plainly, in their
natural order.  Everything else is a parameter with a default.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay as given for equal results)
# ---------------------------------------------------------------------------

# Seed keywords, Dutch corpus (distinct whole-word hits are counted).
KEYWORDS_NL = [
    "eten", "culinair", "nederlands", "hollands", "stamppot", "stroopwafel",
    "bitterballen", "boerenkool", "erwtensoep", "kroket", "poffertjes",
    "pannenkoeken", "haring", "kibbeling", "drop", "hagelslag", "smakelijk",
    "gerecht", "lekker", "maaltijd",
]

# Seed keywords, English corpus.  Two entries are two-word phrases.
KEYWORDS_EN = [
    "food", "culinary", "dutch", "stamppot", "stroopwafel", "stroopwafels",
    "bitterballen", "bitterbal", "poffertjes", "kroket", "kibbeling",
    "hagelslag", "kale", "pea soup", "croquette", "croquettes", "pancakes",
    "herring", "licorice", "chocolate sprinkles", "dish", "tasty", "meal",
]

# Wide labelling lexicon, Dutch: single words, then the proximity rule
# "<adjective> ... keuken" or "keuken ... <adjective>" on one line.
LEXICON_NL_WORDS = [
    "eten", "voedsel", "koken", "culinair", "cuisine", "gastronomisch", "erfgoed",
    "eetcultuur", "boerenkool", "stamppot", "hutspot", "zuurkool", "snert",
    "erwtensoep", "oliebol", "oliebollen", "bitterbal", "bitterballen", "kroket",
    "kroketten", "frikandel", "frikandellen", "stroopwafel", "stroopwafels",
    "hagelslag", "drop", "speculaas", "ontbijtkoek", "poffertjes", "haring",
    "maatjesharing", "kabeljauw", "lekkerbek", "lekkerbekje", "kaas", "gouda",
    "leidse", "alkmaarse",
]
LEXICON_NL_ADJECTIVES = ["nederlandse", "hollandse", "nederlands"]
LEXICON_NL_NOUNS = ["keuken"]

# Wide labelling lexicon, English.  "\s*" marks an optional space.
LEXICON_EN_WORDS = [
    "food", "cooking", "cook", "culinary", "cuisine", "gastronom", "gastronomy",
    "heritage", r"food\s*culture", "kale", "boerenkool", "stamppot", "hutspot",
    "sauerkraut", "zuurkool", "snert", "erwtensoep", r"pea\s*soup", "oliebol",
    "oliebollen", "bitterbal", "bitterballen", "kroket", "kroketten", "croquette",
    "croquettes", "frikandel", "frikandellen", "stroopwafel", "stroopwafels",
    "hagelslag", "sprinkles", "drop", "licorice", "speculaas", "ontbijtkoek",
    "poffertjes", "haring", "herring", "cod", "kabeljauw", "smelt", "lekkerbek",
    "cheese", "kaas", "gouda", "leidse", "alkmaarse",
]
LEXICON_EN_ADJECTIVES = ["dutch"]
LEXICON_EN_NOUNS = ["cuisine", "cooking", "food", "kitchen"]

# Newspaper phrase screen (kept exactly, including the misspelt entry).
NEWSPAPER_PHRASES = [
    "nederlandse keuken", "nederlandse eetcultuur", "nederlands eten",
    "nederlandse cuisine", "nederlandse maaltijd", "hollandse maaltijd",
    "hollandse keuken", "hollands eten", "nederlandse kost", "hollandse kost",
    "vaderlandse keuken", "vaderlansd eten", "vaderlandse kost",
]

# Extra Dutch stop words added to the standard list.
EXTRA_STOP_WORDS_NL = ["mijn", "ik", "zijn", "was", "we"]

# Newspaper title of advertisements (dropped).
ADVERTISEMENT_TITLE = "Advertentie"

# Prompt truncation budgets per model (characters; None = token budget applies).
TRUNCATION_BUDGETS = [
    # (model, max_chars, max_tokens)
    ("BramVanroy/fietje-2-instruct", 2040, None),
    ("QuantTrio/Qwen3.6-27B-AWQ", 8000, None),
    ("BramVanroy/GEITje-7B-ultra", 95000, None),
]
DEFAULT_MAX_TOKENS = 8000

# Consensus and evaluation.
CONSENSUS_THRESHOLD = 3
NEWSPAPER_CONSENSUS_BOUNDS = (2, 3)   # relevant if votes > 3, irrelevant if votes < 2
ENSEMBLE_TOP_K = (3, 5)
ENSEMBLE_MAX_MODELS = 12
ENSEMBLE_MIN_COMBO = 3
TIE_BREAK_PRIORITY = ["0", "1"]
METRIC_DIGITS = 3
CV_DIGITS = 4

# Active learning.
QUERY_BATCH_FORUM = 25
QUERY_BATCH_NEWSPAPER = 50
SEED_SIZE = 25
SEED_MIN_DISTINCT_HITS = 4
SEED_MIN_CHARS = 150
MIN_WORDS = 100
RANDOM_SEED = 42

# Pool TF-IDF (V1) and evaluation TF-IDF (V2).
POOL_MAX_FEATURES = 10000
POOL_MIN_DF = 5
POOL_MAX_DF = 0.5
EVAL_MIN_DF = 2

# Bulk classification batch size.
SCORING_BATCH = 1000

# Classical model grids (names as reported).
NB_ALPHAS = [0.1, 0.5, 1.0, 2.0]
SVM_CS = [0.1, 1.0, 10.0]
LR_CS = [0.1, 1.0, 10.0]
CV_FOLDS = 5

# Response contract.
RESPONSE_LABELS = [0, 1]
RESPONSE_MAX_REASONING_WORDS = 15
RESPONSE_PARSE_ERROR = "JSON parsing error"

# ---------------------------------------------------------------------------
# Parameters for the synthetic test corpus (its prose is invented, so the
# food lexicon above never matches; these lists exercise the same operators).
# ---------------------------------------------------------------------------

TEST_KEYWORDS = {
    "en": ["that", "with", "this", "from", "tion", "thing", "and", "the", "was", "for"],
    "fr": ["le", "la", "des", "une", "pour", "dans", "avec", "sur", "qui", "est"],
    "de": ["die", "der", "und", "den", "von", "sich", "nicht", "ist", "ein", "das"],
    "es": ["de", "la", "que", "el", "en", "los", "del", "por", "con", "una"],
}
TEST_PHRASES = ["of the", "in the", "de la", "an der", "en el", "to the", "and the"]
TEST_LEXICON_WORDS = ["that", "with", "this", "thing"]
TEST_LEXICON_ADJECTIVES = ["with", "from"]
TEST_LEXICON_NOUNS = ["the"]

# Annotators used in the fixture votes (table order matters for prefix selection).
FIXTURE_MODELS = ["a/flip7", "a/flip5", "b/long", "b/words", "c/flip3", "d/flip7"]
