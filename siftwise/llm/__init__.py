"""Training-data operators: quality, language, near duplicates, sharding, token counts,
language-model scores, URL filters, mixing, packing,
personal data, resampling and conversation tries.  Nothing else in the library imports this."""

from . import (  # noqa: F401  (registration side effects)
    embed_dup,
    language,
    lm,
    mixing,
    near_dup,
    packing,
    pii,
    quality,
    resample,
    sharding,
    token_counts,
    trie,
    url_filter,
)
from .registry import LLM_ORACLE, LLM_QUERIES  # noqa: F401
