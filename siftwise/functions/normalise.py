"""Unicode normalisation as one Arrow-batched UDF.

There is no built-in for HTML entity decoding or NFKC folding, so the three
steps are fused into a single ``pandas_udf`` (one JVM<->Python hop per batch):
entity decoding, repair of the common "UTF-8 read as Latin-1/cp1252" damage,
then NFKC.

Damage is found inside a text: characters that stand for the bytes of a UTF-8 sequence
(a lead byte and its continuation bytes, read as Latin-1 or cp1252).  Runs of such
sequences are repaired each on its own, whatever stands around them, and again until
nothing changes, so text that was damaged twice comes back too.  A run of one sequence
must give a plausible character (Latin letters, punctuation, symbols), as ``\u00c9\u00bb``
may be meant; so must a longer one, or else stay within one block of letters, or give
damage that can be repaired in turn.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that cp1252 has for the bytes 0x80 to 0x9F (Latin-1 has control characters for them).
_CP1252 = {ch: byte for byte in range(0x80, 0xA0) for ch in [bytes([byte]).decode("cp1252", "ignore")] if ch}
_TRAIL = "[\u0080-\u00bf" + re.escape("".join(_CP1252)) + "]"
_RUN = re.compile(f"(?:[\u00c2-\u00df]{_TRAIL}|[\u00e0-\u00ef]{_TRAIL}{{2}}|[\u00f0-\u00f4]{_TRAIL}{{3}})+")
_MOST_ROUNDS = 5
# (first, last) code points that a single sequence may stand for
_PLAUSIBLE = ((0x00A0, 0x017F), (0x0192, 0x0192), (0x02C6, 0x02DC), (0x2010, 0x205E), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x21FF),
              (0x2200, 0x22FF), (0xFB00, 0xFB06), (0x1F300, 0x1FAFF))


def _plausible(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in _PLAUSIBLE)


def _repaired(m: re.Match) -> str:
    run = m.group()
    try:
        fixed = bytes(_CP1252.get(c, ord(c)) for c in run).decode("utf-8")
    except UnicodeDecodeError:
        return run
    odd = [c for c in fixed if not _plausible(c)]
    if not odd or len(fixed) > 1 and len({ord(c) >> 8 for c in odd}) == 1 and all(c.isalpha() for c in odd):
        return fixed
    return fixed if _RUN.sub(_repaired, fixed) != fixed else run       # damaged twice


def repair_mojibake(s: str) -> str:
    """Every damaged run of ``s`` repaired, to a fixed point."""
    for _ in range(_MOST_ROUNDS):
        fixed = _RUN.sub(_repaired, s)
        if fixed == s:
            break
        s = fixed
    return s


def normalise_text(s: str | None) -> str | None:
    if s is None:
        return None
    return unicodedata.normalize("NFKC", repair_mojibake(html.unescape(s)))


@F.pandas_udf(T.StringType())
def normalise_unicode(texts: pd.Series) -> pd.Series:
    """X3+X4+X5 on a batch of texts."""
    return texts.map(normalise_text)
