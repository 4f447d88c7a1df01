"""Model response parsing and contract checks.

A response is valid when, after stripping, it is one JSON object and nothing else.
Spark's JSON parser stops at the end of the first value, so the text is parsed
twice inside a wrapper (as a member, and as the one element of a list): text after
the object breaks at least one of them.  Of repeated keys the last counts.  For valid
objects: a missing ``label`` means 0, a missing ``reasoning`` means "", an
explicit JSON null stays NULL.  Anything else (broken JSON, arrays, scalars)
gives label 0 and reasoning "JSON parsing error".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RESPONSE_MAX_REASONING_WORDS, RESPONSE_PARSE_ERROR
from .text import strip_ws, word_count

KNOWN_KEYS = ["reasoning", "label"]
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "bad"}


def parse_response(raw_col) -> Column:
    """Struct ``(valid_json, label STRING, reasoning STRING, label_kind, keys)``."""
    raw = strip_ws(F.col(raw_col) if isinstance(raw_col, str) else raw_col)
    fields = "struct<label: variant, reasoning: string>"
    member = F.from_json(F.concat(F.lit('{"x":'), raw, F.lit("}")), f"x {fields}, bad string", STRICT)
    element = F.from_json(F.concat(F.lit('{"x":['), raw, F.lit("]}")), f"x array<{fields}>, bad string", STRICT)
    valid = F.coalesce(raw.startswith("{") & member["bad"].isNull() & element["bad"].isNull()
                       & (F.size(element["x"]) == 1), F.lit(False))
    keys = F.when(valid, F.array_distinct(F.json_object_keys(raw)))
    has_label = F.array_contains(keys, "label")
    has_reason = F.array_contains(keys, "reasoning")
    label_txt = member["x"]["label"].cast("string")
    reason_txt = member["x"]["reasoning"]
    vtype = F.schema_of_variant(member["x"]["label"])
    kind = (F.when(~valid, F.lit("invalid"))
            .when(~has_label, F.lit("missing"))
            .when(vtype.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("integer"))
            .when(vtype == "STRING", F.lit("string"))
            .when(vtype == "VOID", F.lit("null"))
            .otherwise(F.lit("other")))
    label = (F.when(~valid, F.lit("0")).when(~has_label, F.lit("0")).otherwise(label_txt))
    reasoning = (F.when(~valid, F.lit(RESPONSE_PARSE_ERROR))
                 .when(~has_reason, F.lit("")).otherwise(reason_txt))
    return F.struct(valid.alias("valid_json"), label.alias("label"), reasoning.alias("reasoning"),
                    kind.alias("label_kind"), keys.alias("keys"))


def contract_violations(parsed: Column) -> Column:
    """Names of every broken rule of the response contract (empty = valid)."""
    keys = parsed["keys"]
    checks = [
        ("invalid_json", ~parsed["valid_json"]),
        ("missing_label", parsed["valid_json"] & ~F.array_contains(keys, "label")),
        ("missing_reasoning", parsed["valid_json"] & ~F.array_contains(keys, "reasoning")),
        ("extra_keys", parsed["valid_json"]
         & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KNOWN_KEYS]))) > 0)),
        ("label_not_integer", parsed["label_kind"].isin("string", "null", "other")),
        ("label_not_in_enum", (parsed["label_kind"] == "integer")
         & ~parsed["label"].isin("0", "1")),
        ("reasoning_too_long", F.coalesce(word_count(parsed["reasoning"]), F.lit(0))
         > RESPONSE_MAX_REASONING_WORDS),
    ]
    arr = F.array(*[F.when(c, F.lit(n)) for n, c in checks])
    return F.filter(arr, lambda x: x.isNotNull())
