from pyspark.sql import functions as F

from siftwise.functions.responses import contract_violations, parse_response
from siftwise.operators.votes import canonical_label, numeric_label
from siftwise.plans.fixtures import RESPONSE_CASES

EXPECTED = [  # (label, reasoning, valid)
    ("1", "x", True), ("0", "x", True), ("1", "x", True), ("0", "x", True), ("1", "", True),
    ("0", "JSON parsing error", False), ("0", "JSON parsing error", False), ("1", "x", True), ("2", "x", True),
]


def test_response_cases(spark):
    df = spark.createDataFrame([(c,) for c in RESPONSE_CASES], "raw string")
    rows = df.select(parse_response("raw").alias("p")).select(
        "p.*", contract_violations(F.col("p")).alias("v")).collect()
    for r, (label, reasoning, valid) in zip(rows, EXPECTED):
        assert (r["label"], r["reasoning"], r["valid_json"]) == (label, reasoning, valid)
    assert rows[0]["v"] == []
    assert "label_not_integer" in rows[7]["v"] and "label_not_in_enum" in rows[8]["v"]


def test_label_canonicalisation(spark):
    df = spark.createDataFrame([(" 1",), ("1.0",), ("0",), ("2",), ("x",), (None,)], "l string")
    got = [(r["c"], r["n"]) for r in df.select(canonical_label("l").alias("c"), numeric_label("l").alias("n")).collect()]
    assert got == [(1, 1), (1, 1), (0, 0), (None, 2), (None, -1), (None, -1)]


def test_only_one_whole_object_is_valid(spark):
    cases = {
        '{"label":1} trailing': ("0", False), '{"label":1}{"label":0}': ("0", False), "{'label':1}": ("0", False),
        '{"label":1},{"label":0}': ("0", False), '{"label":1}],[{"label":0}': ("0", False), '{"label":1}} x': ("0", False),
        '{"label":0},"y":{"label":1}': ("0", False), '{"label":0,"label":1}': ("1", True), '{"label":1}': ("1", True),
        ' {"label":0} ': ("0", True), '[1]': ("0", False), '{"label":null}': (None, True), "": ("0", False),
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", parse_response("raw").alias("p"))
    got = {r["raw"]: (r["p"]["label"], r["p"]["valid_json"]) for r in df.collect()}
    assert got == cases
