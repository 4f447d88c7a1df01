"""Positions in file feeds without a sort.

A feed is a folder of files; its order is that of the file names, then of the rows in a file.
Rows are counted per file once.  The files that lie wholly within the first k rows need no
positions; only the file in which row k falls is read by position: rows are counted per
split of that file, the splits' counts are added up, and a row's place is its split's
offset plus its place in the split.  Splits are byte ranges of the file, so a task that is
run again, on any executor, gives the same places.  Files beyond row k are not read.

Nothing is shuffled but counts: one row per file, and per split of one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sampling import ratio_count


def file_counts(spark: SparkSession, path: str, schema: StructType, fmt: str = "json") -> list[tuple[str, int]]:
    """(file, rows) in feed order: one row a file."""
    rows = spark.read.schema(schema).format(fmt).load(path)
    if fmt == "json":                                     # a line is a row; without a column nothing is parsed
        rows = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    got = rows.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n")).collect()
    return sorted((r["file"], r["n"]) for r in got)


def _head_of_file(spark: SparkSession, file: str, schema: StructType, fmt: str, k: int) -> DataFrame:
    """The first ``k`` rows of one file."""
    rows = spark.read.schema(schema).format(fmt).load(file)
    names = rows.columns
    placed = rows.select("*", F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_row"))
    # a data column is counted as well, so both reads parse the same rows
    splits = placed.groupBy("_split").agg(F.count("*").alias("n"), F.min("_row").alias("first"), F.count(names[0])).collect()
    before, offsets = 0, []
    for r in sorted(splits, key=lambda r: r["_split"]):
        offsets.append((r["_split"], before - r["first"]))
        before += r["n"]
    shift = spark.createDataFrame(offsets, "_split long, _shift long")       # one row a split of the file
    return placed.join(F.broadcast(shift), "_split").where(F.col("_row") + F.col("_shift") < k).select(*names)


def head(spark: SparkSession, path: str, schema: StructType, k: int, fmt: str = "json", counts: list[tuple[str, int]] | None = None) -> DataFrame:
    """S3: the first ``k`` rows of the feed at ``path`` (all if there are fewer)."""
    whole, left, cut = [], k, None
    for file, n in counts if counts is not None else file_counts(spark, path, schema, fmt):
        if left <= 0:
            break
        if n <= left:
            whole.append(file)
        else:
            cut = file
            break
        left -= n
    out = spark.read.schema(schema).format(fmt).load(whole) if whole else spark.createDataFrame([], schema)
    return out if cut is None else out.unionByName(_head_of_file(spark, cut, schema, fmt, left))


def head_ratio(spark: SparkSession, path: str, schema: StructType, ratio: float | None, fmt: str = "json") -> DataFrame:
    """the first ``max(1, ceil(n * ratio))`` rows of a feed of n; all if ``ratio`` is None."""
    if ratio is not None and not (0 < ratio <= 1):
        raise ValueError("ratio must be a number in (0, 1]")
    if ratio is None:
        return spark.read.schema(schema).format(fmt).load(path)
    counts = file_counts(spark, path, schema, fmt)
    return head(spark, path, schema, ratio_count(sum(n for _, n in counts), ratio), fmt, counts)
