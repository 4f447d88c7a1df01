"""Label maps, annotation upserts and resume matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALID_LABELS = [0, 1]


def read_label_map_files(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one JSON object ``{id: label}`` each -> ``(id, label, file)``.

    A label file is written by people, so one file is one bounded row; the map
    is exploded right away so nothing downstream depends on the file size.
    """
    raw = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("json"), F.col("_metadata.file_name").alias("file"))
    return parse_label_maps(raw, "json").withColumnRenamed("_src", "file")


def label_maps_from_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """JSON label-map text derived from a labels table (one small map per row;
    every 23rd entry carries the invalid label 2)."""
    lab = F.when(F.col(id_col) % 23 == 0, F.lit(2)).otherwise(F.col(label_col))
    return labels.select(F.to_json(F.create_map(F.col(id_col).cast("string"), lab)).alias("json"))


def parse_label_maps(df: DataFrame, json_col: str) -> DataFrame:
    """``from_json(map<string,int>)`` + ``explode`` -> ``(id STRING, label INT)``."""
    m = F.from_json(F.col(json_col), "map<string,int>")
    keep = [c for c in df.columns if c != json_col]
    return df.select(*keep, F.explode(m).alias("id", "label"))


def is_valid_label(col):
    """Q6: only 0 and 1 are accepted."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.isin(VALID_LABELS), F.lit(False))


def upsert_labels(rounds: DataFrame) -> DataFrame:
    """K7: the last label per id wins, ordered by (round, seq); partial and
    hot ids are combined map-side (``max_by`` is a partial aggregate)."""
    return rounds.groupBy("id").agg(
        F.max_by("label", F.struct("round", "seq")).alias("label"),
        F.max("round").alias("last_round"),
        F.count("*").alias("n_versions"))


def resume(annotations: DataFrame, pool_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations whose id is in the pool, annotations with unknown ids)."""
    # the pool is cut to the annotated ids first (a semi-join with the small side), then read once
    there = (pool_ids.select("id").join(annotations.select("id").distinct(), "id", "left_semi").distinct()
             .withColumn("_there", F.lit(True)))
    marked = annotations.join(there, "id", "left")
    return marked.where("_there").drop("_there"), marked.where("_there IS NULL").drop("_there")


def last_per_id(df: DataFrame, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Per id the values of the last row in ``order_cols`` order (dict semantics)."""
    return df.groupBy("id").agg(
        F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("_v")).select("id", "_v.*")
