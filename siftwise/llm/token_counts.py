"""Exact length histogram of encoded documents, and what follows from it for every context limit.

Each batch is encoded in whole and reduced to (source, length, documents) before
anything is shuffled; the histogram has at most one row per source and length.
Suffix sums over the lengths then answer, for every limit that a document has: how
many documents are longer, how many tokens a cut at the limit keeps and loses, and
the share of documents and tokens below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, saved
from .registry import query
from .textcodes import buffers
from .tokens import byte_encoder, public_path

RANKS = "byte_bpe_50k.tiktoken"


def _lengths(path: str | None):
    def run(batches):
        """(source, text) -> source, length, n_docs of the batch"""
        import pyarrow as pa

        encode = byte_encoder(path or public_path(RANKS)).encode_ordinary
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            n = [len(encode(data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace"))) for r in range(len(offsets) - 1)]
            t = pa.table({"source": batch.column(0), "length": pa.array(n, pa.int64())}).group_by(["source", "length"]).aggregate([([], "count_all")])
            yield pa.RecordBatch.from_arrays([t["source"].combine_chunks(), t["length"].combine_chunks(), t["count_all"].combine_chunks()],
                                             ["source", "length", "n_docs"])
    return run


def histogram(docs: DataFrame, text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(source, length, n_docs): documents by source and number of tokens.  Null and empty texts have length 0."""
    d = docs.select(F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return (d.mapInArrow(_lengths(path), "source string, length long, n_docs long")
            .groupBy("source", "length").agg(F.sum("n_docs").alias("n_docs")))


def limits(hist: DataFrame) -> DataFrame:
    """One row per scope and length: the histogram with its suffix sums.

    ``all_sources`` rows cover the whole table (source null); others one source (which
    may be null).  For limit = length: ``docs_longer`` documents exceed it,
    ``kept_tokens`` is the sum of min(length, limit), ``lost_tokens`` the rest,
    ``docs_share`` the share of documents it holds whole (the quantile of the length)."""
    scoped = hist.withColumn("all_sources", F.lit(False)).unionByName(
        hist.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
            .select(F.lit(None).cast("string").alias("source"), "length", "n_docs", F.lit(True).alias("all_sources")))
    scope = Window.partitionBy("all_sources", "source")
    longer = scope.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    total_docs, total = F.sum("n_docs").over(scope), F.sum(F.col("n_docs") * F.col("length")).over(scope)
    s = scoped.select(
        "all_sources", "source", "length", "n_docs", total_docs.alias("total_docs"), total.alias("total_tokens"),
        F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(longer), F.lit(0)).alias("tokens_longer"))
    kept = F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")
    return s.select("all_sources", "source", "length", "n_docs", "total_docs", "total_tokens", "docs_longer",
                    kept.alias("kept_tokens"), (F.col("total_tokens") - kept).alias("lost_tokens"),
                    ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("docs_share"))


def at_limits(hist: DataFrame, contexts: list[int]) -> DataFrame:
    """(source, context, docs_longer, kept_tokens, total_tokens) for given context limits."""
    c = F.explode(F.array(*[F.lit(int(x)) for x in contexts])).alias("context")
    return (hist.select("*", c).groupBy("source", "context").agg(
        F.sum(F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_longer"),
        F.sum(F.col("n_docs") * F.least("length", F.col("context").cast("long"))).alias("kept_tokens"),
        F.sum(F.col("n_docs") * F.col("length")).alias("total_tokens")))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Every length of every source, and of the whole table, with its suffix sums."""
    return limits(saved(histogram(read(spark, sf_dir, "documents", "text", "source"))))
