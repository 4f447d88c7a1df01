"""Mixing sources to target weights by systematic sampling, DataFrame functions only.

A document's expected number of copies is target / source_size of its source.  The
documents of a source are laid side by side, each as long as its expected copies;
one random offset is added, and a document is emitted once for every whole number
that lies in its stretch.  Documents are laid out by size class first, so that
every class is taken at the source's rate and the words taken come near the target.

Prefix sums without a task per source: rows are counted by cell (source, size
class, hash bucket of the id), offsets of the cells are summed over that small
table, and only the rows of one cell are ranked together.  A source, a size or a
text that holds a third of all rows is spread over its hash buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, read
from .registry import query

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2.0

BUCKETS = 256          # hash buckets of a (source, size class)
CLASSES_PER_OCTAVE = 4


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_repeat=MAX_REPEAT) -> DataFrame:
    """``sizes(source, source_size)`` (one row per source) -> with ``target``.

    Water filling: target = min(max_repeat * size, level * weight), the level such
    that targets sum to ``share`` of all sizes.  Sources ordered by size/weight are
    full up to some point; the level is what is left divided by the weights left."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("w", w).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
         .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * float(share)))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest_w = F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rest = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level_here", rest / rest_w)
    # the first row whose level fits has the true one; taking more sources as full only lowers it
    fits = F.when(F.col("level_here") * F.col("w") <= F.col("cap"), F.col("level_here"))
    level = F.max(fits).over(Window.partitionBy())
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, seed: int = 17,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies (and ``keep`` columns).

    A null text has size 0 and is taken like any other (it adds no words); a null
    source is a source of its own, last in order; a source without words has target
    0 and is not taken; repeated ids are separate documents; null ids are ranked
    among themselves.  The draw depends on the seed, the id and the size only, so
    reruns and retries agree whatever the partitioning."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
                    *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    cls = F.when(F.col("size") <= 0, F.lit(-1)).otherwise(
        F.floor(F.log2(F.col("size").cast("double")) * CLASSES_PER_OCTAVE)).cast("int")
    # two hex digits of a portable hash: one of BUCKETS
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int") % BUCKETS
    d = d.withColumn("cls", cls).withColumn("bucket", bucket)
    cells = d.groupBy("source", "cls", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    per_source = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_repeat)
    order = Window.partitionBy("source").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "cls", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    # one offset in [0, 1) per source
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0")))), 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
    plan = (cells.join(per_source, cells["source"].eqNullSafe(per_source["source"]))
            .select(cells["source"].alias("p_source"), F.col("cls").alias("p_cls"), F.col("bucket").alias("p_bucket"), "before",
                    "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")))
    ranked = d.withColumn("rank", F.row_number().over(
        Window.partitionBy("source", "cls", "bucket").orderBy("size", "doc_id")) - 1)
    on = ranked["source"].eqNullSafe(plan["p_source"]) & (ranked["cls"] == plan["p_cls"]) & (ranked["bucket"] == plan["p_bucket"])
    at = F.col("before") + F.col("rank")
    copies = (F.floor(offset + (at + 1) * F.col("rate")) - F.floor(offset + at * F.col("rate"))).cast("long")
    out = ranked.join(plan, on).withColumn("copies", copies)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"), "copies",
                      *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every column of ``docs``, each row once per copy."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                         F.col(kw.get("id_col", "doc_id")).alias("doc_id"), F.col(kw.get("text", "text")).alias("text"),
                         F.col(kw.get("source", "source")).alias("source"))
    kw = {k: v for k, v in kw.items() if k not in ("id_col", "text", "source")}
    m = mix(packed, keep=("doc",), **kw)
    return (m.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .select("doc.*"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::INTEGER AS bucket
  FROM documents),
e AS (SELECT *, CASE WHEN size <= 0 THEN -1 ELSE floor(log2(size::DOUBLE) * {CLASSES_PER_OCTAVE})::INTEGER END AS cls FROM d),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM e GROUP BY source),
wt AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w,
              {MAX_REPEAT}::DOUBLE * source_size AS cap, sum(source_size) OVER () * {SHARE}::DOUBLE AS total FROM src),
lv AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS here
       FROM wt WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target
       FROM (SELECT *, max(CASE WHEN here * w <= cap THEN here END) OVER () AS level FROM lv)),
rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, bucket, size, doc_id) - 1 AS pos FROM e),
j AS (SELECT rk.doc_id, rk.size, tg.source_size, tg.target, rk.pos,
             CASE WHEN tg.source_size > 0 THEN tg.target / tg.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('17:' || coalesce(rk.source, chr(0))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
      FROM rk JOIN tg ON rk.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, source_size, target,
       size * (floor(u + (pos + 1) * rate) - floor(u + pos * rate))::BIGINT AS taken,
       (floor(u + (pos + 1) * rate) - floor(u + pos * rate))::BIGINT AS copies
FROM j
"""


@query("op9_mixing", SQL)
def op9_mixing(spark, sf_dir):
    """All documents mixed to the contract's weights."""
    return mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
