"""Near duplicates of embeddings: int8 tile products with error bounds, exact recheck.

Candidates come from sign hashes: ``tables`` keys of ``bits`` random hyperplanes each.
``bits`` follows the number of vectors (log2 plus a margin, so unrelated vectors
rarely meet) and ``tables`` follows ``bits`` such that a pair at the threshold shares
no key with probability at most ``MISS``; closer pairs still less.  Work grows a
little faster than the input (about n**1.15 at cosine 0.95), not with its square.

A vector is scaled to length 1 and quantised to int8: u = s*q + r with |r| known.
From |u.v - s_u s_v q_u.q_v| <= |r_u| + (1 + |r_u|) |r_v| pairs that cannot reach the
threshold are dropped on the integer products (exact in float BLAS); the others are
recomputed in double precision.

Equal vectors are one class.  Classes in a bucket are linked as in ``bucket_links``
(never all pairs of a group as rows).  When the components stand, each component is
cut into blocks of about ``TILE`` classes and its tiles (pairs of blocks) are
multiplied, giving every class its number of links; a component of any size is
spread over its tiles, and only counts leave a task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, saved
from .components import bucket_links, components
from .registry import query
from .textcodes import U64, mix64

MISS = 1e-6
MARGIN_BITS = 6
TILE = 2048
SEED = 20240


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) + MARGIN_BITS)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)     # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the rest) of unit rows."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    rest = np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    return q.astype(np.int8), scale, rest


def possible(a, b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two quantised blocks that may reach the threshold (tile product)."""
    (qa, sa, ra), (qb, sb, rb) = a, b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64     # whole numbers stay exact
    tile = (qa.astype(kind) @ qb.astype(kind).T) * sa[:, None] * sb[None, :]
    return np.nonzero(tile + ra[:, None] + (1 + ra[:, None]) * rb[None, :] >= threshold - 1e-9)


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1)


def _by_length(batch, at: int):
    """Sub-batches of vectors of one length."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = pc.list_value_length(batch.column(at))
    for d in pc.unique(n).to_pylist():
        yield batch.filter(pc.equal(n, pa.scalar(d, n.type)))


def _keys(bits: int, tables: int):
    def run(batches):
        """(id, v) -> id, key: one row per table"""
        import pyarrow as pa

        planes: dict[int, np.ndarray] = {}
        weight = U64(1) << np.arange(bits, dtype=U64)
        for batch in batches:
            for part in _by_length(batch, 1):
                for at in range(0, len(part), 1000):
                    rows = part.slice(at, 1000)
                    u = unit(_matrix(rows.column(1)))
                    d = u.shape[1]
                    if d not in planes:
                        planes[d] = np.random.default_rng(SEED + d).standard_normal((d, bits * tables))
                    sign = (u @ planes[d] >= 0).reshape(len(u), tables, bits)
                    code = (sign * weight).sum(axis=2, dtype=U64)
                    key = mix64(mix64(code + U64(d)) + np.arange(1, tables + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
                    ids = rows.column(0).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, tables)), pa.array(key.ravel().view(np.int64))], ["id", "key"])
    return run


def _pair_check(threshold: float):
    def run(batches):
        """(a, b, va, vb) -> the pairs at the threshold or above"""
        for batch in batches:
            for part in _by_length(batch, 2):
                ua, ub = unit(_matrix(part.column(2))), unit(_matrix(part.column(3)))
                (qa, sa, ra), (qb, sb, rb) = quantise(ua), quantise(ub)
                near = (qa.astype(np.int32) * qb).sum(axis=1) * sa * sb + ra + (1 + ra) * rb >= threshold - 1e-9
                at = np.flatnonzero(near)
                at = at[(ua[at] * ub[at]).sum(axis=1) >= threshold]
                yield part.take(_index(at)).select([0, 1])
    return run


def _index(at: np.ndarray):
    import pyarrow as pa
    return pa.array(at, pa.int64())


def _tile_counts(threshold: float):
    def run(batches):
        """(comp, i, j, side, id, n, v), sorted by tile and side -> id, links (partial sums)"""
        import pyarrow as pa

        held: list = []
        tile = None

        def count():
            t = pa.Table.from_batches(held)
            side, n = t["side"].to_numpy(), t["n"].to_numpy().astype(np.float64)
            u = unit(_matrix(t["v"]))
            ids, q = t["id"].to_numpy(), quantise(u)
            a = np.flatnonzero(side == 0)
            b = np.flatnonzero(side == 1) if tile[1] != tile[2] else a
            got = np.zeros(len(u))
            for lo in range(0, len(a), 512):
                rows = a[lo:lo + 512]
                x, y = possible([z[rows] for z in q], [z[b] for z in q], threshold)
                x, y = rows[x], b[y]
                for k in range(0, len(x), 1 << 16):
                    xs, ys = x[k:k + (1 << 16)], y[k:k + (1 << 16)]
                    ok = (u[xs] * u[ys]).sum(axis=1) >= threshold
                    if tile[1] == tile[2]:
                        ok &= xs != ys
                    xs, ys = xs[ok], ys[ok]
                    got += np.bincount(xs, n[ys], len(u))
                    if tile[1] != tile[2]:
                        got += np.bincount(ys, n[xs], len(u))
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(got.astype(np.int64))], ["id", "links"])

        for batch in batches:
            c, i, j = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cut = np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(c)]):
                here = (c[lo], i[lo], j[lo])
                if held and here != tile:
                    yield count()
                    held = []
                tile = here
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield count()
    return run


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                         threshold: float = 0.95, miss: float = MISS) -> DataFrame:
    """One row per vector: (id_col, n_links, component_id, kept).

    Vectors that are null, empty, zero or hold null or non-finite parts, and vectors of
    another length, link with nothing.  Rows that repeat an id are one vector (the
    smallest of theirs) and give one row; rows with a null id have no links, a null
    component and are kept.  An empty table gives no rows."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    named = saved(v.where("id is not null").groupBy("id").agg(F.min("v").alias("v")))
    sound = (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(x.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False))) \
        & F.exists("v", lambda x: x != 0)
    classes = saved(named.where(F.coalesce(sound, F.lit(False))).groupBy("v")
                    .agg(F.min("id").alias("id"), F.count("*").alias("n")))
    of_class = saved(named.join(classes.select("v", F.col("id").alias("rep"), "n"), "v").select("id", "rep", "n"))
    bits, tables = plan_tables(classes.count(), threshold, miss)
    bucket = classes.select("id", "v").mapInArrow(_keys(bits, tables), "id long, key long")

    def check(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("id").alias(x), F.col("v").alias(f"v{x}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb")
        return saved(both.mapInArrow(_pair_check(threshold), "a long, b long"))

    comp = components(bucket_links(bucket, ["key"], check))
    blocks = comp.groupBy("component").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    placed = (comp.join(blocks, "component").join(classes, "id")
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    tiles = (placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "n", "v"))
    counts = (tiles.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side", "id")
              .mapInArrow(_tile_counts(threshold), "id long, links long")
              .groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")))
    per_class = counts.join(comp.select(F.col("id").alias("rep"), "component"), "rep")
    known = (of_class.join(per_class, "rep", "left")
             .select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = named.select("id").join(known, "id", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    out = out.union(v.where("id is null").select("id", F.lit(0).cast("long"), F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


@query("op5_embed_dup")
def op5_embed_dup(spark, sf_dir):
    """Links and components of all embeddings at cosine 0.95."""
    return embedding_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
