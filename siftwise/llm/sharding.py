"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, DataFrame functions only.

Every shard has ``VNODES`` points on a ring of ``RING`` places; a row's key (its text,
so copies travel together) hashes to a place and belongs to the next shard point
clockwise.  No shard takes more than its bound: what overflows a full shard
continues clockwise to the next point whose shard has room.  With slack 0 the
bounds add up to the number of rows, so shard counts are at most one apart; a
larger slack keeps more rows at home and moves fewer when a shard is added.

Only row counts per ring place are needed to settle the overflow: a table of at
most ``RING`` rows, whatever the data, laid round the ring on the driver.  The rows
themselves are ranked within (place, bucket) cells, so a text that holds a third of
all rows is spread over ``ID_BUCKETS`` tasks by its rows' ids; rows that share text and
id (or have none) are ranked in one.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read
from .registry import query

RING = 1 << 14
VNODES = 32
TEXT_BUCKETS, ID_BUCKETS = 8, 16
BUCKETS = TEXT_BUCKETS * ID_BUCKETS
ROW_BYTES = 16        # fixed value of the contract: bytes of a row besides its text

MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """64-bit finalizer (splitmix64): a portable hash of a small whole number."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def ring_owners(shards: int, vnodes: int = VNODES, ring: int = RING) -> list[int]:
    """Shard of every ring place: that of the first point at or after it.  A point
    depends on its shard and number only; where two meet, the lower shard has it."""
    points: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            points.setdefault(_mix(s * 1_000_003 + v) % ring, s)
    owner, at = [0] * ring, points[min(points)]
    for p in range(ring - 1, -1, -1):
        at = points.get(p, at)
        owner[p] = at
    return owner


def settle(counts: dict[int, int], shards: int, slack: float = 0.0, vnodes: int = VNODES, ring: int = RING) -> list[tuple]:
    """``counts`` of rows by ring place -> pieces (place, first rank, shard, first slot).

    Rows of a place with ranks from ``first rank`` (up to the next piece) lie in
    ``shard`` from ``first slot`` on.  Home rows are seated first, place by place;
    the rest walks clockwise, first come first served."""
    owner, total = ring_owners(shards, vnodes, ring), sum(counts.values())
    if slack:
        room = [int(-(-(1 + slack) * total // shards))] * shards
    else:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    used, pieces, rest = [0] * shards, [], {}

    def seat(place: int, first: int, n: int, shard: int) -> int:
        n = min(n, room[shard] - used[shard])
        if n:
            pieces.append((place, first, shard, used[shard]))
            used[shard] += n
        return n

    for place in sorted(counts):
        n = seat(place, 0, counts[place], owner[place])
        if n < counts[place]:
            rest[place] = (n, counts[place] - n)
    walking: deque = deque()
    for step in range(2 * ring if rest else 0):
        place = step % ring
        while walking and used[owner[place]] < room[owner[place]]:
            home, first, n = walking.popleft()
            took = seat(home, first, n, owner[place])
            if took < n:
                walking.appendleft((home, first + took, n - took))
        if place in rest:
            walking.append((place, *rest.pop(place)))
        if not walking and not rest:
            break
    return pieces


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text",
          slack: float = 0.0) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot (gapless within a shard).

    A null text has size ``ROW_BYTES`` and the checksum 0 of no bytes, and shares its
    key with empty texts; null ids and repeated rows are rows of their own (equal
    rows may trade places, which changes nothing); an empty table gives no rows."""
    key = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(key) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(key).alias("text_crc32"),
        F.xxhash64(key).alias("h"),
    ).withColumn("place", F.pmod(F.col("h"), F.lit(RING)).cast("int")).withColumn(
        "bucket", (F.pmod(F.shiftright("h", 32), F.lit(TEXT_BUCKETS)) * ID_BUCKETS
                   + F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS))).cast("int"))
    cells = d.groupBy("place", "bucket").agg(F.count("*").alias("n"))
    counts = {r["place"]: r["n"] for r in cells.groupBy("place").agg(F.sum("n").alias("n")).collect()}  # at most RING rows
    by_place: dict[int, list] = {}
    for place, first, s, slot in settle(counts, shards, slack):
        by_place.setdefault(place, []).append({"f": first, "s": s, "t": slot})
    pieces = [{"p": p, "x": sorted(x, key=lambda y: y["f"])} for p, x in sorted(by_place.items())]
    plan = docs.sparkSession.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps(pieces)), "array<struct<p:int,x:array<struct<f:bigint,s:int,t:bigint>>>>")).alias("e")).select(
        F.col("e.p").alias("place"), F.col("e.x").alias("pieces"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
               .join(F.broadcast(plan), "place").select("place", "bucket", "before", "pieces"))   # at most RING rows are broadcast
    ranked = d.withColumn("rank", F.row_number().over(
        Window.partitionBy("place", "bucket").orderBy("h", "doc_id", "size", "text_crc32")) - 1)
    at = F.col("before") + F.col("rank")
    piece = F.element_at(F.filter("pieces", lambda x: x["f"] <= F.col("at")), -1)
    return (ranked.join(offsets, ["place", "bucket"]).withColumn("at", at).withColumn("piece", piece)
            .select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.col("piece.s").alias("shard"),
                    (F.col("piece.t") + F.col("at") - F.col("piece.f")).alias("slot")))


@query("op4_sharding")
def op4_sharding(spark, sf_dir):
    """All documents in 40 shards whose row counts are at most one apart (law ``rows``)."""
    out = shard(read(spark, sf_dir, "documents", "doc_id", "text"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
