"""Connected components of a link table, as joins and aggregations (no graph on the driver).

Each round every vertex points to the smallest among itself and its neighbours, by jumps to
the root of its pointers, and the links are contracted: both ends are replaced by their
roots, and links that become loops or repeats go.  A round thus sees only what the one
before left open, and a chain of n links needs about log n jumps.  Pointers and
contracted links are kept in the shared checkpoint folder.  The joins are dealt by key
(``merged``): one round's pointers are few enough to be broadcast, but those of all
rounds would pass through the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, swept


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, however few rows it has."""
    return df.hint("merge")


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """``links`` (pairs of ids) -> one row per linked id: (id, component), component its
    smallest reachable id.  Pairs may repeat, in either direction.

    Pointers are combined before the shuffle (``min`` per vertex), so a vertex with very
    many links costs one row per task."""
    ends = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
    left = saved(links.where(F.col(src) != F.col(dst)).select(*ends(src, dst)).distinct())
    labels = None
    while True:
        both = left.union(left.select("v", "u"))
        points = saved(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("id"), F.min("v")).alias("component")))
        while True:                                       # to the roots: each jump doubles what is skipped
            ahead = points.select(F.col("id").alias("component"), F.col("component").alias("further"))
            jumped = saved(points.join(merged(ahead), "component").select("id", F.col("further").alias("component"), F.col("component").alias("was")))
            points = jumped.select("id", "component")
            if not jumped.where("component <> was").limit(1).count():
                break
        if labels is None:
            labels = points
        else:                                             # what the rounds before point to, one step further
            on = points.select(F.col("id").alias("component"), F.col("component").alias("further"))
            labels = saved(labels.join(merged(on), "component", "left").select("id", F.coalesce("further", "component").alias("component")))
        at = lambda end, to: points.select(F.col("id").alias(end), F.col("component").alias(to))
        left = saved(left.join(merged(at("u", "pu")), "u").join(merged(at("v", "pv")), "v").where("pu <> pv").select(*ends("pu", "pv")).distinct())
        swept(left.sparkSession)
        if not left.limit(1).count():
            return labels


def bucket_links(bucket: DataFrame, keys: list[str], check, rounds: int = 2, finish=None) -> DataFrame:
    """``bucket(id, *keys)``: ids and the buckets they lie in -> links (a, b) whose components
    are those of all pairs within buckets that ``check`` accepts.

    ``check(pairs(a, b))`` returns the accepted pairs, a < b.  A bucket's pairs are not all
    looked at.  In each round every bucket has a leader, the id that meets most others over
    all its buckets (a text in the middle of its copies meets more than they do one another),
    and the others are checked against it; what is accepted joins components, and the next
    round's leaders are taken from outside the last leader's component.  At last, in
    buckets that still hold several components, ids outside the leader's component are checked
    against all ids of other components.  A pair that shares a bucket is thus checked or
    already in one component.

    Where many ids of a bucket are similar but not linked, these last pairs grow with the
    square of the bucket.  ``finish(clusters(id, comp, cluster))`` may then compare them in
    blocks without making rows of them; a cluster is what the open buckets connect."""
    sizes = bucket.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    members = bucket.join(merged(sizes), keys)
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = saved(members.join(merged(weight), "id").select(*keys, "id", "weight", F.col("id").alias("comp")))
    lead_of = lambda df: df.groupBy(*keys).agg(F.max(F.struct("weight", (-F.col("id")).alias("neg"), "comp")).alias("l")).select(
        *keys, (-F.col("l.neg")).alias("lead"), F.col("l.comp").alias("lc"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    checked = links = None
    outside = members
    for _ in range(rounds):
        led = members.join(merged(lead_of(outside)), keys)
        star = led.where("id <> lead and comp <> lc").select(*pair("id", "lead")).distinct()
        if checked is not None:
            star = star.join(merged(checked), ["a", "b"], "left_anti")
        star = saved(star)
        checked = star if checked is None else checked.union(star)
        found = check(star)
        links = found if links is None else links.union(found)
        comp = components(links)
        now = members.drop("comp").join(merged(comp), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        members = saved(now)
        outside = saved(members.join(merged(lead_of(members)), keys).where("comp <> lc").drop("lead", "lc"))
        swept(members.sparkSession)
    if finish is not None:
        open_buckets = outside.groupBy(*keys).agg(F.min("id").alias("hub"))
        held = members.join(merged(open_buckets), keys)
        cluster = components(held.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
        comp = members.select("id", "comp").distinct()
        return links.union(finish(cluster.withColumnRenamed("component", "cluster").join(merged(comp), "id")))
    other = (outside.select(*keys, F.col("id").alias("x"), F.col("comp").alias("cx"))
             .join(merged(members.select(*keys, F.col("id").alias("y"), F.col("comp").alias("cy"))), keys)
             .where("cx <> cy").select(*pair("x", "y")).distinct().join(merged(checked), ["a", "b"], "left_anti"))
    return links.union(check(other))
