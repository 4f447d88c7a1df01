"""Per-application memo of persisted intermediates shared by several queries.

A derived table that many queries read (the votes, the pool TF-IDF) is built
once per Spark application and persisted (memory, then disk; Spark recomputes
lost blocks from lineage).  Queries reuse the same DataFrame object rather than
relying on plan matching, which misses when a plan holds scalar subqueries.
"""

from __future__ import annotations

from pyspark import StorageLevel

_MEMO: dict = {}


def _session_key(spark) -> tuple:
    return (spark.sparkContext.applicationId, id(spark))


def memo(spark, key: tuple, build):
    k = _session_key(spark) + key
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]


def persisted(df):
    """Persist and materialize now: several branches of a later plan (broadcast
    builds, scalar subqueries) may read the frame at the same time, and a lazily
    persisted frame would be computed by each of them before the cache is filled."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def clear(spark=None) -> None:
    """Unpersist and forget the memoized intermediates (of one application, or all)."""
    sk = _session_key(spark) if spark is not None else None
    for k in [k for k in _MEMO if sk is None or k[:2] == sk]:
        v = _MEMO.pop(k)
        for df in (v if isinstance(v, tuple) else (v,)):
            if hasattr(df, "unpersist"):
                df.unpersist()
