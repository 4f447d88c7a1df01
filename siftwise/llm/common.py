"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, ensure_checkpoint_dir  # noqa: F401

# Fixed values of the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table with only ``columns`` (pruned at the scan)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder: later steps read
    those files, so a lost executor costs no more than the tasks it was running."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """The driver's garbage collected now, between two steps.  Spark drops shuffle files, broadcasts and checkpoints
    when the driver collects what referred to them, and a heap that is never collected fills up to its limit."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a one-element transform binds it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACES), "")


def n_words(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (compared without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def worker_state() -> types.ModuleType:
    """Memo that lives as long as a Python worker (tokenizers, tables): functions are
    shipped by value, so their own globals last for one task only."""
    return sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))


def worker_memo(name: str | None, make=None):
    """What the Python worker keeps under ``name`` (made when it is not there).  A worker keeps the
    memo of one operator: those of others go, and what they held is given back to the
    system, so a job of many stages needs no more memory than its largest."""
    memo = worker_state().__dict__
    if name is None or name not in memo:
        for k in [k for k in memo if not k.startswith("__")]:
            del memo[k]
        give_back()
        if name is not None:
            memo[name] = make()
    return memo.get(name)


def tidied(run):
    """A function of a task's batches that gives unused memory back when the task ends."""
    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return to_the_end


def give_back() -> None:
    """Unused memory of this process to the system: Arrow's pool, and the allocator's where it is glibc's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
