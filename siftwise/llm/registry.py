"""Queries of this subpackage: name -> builder, and the oracles that SQL can express."""

from __future__ import annotations

import functools

from ..session import ensure_checkpoint_dir
from .common import bounded_batches

LLM_QUERIES: dict = {}
LLM_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ensure_checkpoint_dir(spark)
            bounded_batches(spark)
            return fn(spark, sf_dir.rstrip("/"))

        LLM_QUERIES[name] = run
        if sql is not None:
            LLM_ORACLE[name] = sql
        return fn
    return deco
