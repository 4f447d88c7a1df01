"""Re-export of :mod:`siftwise.cache` for the query modules."""

from ..cache import clear, memo, persisted  # noqa: F401
