"""Registered queries over the supplied tables (``QUERIES``) and their SQL oracles (``ORACLE``)."""

from . import q_ensembles, q_labels, q_ml, q_models, q_stream, q_text, q_votes  # noqa: F401  (registration side effects)
from .registry import ORACLE, QUERIES, query  # noqa: F401
