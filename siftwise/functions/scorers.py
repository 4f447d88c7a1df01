"""Batch scorers for the L13 seam (prompts -> raw responses).

A scorer is a plain function ``list[str] -> list[str]`` shipped to Python
workers; it must live outside ``siftwise.plans`` so workers import nothing
but the function's own module.
"""

from __future__ import annotations


def length_parity_scorer(prompts: list[str]) -> list[str]:
    """Deterministic stand-in for a language model: a valid contract response
    whose label is the prompt length modulo 2."""
    return ['{"reasoning": "stub", "label": %d}' % (len(p) % 2) for p in prompts]
