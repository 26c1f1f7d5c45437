"""Loads every operator of this subpackage and so registers its query."""

from __future__ import annotations

from eventloom.llm import completion, embeddings, fingerprints, html, langid, licenses, minhash, mixing, negatives, packing, pii, toxicity, whitening  # noqa: F401
from eventloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
