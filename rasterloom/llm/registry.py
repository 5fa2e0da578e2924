"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from rasterloom.llm import chat, decontaminate, divergence, embeddings, langid, mixing, near_dup, quality, resampling, sharding, token_files, tokens, warc
from rasterloom.llm.common import clear

__all__ = ["clear", "oracle_sql", "queries"]
_MODULES = (warc, sharding, langid, embeddings, decontaminate, tokens, near_dup, quality, chat, mixing, divergence, token_files, resampling)


def queries() -> dict:
    return {name: getattr(m, name) for m in _MODULES for name in dir(m) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
