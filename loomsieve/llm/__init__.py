"""Operators for training corpora: near-duplicate removal, language, packing, tokens, sharding, toxicity and personal data.

Each module holds one operator with its own interface and one thin ``opN_`` query over the test tables.
"""

from __future__ import annotations

from collections.abc import Callable

from loomsieve.llm import bpe, langid, lexical, neardup, packing, pii, sharding, sketches, suffixes, toxicity, variants, vectors, warc

_MODULES = (neardup, langid, packing, suffixes, sketches, bpe, sharding, toxicity, vectors, pii, variants, warc, lexical)


def queries() -> dict[str, Callable]:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
