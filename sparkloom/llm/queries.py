"""The operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, exact_dedup, licenses, minhash, mixing, packing, quality, secrets, sharding, tokens

_ALL = (sharding, minhash, chat, exact_dedup, secrets, packing, quality, licenses, mixing, tokens)


def queries() -> dict:
    return {k: f for m in _ALL for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _ALL for k, s in m.ORACLE.items()}
