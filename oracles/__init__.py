"""Equivalent SQL of the registered queries, for comparison on another engine."""

from __future__ import annotations


def oracle_queries() -> dict[str, str]:
    from oracles import raw, typed

    return {**typed.QUERIES, **raw.QUERIES}
