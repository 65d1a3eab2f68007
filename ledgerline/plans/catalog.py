"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules that register queries, in order.
MODULES: tuple[str, ...] = (
    "ledgerline.operators.lexical",
    "ledgerline.operators.segments",
    "ledgerline.operators.metrics",
    "ledgerline.operators.dense",
    "ledgerline.operators.vector_blocks",
    "ledgerline.operators.fusion",
    "ledgerline.operators.dictionary",
    "ledgerline.operators.conditions",
    "ledgerline.operators.corpus",
    "ledgerline.operators.chunking",
    "ledgerline.operators.spans",
    "ledgerline.operators.answers",
    "ledgerline.operators.pools",
    "ledgerline.operators.conversations",
    "ledgerline.operators.external",
    "ledgerline.operators.review",
    "ledgerline.operators.views",
    "ledgerline.operators.reports",
    "ledgerline.streaming.limits",
    "ledgerline.plans.retrieval",
    "ledgerline.plans.answering",
)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in import_module(m).QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(m).ORACLES.items()}
