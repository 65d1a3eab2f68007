"""The queries of the training-data operators and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules in order of the operators' numbers.
MODULES = ("topk", "langid", "suffix_dedup", "lattice_lm", "token_files", "url_filters", "simhash", "sentence_spans", "decontaminate", "bpe", "merkle", "secrets", "spelling")


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").ORACLES.items()}
