"""Registry of queries (spark, sf_dir) -> DataFrame and their DuckDB oracle SQL."""
from __future__ import annotations

import warnings
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    from . import q_text, q_features, q_vectors, q_windows, q_metrics, q_sources, q_relational, q_ml, q_pipelines, q_sweeps  # noqa: F401


def queries() -> dict[str, Callable]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of every oracle.  One that can't be built is left out with a warning, so that it never
    hides the others."""
    load_all()
    out = {}
    for name, sql in ORACLES.items():
        try:
            out[name] = sql() if callable(sql) else sql
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"no oracle for {name}: {e!r}", stacklevel=2)
    return out
