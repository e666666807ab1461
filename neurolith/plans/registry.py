"""All named queries of the biosignal engine with their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its DuckDB twin if SQL has one."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in ("quality", "features", "epochs", "study", "session", "spectra", "tables", "cleaning", "wavelets", "haemodynamics", "steps", "personal", "optical_study"):
        importlib.import_module(f"neurolith.plans.{name}")
