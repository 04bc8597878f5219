"""tidewright: a Spark-native engine for ranking catalogs of agent capabilities
and for analysing how those capabilities are used."""

from importlib import import_module

__version__ = "0.2.0"
_HOMES = {"PLANS": "tidewright.plans", "reach": "tidewright.workers", "register": "tidewright.sql", "views": "tidewright.sql"}
__all__ = ["PLANS", "functions", "operators", "plans", "reach", "register", "sources", "streaming", "views"]


def __getattr__(name: str):
    """Parts are imported when they are asked for, so that workers import what they run only."""
    if name in _HOMES:
        return getattr(import_module(_HOMES[name]), name)
    if name in __all__:
        return import_module(f"tidewright.{name}")
    raise AttributeError(f"module 'tidewright' has no attribute {name!r}")
