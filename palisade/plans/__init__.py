"""Skew-safe plan helpers and the registered queries."""

from importlib import import_module

MODULES = [
    "q_parse", "q_query", "q_reports", "q_payload", "q_bruteforce", "q_enrich", "q_alerts", "q_anomaly", "q_stream",
]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"palisade.plans.{name}")
