"""Runnable plans: the operators applied to the logical tables."""


def load_all():
    """Import every plan module; importing registers its queries."""
    import importlib

    for name in ("scalars", "records", "votes", "calendar", "text", "changes", "rates", "sources", "state_b", "streams"):
        importlib.import_module(f"civicmill.plans.{name}")
    from civicmill.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
