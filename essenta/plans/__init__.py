"""Whole jobs put together from operators, and the registered queries."""

from importlib import import_module

_QUERY_MODULES = (
    "q_sources", "q_filters", "q_joins", "q_aggregates", "q_ranking", "q_topk", "q_functions",
    "q_statistics", "q_models", "q_exact_models", "q_scores", "q_graph", "q_cells",
)


def load_queries() -> None:
    """Import the modules that register queries."""
    for name in _QUERY_MODULES:
        import_module(f"essenta.plans.{name}")
