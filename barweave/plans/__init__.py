"""Registered queries over the stored tables."""


def all_queries():
    from . import basics, indicator_queries, job_queries, position_queries, registry, signal_queries, stream_queries, whatif_queries  # noqa: F401
    return registry
