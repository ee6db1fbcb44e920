"""Registry of runnable queries: name -> (Spark function, SQL for the check or None)."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its checking SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all():
    from jobflow.plans import (  # noqa: F401 (each module registers its queries)
        queries_dedup, queries_filters, queries_names, queries_output, queries_pages,
        queries_registry, queries_scoring, queries_searches, queries_sources, queries_text,
    )

    return QUERIES, ORACLES
