"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carillon.plans import catalog, changes, documents, evaluation, files, ingest, nested, series, similar, streams, texts

MODULES = (nested, catalog, similar, series, evaluation, texts, changes, documents, files, ingest, streams)
FLAGSHIP = "sim_topk"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        clash = out.keys() & m.QUERIES.keys()
        if clash:
            raise ValueError(f"named twice: {sorted(clash)}")
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
