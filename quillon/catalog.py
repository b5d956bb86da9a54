"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon import plans  # noqa: F401  (registers all analyses)
from quillon.registry import REGISTRY

FLAGSHIP = "corpus_fingerprint"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY.analyses)


def oracle_sql() -> dict[str, str]:
    return {n: a.oracle for n, a in REGISTRY.analyses.items() if a.oracle}
