"""All queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomfield.plans import collection, knowledge
from loomfield.plans.fixtures import oracle

TESTS = {**collection.TESTS, **knowledge.TESTS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in TESTS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(statement) for name, (_, statement) in TESTS.items() if statement}
