"""Query registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from epispan.session import configure

MODULES = ("cohort", "covariate", "statistic", "matching", "estimation", "files")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]
    module: str


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the operator numbers of the survey."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        module = fn.__module__.rsplit(".", 1)[-1]
        REGISTRY[name] = Query(name, run, sql, tuple(covers.split()), module)
        return fn

    return register


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"epispan.registry.{module}")
    return REGISTRY
