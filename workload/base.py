"""Registry of the queries that run the operators over the given tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a function of ``Tables`` under ``name``; ``sql`` may use the named SQL views."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            TWINS[name] = with_views(views, sql)
        return build

    return register


class Tables:
    """The given parquet tables of one scale, read on demand, and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        from workload import views

        if hasattr(views, name):
            return getattr(views, name)(self)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def with_views(names: tuple[str, ...], sql: str) -> str:
    from workload import views

    if not names:
        return sql
    needed: list[str] = []

    def add(name: str) -> None:
        for other in views.NEEDS.get(name, ()):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({views.SQL[name]})" for name in needed) + "\n" + sql
