"""Registry of queries: a Spark callable per operator plus, where SQL can say it, an independent ANSI statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.session import widen

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Tables whose rows are expensive to work on (whole texts).
TEXT_TABLES = ("documents", "pages", "conversations")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """Lazy parquet readers for one scale-factor folder: ``t.documents`` reads documents.parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def files(self, name: str) -> DataFrame:
        """The table as it is stored, for what is asked of its files."""
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return widen(df) if name in TEXT_TABLES else df


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return register


def all_queries():
    return dict(_QUERIES)


def all_sql():
    return dict(_SQL)
