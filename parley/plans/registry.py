"""Registration of queries: a DataFrame plan and, where SQL can say it, independent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import needed, view, with_views
from ..sources import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The day that counts as today in registered queries.
TODAY = "2024-01-17"
#: Stand-in tables that fold others.
FOLDED = ("meetings", "stored_documents")


class Tables:
    """Stand-in tables by attribute. Where a query uses its folded tables several times (stored), each is written once to the
    shared folder and read from there."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        self.spark, self.sf_dir, self._stored, self._held = spark, sf_dir, stored, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        folded = {n: getattr(self, n) for n in needed(name) if n in FOLDED} if self._stored else {}
        make = lambda: view(self.spark, self.sf_dir, name, folded)
        return self.once(name, make) if name in FOLDED else make()

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives; of a stored query, written and read back when it is first asked for."""
        if not self._stored:
            return make()
        if name not in self._held:
            self._held[name] = feeds.kept(make(), name)
        return self._held[name]

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, stored: bool = False):
    """Register a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir, stored))
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add
