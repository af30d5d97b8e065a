"""Named queries, the views they read, and their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowline.session import cut_lineage
from stowline.workload.views import BASE_TABLES, ORACLE_VIEWS, SPARK_VIEWS, VIEWS

Query = Callable[["Tables"], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_NAME = re.compile(r"\b[vo]_[a-z_0-9]+\b")
_SLOT = re.compile(r"\{([a-z_]\w*)\}")


class Tables:
    """Base tables and views of one data folder, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}
        self._stored: set[str] = set()
        self.shared: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in BASE_TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(SPARK_VIEWS.get(name, VIEWS[name]))
        return self._made[name]

    def stored(self, name: str) -> DataFrame:
        """The view as a table of the shared folder, as a catalog table would be; for queries that read it often."""
        if name not in self._stored:
            self._made[name] = cut_lineage(self(name))
            self._stored.add(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which ``{name}`` stands for a table or view."""
        names = set(_SLOT.findall(text))
        return self.spark.sql(text, **{n: self(n) for n in names})


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def oracle_text(sql: str) -> str:
    """Prefix the SQL with the views it names, in dependency order."""
    every = {**VIEWS, **ORACLE_VIEWS}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in every:
            return
        for other in _NAME.findall(every[name]):
            if other != name:
                visit(other)
        ordered.append(name)

    for name in _NAME.findall(sql):
        visit(name)
    plain = [f"{n} AS ({_SLOT.sub(r'\1', every[n]).strip()})" for n in ordered]
    body = _SLOT.sub(r"\1", sql).strip()
    if not plain:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(plain)},\n{body.removeprefix('WITH RECURSIVE ')}"
    if body.startswith("WITH "):
        return f"WITH {', '.join(plain)},\n{body.removeprefix('WITH ')}"
    return f"WITH {', '.join(plain)}\n{body}"
