"""Query registry, table access and the domain views over the driver's tables.

A domain view (a "stand-in") is one SQL text for two dialects: Spark runs it as
a DataFrame, the check runs it as a common table expression. Views read whole
tables; they only rename, retype and derive columns.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
FAMILIES = "durations functions_ verdicts ledger filters joins series retrieval reuse lineage sources streaming".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, Callable[["Dialect"], str]] = {}


class Dialect:
    """The few spellings in which the two SQL engines differ."""

    def __init__(self, spark: bool):
        self.spark = spark
        self.used: list[str] = []

    def t(self, name: str) -> str:
        self.used.append(name)
        return "{" + name + "}" if self.spark else name

    def us(self, col: str) -> str:
        return f"unix_micros(cast({col} as timestamp))" if self.spark else f"epoch_us({col})"

    def day(self, col: str) -> str:
        """Days since 1995-01-01 as a long."""
        if self.spark:
            return f"cast(datediff(cast({col} as date), date'1995-01-01') as bigint)"
        return f"cast(date_diff('day', timestamp '1995-01-01', {col}) as bigint)"

    def sha(self, col: str) -> str:
        return f"sha2({col}, 256)" if self.spark else f"sha256({col})"

    def div(self, a: str, b: str) -> str:
        return f"cast(floor(({a}) / ({b})) as bigint)"

    def json_int(self, col: str, key: str) -> str:
        if self.spark:
            return f"cast(get_json_object({col}, '$.{key}') as bigint)"
        return f"cast(json_extract_string({col}, '$.{key}') as bigint)"

    def seconds(self, ts: str, n: str) -> str:
        """``ts`` moved by ``n`` seconds."""
        if self.spark:
            return f"({ts} + make_dt_interval(0, 0, 0, {n}))"
        return f"({ts} + to_seconds(cast({n} as bigint)))"


def view(make: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    VIEWS[make.__name__] = make
    return make


class Tables:
    """Lazy access to base tables and domain views by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in VIEWS:
                words = Dialect(spark=True)
                text = VIEWS[name](words)
                self._known[name] = self.spark.sql(text, **{n: getattr(self, n) for n in set(words.used)})
            elif name in BASE:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._known[name]


def _with_views(sql: str) -> str:
    """Prefix the domain views the text names, in dependency order."""
    placed: dict[str, str] = {}

    def place(name: str) -> None:
        if name in placed:
            return
        words = Dialect(spark=False)
        text = VIEWS[name](words)
        for other in words.used:
            if other in VIEWS:
                place(other)
        placed[name] = text

    for word in re.findall(r"\b[a-z_0-9]+\b", sql):
        if word in VIEWS:
            place(word)
    body = sql.strip()
    head = [f"{n} AS ({t})" for n, t in placed.items()]
    match = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", body)
    if match:
        head.append(body[match.end():])
        return "WITH RECURSIVE " + ",\n".join(head)
    return ("WITH " + ",\n".join(head) + "\n" if head else "") + body


def query(name: str, sql: str | None = None):
    """Register a query body ``(tables) -> DataFrame`` and, if given, its SQL check."""

    def add(body: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: body(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return body

    return add


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"cutlake.plans.{family}")


def oracle_texts() -> dict[str, str]:
    return {name: _with_views(sql) for name, sql in ORACLES.items()}
