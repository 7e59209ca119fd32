"""Named queries over the given tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import half_even

_LARGEST_METHOD = "spark.sql.codegen.hugeMethodLimit"
RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_STATED: dict[str, tuple[str, tuple[str, ...]]] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *needs: str) -> None:
    CTES[name] = (needs, text)


def _closure(names, seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _closure(CTES[n][0], seen)
            seen.append(n)
    return seen


def _long_counts(text: str) -> str:
    """count_if is wider than a BIGINT in the SQL engine: state its type."""
    out, at = "", 0
    while (hit := text.find("count_if(", at)) >= 0:
        depth, end = 1, hit + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        if text[end:].lstrip().startswith("OVER"):
            out += text[at:end]
        else:
            out += text[at:hit] + "CAST(" + text[hit:end] + " AS BIGINT)"
        at = end
    return out + text[at:]


def sql_text(body: str, *needs: str) -> str:
    parts = [f"{n} AS ({CTES[n][1]})" for n in _closure(needs, [])]
    return _long_counts(("WITH " + ", ".join(parts) + " " if parts else "") + body)


def query(name: str, sql: str | None = None, *needs: str):
    def add(fn):
        RUN[name] = fn
        if sql is not None:
            _STATED[name] = (sql, needs)
        return fn
    return add


def resolve() -> None:
    """Fill SQL once every named part is known."""
    SQL.update({name: sql_text(body, *needs) for name, (body, needs) in _STATED.items()})


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns of a result."""
    return df.select(*[
        half_even(n, digits).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round_even({c}, {digits}) AS {c}" for c in cols)


@dataclass
class Tables:
    """Reads the parquet tables of one folder."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        # HotSpot compiles no method above 8 000 bytes: without this limit the long rules of a gate would be interpreted, row by row.
        if self.spark.conf.get(_LARGEST_METHOD) == "65535":
            self.spark.conf.set(_LARGEST_METHOD, "8000")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
