"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the DuckDB SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# ---- SQL fragments -----------------------------------------------------------------------------------------


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_order(key: str, salt: str) -> str:
    return f"md5('{salt}:' || ({key}))"


def sql_hash(key: str, salt: str) -> str:
    return f"('0x' || substr({sql_order(key, salt)}, 1, 8))::BIGINT"


def sql_hash60(key: str, salt: str) -> str:
    return f"('0x' || substr({sql_order(key, salt)}, 1, 15))::BIGINT"


def sql_pick(key: str, salt: str, values: list[str]) -> str:
    return f"({sql_list(values)})[({sql_hash(key, salt)} % {len(values)} + 1)::INT]"


def sql_strip(text: str) -> str:
    """Strip ASCII blanks from both ends."""
    return rf"regexp_replace(regexp_replace({text}, '\A[ \t\n\r\f]+', ''), '[ \t\n\r\f]+\z', '')"
