"""Registry of the queries: name -> (Spark callable, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.workload.standin import Tables, standin_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Added before rounding on both sides, so that exact halves round the same way everywhere.
NUDGE = 3.0e-10


def _nudged(sql: str) -> str:
    """``round(x, n)`` becomes ``round((x) + NUDGE, n) + 0e0``; write ROUND to keep a call as it is."""
    out, i = "", 0
    while (j := sql.find("round(", i)) >= 0:
        if j and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out, i = out + sql[i : j + 6], j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6 : k - 1]
        body, digits = inner.rsplit(",", 1)
        out += sql[i:j] + f"(ROUND(({_nudged(body)}) + 3e-10,{digits}) + 0e0)"
        i = k
    return out + sql[i:]


def query(name: str, uses: tuple[str, ...] = (), sql: str | None = None):
    """Register a function of ``Tables`` under a name, with SQL over the named projections."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            body = _nudged(sql.strip())
            own = body[5:] if body[:5].upper() == "WITH " else None
            heads = [f"{u} AS ({standin_sql(u)})" for u in uses]
            if own is not None:
                ORACLES[name] = "WITH " + ", ".join([*heads, own]) if heads else body
            else:
                ORACLES[name] = ("WITH " + ", ".join(heads) + " " if heads else "") + body
        return fn

    return register


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded double for comparison, without a negative zero."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c + NUDGE, digits) + F.lit(0.0)


def day(value: Column | str) -> Column:
    """Date as text."""
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def joined(value: Column | str, sep: str = ",") -> Column:
    return F.array_join(F.col(value) if isinstance(value, str) else value, sep)
