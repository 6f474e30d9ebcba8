"""Named queries over the test tables, each with its SQL counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, so that both engines print the same number."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def joined(column: str) -> Column:
    """An array of names as one text."""
    return F.array_join(column, ",").alias(column)


# The cohort: one row per customer, owned by the region it lives in.
COHORT_SQL = """(SELECT c.c_custkey, c.c_name, c.c_acctbal, c.c_mktsegment, n.n_name, r.r_name
 FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
 JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
        .select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name", "r_name")
    )


def md5_order_sql(expr: str) -> str:
    """The md5 order key of functions.keys in SQL."""
    u = f"(('0x' || substr(md5({expr}), 1, 16))::UBIGINT)::HUGEINT"
    return f"abs(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END)"


def kfold_sql(key: str, k: int, seed: float = 0.67) -> str:
    order = md5_order_sql(f"'{seed}:' || CAST({key} AS VARCHAR)")
    return f"CAST(ntile({k}) OVER (ORDER BY {order}, {key}) AS INTEGER)"


def _load() -> None:
    from cohortlens.queries import edges, factors, folds, merged, models, relational, statistics, stores  # noqa: F401


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
