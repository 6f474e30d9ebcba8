"""Folds, partitions and extended tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.model import Rule
from cohortlens.operators import folds, joins
from cohortlens.queries import kfold_sql, md5_order_sql, query, rounded, table


@query("kfold_split", f"""
SELECT o_orderkey, {kfold_sql('o_orderkey', 5)} AS _win_kfold_5 FROM orders WHERE o_totalprice >= 50000""")
def kfold_split(spark, d):
    out = folds.kfold_split(table(spark, d, "orders"), "o_orderkey", 5,
                            rule=Rule("o_totalprice", "greaterOrEqual", ("50000",)))
    return out.select("o_orderkey", "_win_kfold_5")


@query("seeded_random_column", f"""
SELECT c_custkey, round(CAST({md5_order_sql("'0.67:' || CAST(c_custkey AS VARCHAR)")} >> 10 AS DOUBLE)
  / 9007199254740992.0, 9) AS _rnd FROM customer""")
def seeded_random_column(spark, d):
    return rounded(joins.with_rnd(table(spark, d, "customer"), "c_custkey").select("c_custkey", "_rnd"), 9)


def _tile_query(order: str, key: str, source: str, k: int) -> str:
    return f"SELECT *, ntile({k}) OVER (ORDER BY {order}, {key}) AS w FROM {source}"


@query("leave_out_string", f"""
SELECT c_name, c_acctbal FROM ({_tile_query(md5_order_sql('c_name'), 'c_name',
  '(SELECT * FROM customer WHERE c_acctbal >= 0)', 10)}) WHERE w <> 3""")
def leave_out_string(spark, d):
    return folds.leave_out(table(spark, d, "customer"), 10, 2, "c_name",
                           rule=Rule("c_acctbal", "greaterOrEqual", ("0",))).select("c_name", "c_acctbal")


def _feistel_sql(key: str) -> str:
    """pseudo_encrypt in SQL: three rounds over (left, right) halves."""
    left, right = f"(({key} >> 16) & 65535)", f"({key} & 65535)"
    source = f"SELECT *, {left} AS l0, {right} AS r0 FROM customer"
    for i in range(3):
        mixed = f"CAST(round(((1366 * r{i} + 150889) % 714025) / 714025.0::DOUBLE * 32767) AS BIGINT)"
        source = f"SELECT *, r{i} AS l{i + 1}, xor(l{i}, {mixed}) AS r{i + 1} FROM ({source})"
    return f"""SELECT *, CASE WHEN (r3 << 16) + l3 >= 2147483648 THEN (r3 << 16) + l3 - 4294967296
      ELSE (r3 << 16) + l3 END AS enc FROM ({source})"""


@query("leave_out_int", f"""
SELECT c_custkey, CAST(w AS INTEGER) AS _window_ FROM ({_tile_query('enc', 'c_custkey', '(' + _feistel_sql('c_custkey') + ')', 7)})
WHERE w <> 1""")
def leave_out_int(spark, d):
    return folds.leave_out(table(spark, d, "customer"), 7, 0, "c_custkey", keep_window=True).select("c_custkey", "_window_")


@query("leave_out_random", f"""
SELECT c_custkey FROM ({_tile_query(md5_order_sql("'0.5:' || CAST(c_custkey AS VARCHAR)"), 'c_custkey', 'customer', 4)}) WHERE w <> 4""")
def leave_out_random(spark, d):
    return folds.leave_out(table(spark, d, "customer"), 4, 3, "c_custkey", order="random", seed=0.5).select("c_custkey")


@query("fold_sizes", """
WITH n AS (SELECT count(*) AS n FROM orders),
f AS (SELECT i AS fold, n // 7 + CASE WHEN i <= n % 7 THEN 1 ELSE 0 END AS n_test, n FROM n, range(1, 8) t(i))
SELECT CAST(fold AS INTEGER) AS fold, CAST(n_test AS BIGINT) AS n_test, CAST(n - n_test AS BIGINT) AS n_train,
  n_test > 0 AS valid FROM f""")
def fold_sizes(spark, d):
    split = folds.kfold_split(table(spark, d, "orders"), "o_orderkey", 7)
    return folds.validate_folds(split, folds.split_column(7), 7)


@query("fold_pairs", f"""
WITH s AS (SELECT o_totalprice, {kfold_sql('o_orderkey', 3)} AS f FROM orders)
SELECT CAST(i AS INTEGER) AS fold, 'test' AS role, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM s, range(1, 4) t(i) WHERE f = i GROUP BY i
UNION ALL SELECT CAST(i AS INTEGER), 'train', count(*), round(sum(o_totalprice), 2) FROM s, range(1, 4) t(i) WHERE f <> i GROUP BY i""")
def fold_pairs(spark, d):
    split = folds.kfold_split(table(spark, d, "orders"), "o_orderkey", 3)
    out = None
    for fold, train, test in folds.fold_pairs(split, folds.split_column(3), 3):
        for role, rows in (("test", test), ("train", train)):
            part = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")).select(
                F.lit(fold).alias("fold"), F.lit(role).alias("role"), "n", "total")
            out = part if out is None else out.unionByName(part)
    return rounded(out, 2)


def _offset_sql(key: str, source: str, k: int) -> str:
    starts = " + ".join(f"CAST(rank >= (2 * {i} * n + {k}) // (2 * {k}) AS INTEGER)" for i in range(1, k))
    return f"""SELECT {key}, CAST({starts} AS INTEGER) AS fold FROM
      (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS rank, count(*) OVER () AS n FROM {source})"""


@query("offset_folds", _offset_sql("o_orderkey", "orders", 3))
def offset_folds(spark, d):
    return folds.offset_folds(table(spark, d, "orders"), "o_orderkey", 3).select("o_orderkey", "fold")


@query("offset_folds_text_key", _offset_sql("c_name", "customer", 7))
def offset_folds_text_key(spark, d):
    return folds.offset_folds(table(spark, d, "customer"), "c_name", 7).select("c_name", "fold")


@query("extend_features", f"""
SELECT c.c_custkey, c.c_mktsegment, o.n_orders, c.c_acctbal / 100 AS balance_hundreds,
  round(CAST({md5_order_sql("'0.67:' || CAST(c.c_custkey AS VARCHAR)")} >> 10 AS DOUBLE) / 9007199254740992.0, 9) AS _rnd
FROM customer c JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey
WHERE c.c_acctbal >= 0""")
def extend_features(spark, d):
    side = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    out = joins.extend_features(
        table(spark, d, "customer"), "c_custkey", Rule("c_acctbal", "greaterOrEqual", ("0",)),
        {"balance_hundreds": F.col("c_acctbal") / 100}, side)
    return out.select("c_custkey", "c_mktsegment", "n_orders", "balance_hundreds", F.round("_rnd", 9).alias("_rnd"))


@query("align_predictions", """
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 200000.0::DOUBLE ELSE 250000.0::DOUBLE END AS prediction FROM orders""")
def align_predictions(spark, d):
    o = table(spark, d, "orders")
    predictions = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 200000.0).otherwise(250000.0).alias("prediction"))
    return joins.align(predictions, o.select("o_orderkey", "o_totalprice"), "o_orderkey")
