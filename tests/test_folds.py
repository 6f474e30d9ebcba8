import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions import keys
from cohortlens.model import Rule
from cohortlens.operators import folds


def test_pseudo_encrypt_published_values(spark):
    got = [r[0] for r in spark.range(-2, 4).select(keys.pseudo_encrypt(F.col("id"))).collect()]
    assert got == [-157973154, -1105881908, 1777613459, 561465857, 436885871, 576481439]


def test_pseudo_encrypt_is_a_permutation(spark):
    assert spark.range(20000).select(keys.pseudo_encrypt(F.col("id")).alias("e")).distinct().count() == 20000


@pytest.mark.parametrize("k", [2, 7, 20])
@pytest.mark.parametrize("leaf", [4, 4096])
def test_same_as_ntile(spark, sf_dir, monkeypatch, k, leaf):
    monkeypatch.setattr(folds, "LEAF_ROWS", leaf)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    got = folds.kfold_split(orders, "o_orderkey", k, 0.3)
    order = keys.seeded_order(F.col("o_orderkey"), 0.3)
    want = orders.withColumn("w", F.ntile(k).over(Window.orderBy(order, "o_orderkey")))
    both = got.join(want, "o_orderkey")
    assert both.count() == orders.count()
    assert both.filter(F.col(folds.split_column(k)) != F.col("w")).count() == 0


def test_fewer_rows_than_folds(spark):
    got = folds.kfold_split(spark.range(3), "id", 5)
    assert sorted(r[1] for r in got.collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="empty"):
        folds.validate_folds(got, folds.split_column(5), 5)
    assert folds.kfold_split(spark.range(0), "id", 5).count() == 0


def test_filter_runs_before_the_split(spark):
    got = folds.kfold_split(spark.range(100), "id", 5, rule=Rule("id", "less", ("50",)))
    sizes = [r["count"] for r in got.groupBy(folds.split_column(5)).count().collect()]
    assert sizes == [10] * 5


def test_split_needs_no_window_or_sort(spark):
    plan = folds.kfold_split(spark.range(1000), "id", 4)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan


def test_a_column_that_is_no_key(spark, monkeypatch):
    monkeypatch.setattr(folds, "LEAF_ROWS", 10)
    with pytest.raises(ValueError, match="not a key"):
        folds.kfold_split(spark.range(100).select(F.lit(7).alias("x")), "x", 2)


def test_leave_out_parts_cover_the_table(spark):
    df = spark.range(101).select("id", F.concat(F.lit("p"), F.col("id")).alias("code"))
    for key, order in (("id", "auto"), ("code", "auto"), ("id", "random")):
        left_out = []
        for fold in range(4):
            kept = {r[0] for r in folds.leave_out(df, 4, fold, key, order).select("id").collect()}
            left_out.append(set(range(101)) - kept)
        assert sorted(map(len, left_out)) == [25, 25, 25, 26]
        assert set.union(*left_out) == set(range(101))


def test_contiguous_folds(spark):
    sizes = [r["count"] for r in folds.offset_folds(spark.range(16), "id", 3).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [5, 6, 5]


def test_contiguous_folds_of_long_text_keys(spark, monkeypatch):
    monkeypatch.setattr(folds, "LEAF_ROWS", 3)
    df = spark.range(200).select(F.concat(F.lit("a shared beginning "), F.format_string("%017d", F.col("id") * 31)).alias("k"))
    rows = sorted((r["k"], r["fold"]) for r in folds.offset_folds(df, "k", 6).collect())
    starts = [(2 * i * 200 + 6) // 12 for i in range(6)]
    assert [f for _, f in rows] == [max(j for j, s in enumerate(starts) if s <= i) for i in range(200)]


def test_train_and_test_are_disjoint(spark):
    split = folds.kfold_split(spark.range(30), "id", 3)
    for _, train, test in folds.fold_pairs(split, folds.split_column(3), 3):
        a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
        assert not a & b and len(a | b) == 30 and len(b) == 10
