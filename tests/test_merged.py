"""Mergeable quartiles, merged plans, compaction that dies, and running statistics in the state store."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.operators import kmeans, moments, sketches
from cohortlens.plans import federation
from cohortlens.plans.registry import ALGORITHMS, Task
from cohortlens.plans.mining import merged_plan
from cohortlens.streaming import keyed, states

INF, NAN = float("inf"), float("nan")


def quartiles(df, by=()):
    found = federation.merge_summary(moments.moment_states(df, ["x"], ["part", *by], sketches=True), list(by))
    return {tuple(r[c] for c in by): (r["25%"], r["50%"], r["75%"]) for r in found.collect()}


def test_sketch_of_few_values_is_exact(spark):
    rows = [("a", p % 3, float(p)) for p in range(101)] + [("b", 0, None), ("b", 1, None), ("c", 0, NAN), ("c", 1, 1.0), ("c", 2, 2.0),
            ("d", 0, INF), ("d", 1, -INF), ("d", 1, 0.0), ("e", 0, 4.0), ("e", 1, None), (None, 2, 7.0)]
    got = quartiles(spark.createDataFrame(rows, "g string, part int, x double"), ["g"])
    assert got[("a",)] == (25.0, 50.0, 75.0)
    assert got[("b",)] == (None, None, None)
    assert got[("c",)][:2] == (1.0, 2.0) and math.isnan(got[("c",)][2])
    assert got[("d",)] == (-INF, 0.0, INF)
    assert got[("e",)] == (4.0,) * 3 and got[(None,)] == (7.0,) * 3


@pytest.mark.parametrize("parts", [1, 7, 400])
def test_merged_ranks_stay_within_the_bound(spark, parts):
    """However many states a table was cut into, and with a value that a third of all rows share."""
    df = spark.range(60_000).select(
        (F.col("id") % parts).cast("int").alias("part"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("x"))
    values = np.sort([r.x for r in df.select("x").collect()])
    for p, q in zip((0.25, 0.5, 0.75), quartiles(df)[()]):
        below, upto = np.searchsorted(values, q), np.searchsorted(values, q, "right")
        assert below / len(values) - sketches.rank_error() <= p <= upto / len(values) + sketches.rank_error()


def test_states_without_sketches_still_merge(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "part int, x double")
    row = federation.merge_summary(moments.moment_states(df, ["x"], ["part"])).first()
    assert row["count"] == 2 and row["mean"] == 2.0 and row["50%"] is None


def test_statistics_of_stored_states_without_rows(spark):
    """Sketch quartiles for numbers and whole counts for categories, from states alone."""
    df = spark.createDataFrame([("s", "u", 1.0), ("s", "v", 2.0), ("t", "u", 3.0), ("t", None, None)], "site string, kind string, x double")
    parts = federation.partial_statistics(df, ["x", "kind"], "site", ["kind"])
    got = {(r["index"], r["group"][0]): r for r in federation.merge_statistics(parts, df, ["x", "kind"], ["kind"], rows=False).collect()}
    assert got["x", "all"]["50%"] == 2.0 and got["x", "u"]["25%"] == 1.0 and got["x", "all"]["null_count"] == 1
    assert got["kind", "all"]["top"] == "u" and got["kind", "all"]["null_count"] == 1


def test_flags_hold(spark):
    """Every algorithm that says its states merge has a plan for a numeric target; kNN, which has no state, says no."""
    df = spark.createDataFrame([(i, "st"[i % 2], float(i), float(i * i % 7)) for i in range(30)], "k long, site string, x double, y double")
    for code, definition in ALGORITHMS.items():
        task = Task(df, ["x"], ["y"], [], "k", dict(definition.defaults))
        if definition.mergeable:
            assert merged_plan(code, task, "site").count() > 0, code
        elif code in ("knn", "anova"):
            assert merged_plan(code, task, "site") is None


def test_seeds_do_not_depend_on_layout_and_find_far_groups(spark):
    rng = random.Random(4)
    rows = [(i % 3, float(c) + rng.random(), float(c)) for c in (0, 100, 1000) for i in range(200)] + [(0, 0.5, 0.0)] * 900 + [(1, None, 1.0)]
    df = spark.createDataFrame(rows, "site int, x double, y double")
    seeds = kmeans.seed_centres(df, ["x", "y"], 3, by=["site"])
    assert sorted(round(s[1]) for s in seeds) == [0, 100, 1000]
    assert seeds == kmeans.seed_centres(df.repartition(7), ["x", "y"], 3)
    same = spark.createDataFrame([(0, 1.0, 1.0)] * 50, "site int, x double, y double")
    assert kmeans.seed_centres(same, ["x", "y"], 3) == [[1.0, 1.0]]
    with pytest.raises(ValueError):
        kmeans.seed_centres(df.limit(0), ["x", "y"], 3)


def batches(spark, path, numbers):
    for n in numbers:
        part = spark.createDataFrame([("g", float(n * 10 + i)) for i in range(10)], "g string, value double")
        moments.moment_states(part, ["value"], ["g"], sketches=True).write.mode("overwrite").parquet(f"{path}/moments/batch={n}")


def summary(spark, path):
    r = states.read_stream_summary(spark, path, ["g"]).first()
    return r["count"], r["mean"], r["50%"]


def test_compaction_that_dies_loses_nothing(spark, tmp_path):
    path = str(tmp_path)
    batches(spark, path, range(4))
    want = (40, 19.5, 19.0)
    assert summary(spark, path) == want
    (tmp_path / "moments-merged" / "upto=2" / "_temporary").mkdir(parents=True)  # died while writing
    assert summary(spark, path) == want
    states.compact_states(spark, path, ["g"])
    assert summary(spark, path) == want
    (tmp_path / "moments-merged" / "upto=2" / "_SUCCESS").unlink()  # all files, but not finished
    assert summary(spark, path) == want


def test_batch_that_dies_is_not_read(spark, tmp_path):
    path = str(tmp_path)
    batches(spark, path, range(3))
    (tmp_path / "moments" / "batch=2" / "_SUCCESS").unlink()
    assert summary(spark, path)[0] == 20
    batches(spark, path, [2])  # the restart writes it again
    assert summary(spark, path)[0] == 30


def test_compaction_keeps_few_folders(spark, tmp_path):
    path = str(tmp_path)
    for n in range(8):
        batches(spark, path, [n])
        states.compact_states(spark, path, ["g"])
        assert summary(spark, path)[0] == 10 * (n + 1)
    assert len(list((tmp_path / "moments").glob("batch=*"))) <= 3
    assert len(list((tmp_path / "moments-merged").glob("upto=*"))) <= 2


def test_no_batch_yet(spark, tmp_path):
    with pytest.raises(ValueError):
        states.read_stream_summary(spark, str(tmp_path), ["g"])


values = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(NAN), st.just(INF), st.just(1e300), st.just(0.1)), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(values, max_size=6), st.randoms())
def test_states_add_up_in_any_order(parts, rng):
    """Bins, counts and extremes are those of all values at once; moments agree but for rounding."""
    whole = keyed.state_of(np.array([v for p in parts for v in p], object))
    rng.shuffle(parts)
    total = keyed.EMPTY
    for p in parts:
        total = keyed.add_states(total, keyed.state_of(np.array(p, object)))
    assert repr((total[0], total[1], *total[6:])) == repr((whole[0], whole[1], *whole[6:]))
    known = [v for p in parts for v in p if v is not None]
    if known and not any(map(math.isnan, known)):
        assert total[4:6] == whole[4:6] == (min(known), max(known))
    if known and all(abs(v) <= 1e6 for v in known):
        assert math.isclose(total[2], whole[2], abs_tol=1e-6) and math.isclose(total[3], whole[3], rel_tol=1e-9, abs_tol=1e-3)
    finite = [v for v in known if math.isfinite(v)]
    assert sum(total[8]) == len(finite) and len(total[8]) <= keyed.GRID_BINS
    for at in keyed.grid_place(np.array(finite), total[6]):
        assert total[8][at - total[7]] > 0


def test_running_statistics_restart_and_odd_rows(spark, tmp_path):
    rows = [("a", 1.0), ("a", None), (None, 2.0), ("b", NAN), ("b", 3.0), ("c", INF), ("c", None), ("d", None)]
    schema = "g string, x double"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keyed.running_statistics(stream, str(tmp_path / "progress"), ["x"], ["g"]).awaitTermination()
    got = {r["g"]: r for r in keyed.read_statistics(spark, str(tmp_path / "progress"), ["g"]).collect()}
    assert {g: (r["count"], r["null_count"]) for g, r in got.items()} == {"a": (1, 1), None: (1, 0), "b": (2, 0), "c": (1, 1), "d": (0, 1)}
    assert got["a"]["mean"] == 1.0 and math.isnan(got["b"]["mean"]) and got["d"]["mean"] is None and got["c"]["max"] == INF
    bins = keyed.read_bins(spark, str(tmp_path / "progress"), ["g"]).collect()
    assert sorted((r["g"] or "", r["low"], r["count"]) for r in bins) == [("", 2.0, 1), ("a", 1.0, 1), ("b", 3.0, 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    with pytest.raises(ValueError):
        keyed.running_statistics(spark.readStream.schema("n string, x double").parquet(str(tmp_path / "in")), str(tmp_path / "p"), ["x"], ["n"])


def test_store_has_as_many_parts_as_cores(spark, tmp_path):
    """A batch opens every part, so 64 shuffle partitions are not 64 parts; the session keeps its own setting."""
    spark.createDataFrame([("a", 1.0), ("b", None), ("b", 3.0)], "g string, x double").write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        for name, stores, parts in (("cores", None, spark.sparkContext.defaultParallelism), ("three", 3, 3)):
            stream = spark.readStream.schema("g string, x double").parquet(str(tmp_path / "in"))
            keyed.running_statistics(stream, str(tmp_path / name), ["x"], ["g"], stores=stores).awaitTermination()
            assert len([p for p in (tmp_path / name / "state" / "0").iterdir() if p.name.isdigit()]) == parts
            got = {r["g"]: (r["count"], r["null_count"]) for r in keyed.read_statistics(spark, str(tmp_path / name), ["g"]).collect()}
            assert got == {"a": (1, 0), "b": (1, 1)}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_are_counted_where_the_rows_are(spark):
    """Rows meet their three quartiles without a shuffle, which would bring each variable's rows into one task."""
    from cohortlens.queries.merged import _ranks

    df = spark.range(900).select((F.col("id") % 3).alias("part"), F.col("id").cast("double").alias("x"), F.col("id").alias("y"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = _ranks(federation.merge_summary(moments.moment_states(df, ["x", "y"], ["part"], sketches=True)), df)
        top = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
        assert "rightHint=(strategy=broadcast)" in top.split("\n")[0]
        assert sorted(map(tuple, out.collect())) == [(v, p, 900, True) for v in "xy" for p in (25, 50, 75)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
