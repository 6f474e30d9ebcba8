import pytest
from pyspark.sql import functions as F

from cohortlens.model import AlgorithmSpec, ExperimentQuery, FeatureTable, MiningQuery, Rule, ValidationSpec
from cohortlens.operators import dictionary
from cohortlens.plans import experiment, federation, mining, registry, validation
from cohortlens.sources import cache, results, tables
from cohortlens.streaming import states


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(i, float(i % 17), float(i % 5), "abc"[i % 3], f"site{i % 4}", "high" if i % 17 > 8 else "low") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, z double, seg string, dataset string, y string")
    return tables.Catalog([FeatureTable("t", lambda s: df, "id", "dataset")])


def test_unknown_table(spark, catalog):
    with pytest.raises(KeyError, match="no table is registered"):
        catalog.frame(spark, "nothing")


def test_unknown_covariables_are_dropped_with_a_note(spark, catalog):
    q = MiningQuery(("x",), "t", ("nothing", "z"), algorithm=AlgorithmSpec("linearRegression"), datasets=("site1", "site2"))
    result = mining.run_mining(spark, catalog, q)
    assert [r["term"] for r in result.data.collect()] == ["intercept", "z"]
    assert result.feedback == ["Covariable nothing does not exist and was ignored"]
    out = mining.with_provenance(result).first()
    assert out["data_provenance"] == ["site1", "site2"] and len(out["feedback"]) == 1
    strict = MiningQuery(("x",), "t", ("nothing",), algorithm=AlgorithmSpec("linearRegression"), covariables_must_exist=True)
    with pytest.raises(ValueError, match="unknown column nothing"):
        mining.run_mining(spark, catalog, strict)
    with pytest.raises(ValueError):
        mining.run_mining(spark, catalog, MiningQuery(("nothing",), "t", algorithm=AlgorithmSpec("pca")))
    with pytest.raises(KeyError, match="no algorithm is registered"):
        mining.run_mining(spark, catalog, MiningQuery(("x",), "t", algorithm=AlgorithmSpec("magic")))
    with pytest.raises(ValueError, match="No data in table t"):
        mining.run_mining(spark, catalog, MiningQuery(("x",), "t", filters=Rule("x", "greater", ("99",)),
                                                      algorithm=AlgorithmSpec("statisticsSummary")))


def test_data_algorithm_returns_rows(spark, catalog):
    q = MiningQuery(("x",), "t", ("seg",), algorithm=AlgorithmSpec("data"), filters=Rule("x", "less", ("2",)))
    df = mining.run_mining(spark, catalog, q).data
    assert df.columns == ["x", "seg"] and df.count() == 24
    assert tables.as_json(df).count() == 24


@pytest.mark.parametrize("code, variables, covariables, grouping", [
    ("histograms", ("x",), (), ("seg",)), ("statisticsSummary", ("x",), ("seg",), ()), ("anova", ("x",), ("seg",), ()),
    ("linearRegression", ("y",), ("z",), ()), ("correlationHeatmap", ("x",), ("z",), ()),
    ("correlationHeatmap", ("y",), ("seg",), ()), ("pca", ("x",), ("z",), ()), ("kmeans", ("x",), ("z",), ()),
    ("subgroupDiscovery", ("y",), ("x", "seg"), ()), ("networkFeatures", ("y",), ("seg",), ()),
    ("groupConfidenceBands", ("x",), ("z",), ("seg",)), ("knn", ("y",), ("x", "z"), ()),
    ("naiveBayes", ("y",), ("x", "seg"), ()), ("sgdLinearModel", ("x",), ("z", "seg"), ()),
])
def test_every_catalogued_algorithm_runs(spark, catalog, code, variables, covariables, grouping):
    q = MiningQuery(variables, "t", covariables, grouping, algorithm=AlgorithmSpec(code))
    assert mining.run_mining(spark, catalog, q).data.count() > 0


def test_parameters_are_typed_and_known():
    assert registry.parameters_of("knn", {"k": "7"}) == {"k": 7}
    with pytest.raises(ValueError, match="no parameter"):
        registry.parameters_of("knn", {"kk": 7})


def test_registered_algorithm(spark, catalog):
    registry.register_algorithm("range", lambda t: t.df.agg((F.max(t.target) - F.min(t.target)).alias("range")))
    try:
        q = MiningQuery(("x",), "t", algorithm=AlgorithmSpec("range"))
        assert mining.run_mining(spark, catalog, q).data.first()["range"] == 16.0
    finally:
        registry.ALGORITHMS.pop("range")
    with pytest.raises(ValueError):
        registry.register_algorithm("x", predictive=True)


def failing(task):
    raise RuntimeError("planned failure")


def test_experiment_keeps_going_after_a_failure(spark, catalog):
    registry.register_algorithm("chaos", failing)
    try:
        out = experiment.run_experiment(spark, catalog, ExperimentQuery(
            ("y",), "t", (AlgorithmSpec("chaos"), AlgorithmSpec("naiveBayes"), AlgorithmSpec("knn", {"k": 3})), ("x",),
            validations=(ValidationSpec("kfold", {"k": 2}),), training_datasets=("site0", "site1"),
            validation_datasets=("site1", "site3", "site9"))).collect()
    finally:
        registry.ALGORITHMS.pop("chaos")
    errors = [r for r in out if r["error"]]
    assert [(r["position"], r["algorithm"], r["error"]) for r in errors] == [(0, "chaos", "planned failure")]
    for code in ("naiveBayes", "knn"):
        kinds = sorted(r["result"] for r in out if r["algorithm"] == code)
        assert kinds.count("kfold") == 3 and kinds.count("datasets") == 2
        assert "model" in kinds and kinds.count("document") == 1


def test_experiment_fails_up_front(spark, catalog):
    base = dict(variables=("y",), target_table="t", covariables=("x",))
    with pytest.raises(ValueError):
        experiment.run_experiment(spark, catalog, ExperimentQuery(algorithms=(), **base))
    with pytest.raises(KeyError):
        experiment.run_experiment(spark, catalog, ExperimentQuery(algorithms=(AlgorithmSpec("magic"),), **base))
    with pytest.raises(ValueError):
        experiment.run_experiment(spark, catalog, ExperimentQuery(
            algorithms=(AlgorithmSpec("knn"),), validations=(ValidationSpec("kfold", {"k": 1}),), **base))


def test_same_algorithm_twice_keeps_both(spark, catalog):
    out = experiment.run_experiment(spark, catalog, ExperimentQuery(
        ("x",), "t", (AlgorithmSpec("pca", {"k": 1}), AlgorithmSpec("pca", {"k": 1})), ("z",)))
    assert {r["position"] for r in out.collect()} == {0, 1}


def test_validation_of_empty_rows(spark, catalog):
    df = catalog.frame(spark, "t")
    model = validation.fit("naiveBayes", df, "y", ["x"], "id")
    with pytest.raises(ValueError, match="no rows"):
        validation.validate_model(model, df.filter("x > 99"), "y", ["x"])
    out = validation.validate_on_datasets(model, df, "y", ["x"], "dataset", ["site0", "site9"])
    assert {r["dataset"]: r["error"] for r in out.collect()} == {"site0": None, "site9": "no rows to validate on"}
    with pytest.raises(ValueError, match="not predictive"):
        validation.fit("anova", df, "x", ["seg"], "id")


def test_states_merge_and_rerun_once(spark, catalog, tmp_path):
    df, path = catalog.frame(spark, "t"), str(tmp_path / "states")
    for site in ("site0", "site1", "site0"):  # site0 runs twice
        federation.write_states(federation.partial_summary(df.filter(F.col("dataset") == site), ["x"], "dataset"),
                                path, "statisticsSummary", site)
    merged = federation.merge_summary(federation.read_states(spark, path, "statisticsSummary", ["site0", "site1"])).first()
    assert merged["count"] == 100
    with pytest.raises(ValueError):
        federation.read_states(spark, path, "statisticsSummary", [])


def test_results_never_fail_the_reader(spark):
    rows = [
        ("1", "pfa", '{"a": 1}', None, "model", None), ("2", "pfa", "[1]", None, "error", "no readable JSON"),
        ("3", "json", "{oops", "", "error", "no readable JSON"), ("4", "json", None, None, "json", None),
        ("5", "error", None, "broke", "error", "broke"), ("6", "text", "hello", None, "other", None),
        ("7", "text", None, "late failure", "error", "late failure"), ("8", "strange", "x", None, "error", "unknown shape"),
        ("9", "pfa_experiment", "[]", None, "experiment", None), ("10", "serialized_model", "AQI=", "", "serialized_model", None),
    ]
    df = spark.createDataFrame([(i, "n", None, s, "f", d, e) for i, s, d, e, _, _ in rows],
                               "job_id string, node string, timestamp timestamp, shape string, function string, data string, error string")
    got = {r["job_id"]: r for r in results.read_job_results(df).collect()}
    for i, _, _, _, kind, error in rows:
        assert got[i]["kind"] == kind
        assert (got[i]["error"] is None) if error is None else error in got[i]["error"]
    model = results.read_job_results(df, "10").select(results.decode_model(F.col("data")).alias("m")).first()["m"]
    assert bytes(model) == b"\x01\x02"


def test_result_rows_are_cut_and_encoded(spark):
    df = spark.createDataFrame([("1", "n" * 99, None, "serialized_model", "f" * 300, None, None, bytearray(b"\x01\x02")),
                                ("2", "n", None, "pfa", "f", '{ "a" : 1 }', None, None)],
                               "job_id string, node string, timestamp timestamp, shape string, function string, data string, error string, model binary")
    a, b = results.to_result_rows(df).orderBy("job_id").collect()
    assert (len(a["node"]), len(a["function"]), a["data"], b["data"]) == (32, 255, "AQI=", '{"a":1}')


def test_cells_go_in_and_out(spark):
    df = spark.createDataFrame([('{"name":"m","cells":{"k":[1,2]},"n":3}',)], "doc string")
    put = df.select(results.inject_cell(F.col("doc"), "v", F.lit('{"s":0.5}')).alias("doc"))
    assert put.first()["doc"] == '{"cells":{"k":[1,2],"v":{"s":0.5}},"n":3,"name":"m"}'
    assert put.select(results.remove_cell(F.col("doc"), "v")).first()[0] == '{"cells":{"k":[1,2]},"n":3,"name":"m"}'


def _answer(spark, user, variables, data, at):
    import json

    doc = {"variables": [{"code": v} for v in variables], "covariables": [], "grouping": [], "user": {"code": user}}
    return spark.createDataFrame([("n", "t", json.dumps(doc), at, data, "json", "f")],
                                 "node string, table_name string, query string, timestamp string, data string, shape string, function string"
                                 ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_cache_limits_and_conflicts(spark):
    first = _answer(spark, "ann", ["x"], '{"v":1}', "2024-01-01")
    again = _answer(spark, "bob", ["x"], '{"v":2}', "2024-01-02")
    wide = _answer(spark, "ann", [f"x{i}" for i in range(31)], "{}", "2024-01-01")
    heavy = _answer(spark, "ann", ["z"], '{"v":"' + "a" * 1_000_001 + '"}', "2024-01-01")
    empty = cache.cache_entries(first).withColumn("last_used", F.col("created_at")).filter("false").select(*cache.CACHE_COLUMNS)
    stored = cache.cache_put(cache.cache_put(empty, first.unionByName(wide).unionByName(heavy)), again)
    assert [r["data"] for r in stored.collect()] == ['{"v":1}']
    hits, _ = cache.cache_get(stored, again.select("node", "table_name", "query"))
    row = hits.first()
    assert row["data"] == '{"v":1}' and '"bob"' in row["query"]


def test_json_weight(spark):
    docs = ['{"a":"xyz","b":[1,2.5,true,null],"c":{"d":"q\\"r"}}', "[]", '"abc"']
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    assert [r[0] for r in df.select(cache.json_weight(F.col("d"))).collect()] == [9, 0, 3]


def test_fingerprint_ignores_row_order(spark):
    a = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    assert cache.table_fingerprint(a).first() == cache.table_fingerprint(a.orderBy(F.desc("id"))).first()
    assert cache.table_fingerprint(a).first() != cache.table_fingerprint(a.filter("id > 0")).first()


def test_hierarchy_order(spark):
    doc = ('{"code":"root","groups":[{"code":"g1","variables":[{"code":"a","type":"real","enumerations":[{"code":"1","label":"one"}]}],'
           '"groups":[{"code":"g11","variables":[{"code":"b"}]}]},{"code":"g2","variables":[{"code":"c"}]}],"variables":[{"code":"d"},{"code":"e"}]}')
    flat = dictionary.flatten_hierarchy(spark.createDataFrame([("churn", doc)], "table string, hierarchy string"))
    rows = flat.orderBy("table", "order").collect()
    assert [(r["code"], r["path"][-1]) for r in rows] == [("b", "g11"), ("a", "g1"), ("c", "g2"), ("d", "root"), ("e", "root")]
    assert rows[0]["table"] == "CHURN" and rows[1]["enumerations"][0]["label"] == "one"


def test_key_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert tuple(dictionary.validate_key(df, "k").first()) == (4, 1, 1, 2)


def test_stream_batches_are_not_counted_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v double"
    for part in range(3):
        spark.createDataFrame([("ab"[i % 2], float(i + 10 * part)) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = states.file_stream(spark, source, spark.read.parquet(source).schema)
    stream = stream.select("k", "v")
    for _ in range(2):  # the second run finds nothing new
        states.stream_states(stream, out, ["v"], ["k"], ranges={"v": (0.0, 30.0)}).awaitTermination()
    total = states.read_stream_summary(spark, out).first()
    assert total["count"] == 30 and total["mean"] == pytest.approx(14.5)
    assert sum(r["count"] for r in states.read_stream_histogram(spark, out, {"v": (0.0, 30.0)}).collect()) == 30


def test_scan_of_several_datasets(spark, catalog):
    registry_rows = [tables.Dataset("site1", tables=("t",)), tables.Dataset("site2", tables=("*",))]
    df = tables.scan_datasets(spark, catalog, registry_rows, ["site1", "unknown"])
    assert {r["dataset"] for r in df.collect()} == {"site1"}
    assert tables.list_datasets(spark, registry_rows, "t").count() == 2
    with pytest.raises(ValueError):
        tables.scan_datasets(spark, catalog, registry_rows, ["unknown"])
