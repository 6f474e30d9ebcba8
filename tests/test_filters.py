import pytest
from pyspark.sql import functions as F

from cohortlens.model import MiningQuery, Rule, RuleGroup, rule_from_json
from cohortlens.operators import counts, filters


@pytest.fixture(scope="module")
def subjects(spark):
    """Trees of two woods: kind of soil (0 sand, 1 loam, 2 clay), trunk width; one soil is not known."""
    rows = [("ash", 1, 0.62, "north"), ("birch", 0, 0.31, "south"), ("cedar", 2, 0.88, "south"), ("elm", None, 0.74, "north"),
            ("fir", 1, 0.45, "south"), ("hazel", 2, 0.19, "north"), ("larch", 1, 0.57, "south")]
    return spark.createDataFrame(rows, "tree string, soil int, width double, dataset string")


def keys(df):
    return sorted(r["tree"] for r in df.collect())


def test_three_valued_logic(subjects):
    assert keys(filters.apply_filters(subjects, Rule("soil", "notEqual", ("1",)))) == ["birch", "cedar", "hazel"]
    assert keys(filters.apply_filters(subjects, Rule("soil", "not_in", ("1", "2")))) == ["birch"]
    assert keys(filters.apply_filters(subjects, Rule("soil", "isNull"))) == ["elm"]


def test_true_or(subjects):
    rule = RuleGroup("OR", (Rule("soil", "equal", ("0",)), Rule("width", "less", ("0.2",))))
    assert keys(filters.apply_filters(subjects, rule)) == ["birch", "hazel"]


def test_json_tree(subjects):
    rule = rule_from_json({"condition": "AND", "rules": [
        {"field": "soil", "operator": "is_not_null", "type": "string", "value": []},
        {"condition": "OR", "rules": [
            {"field": "width", "operator": "between", "value": ["0.5", "0.8"]},
            {"field": "soil", "operator": "equal", "value": "0"}]}]})
    assert keys(filters.apply_filters(subjects, rule)) == ["ash", "birch", "larch"]
    assert rule_from_json(None) is None and rule_from_json({"condition": "AND", "rules": []}) is None


def test_literals_take_the_column_type(subjects):
    assert keys(filters.apply_filters(subjects, Rule("soil", "greater", ("1.5",)))) == ["cedar", "hazel"]
    with pytest.raises(ValueError, match="does not fit"):
        filters.compile_rule(Rule("soil", "equal", ("high",)), subjects.schema)


@pytest.mark.parametrize("rule", [
    Rule("soil", "between", ("1",)), Rule("soil", "in"), Rule("soil", "like", ("x",)), Rule("nothing", "equal", ("1",)),
    RuleGroup("XOR", (Rule("soil", "isNull"),))])
def test_bad_rules(subjects, rule):
    with pytest.raises(ValueError):
        filters.compile_rule(rule, subjects.schema)


def test_sanitised_field_names(subjects):
    assert keys(filters.apply_filters(subjects, Rule("SOIL", "equal", ("0",)))) == ["birch"]


def test_projection_order(subjects):
    df = filters.select_features(subjects, ["width"], ["soil", "width"], ["dataset", "soil"])
    assert df.columns == ["width", "soil", "dataset"]
    q = MiningQuery(("width",), "t", ("soil",), ("dataset",))
    assert filters.dependent_only(subjects, q, "tree").columns == ["width", "tree"]
    assert filters.independent_only(subjects, q, "tree").columns == ["soil", "dataset", "tree"]


def test_null_and_dataset_filters(subjects):
    assert keys(filters.filter_nulls(subjects, ["width"], ["soil"])) == ["ash", "birch", "cedar", "fir", "hazel", "larch"]
    assert len(keys(filters.filter_nulls(subjects, ["width"], ["soil"], (), False, True))) == 7
    assert keys(filters.filter_datasets(subjects, "dataset", ["north"])) == ["ash", "elm", "hazel"]
    assert filters.filter_datasets(subjects, "dataset", []) is subjects


def test_filters_reach_the_scan(spark, sf_dir):
    from cohortlens.model import FeatureTable
    from cohortlens.plans.mining import features
    from cohortlens.sources.tables import Catalog

    catalog = Catalog([FeatureTable("orders", f"{sf_dir}/orders.parquet", "o_orderkey", "o_orderpriority")])
    with pytest.raises(ValueError, match="Unsupported type"):
        catalog.frame(spark, "orders")  # o_orderdate is a timestamp
    df = features(spark, catalog, MiningQuery(
        ("o_totalprice",), "orders", datasets=("5-LOW",), filters=Rule("o_totalprice", "greater", ("1000",))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "PushedFilters" in plan and "GreaterThan(o_totalprice,1000.0)" in plan
    assert "o_orderdate" not in scan and "o_custkey" not in scan


def test_counts(spark, subjects):
    assert counts.count_rows(subjects).first()["n"] == 7
    assert counts.count_dataset(subjects, "t", "dataset", "south").first()["n"] == 4
    assert counts.count_dataset(subjects, "t", None, '"t"').first()["n"] == 7
    assert counts.count_dataset(subjects, "t", None, "other").first()["n"] == 0
    grouped = {r["soil"]: r["n"] for r in counts.count_group_by(subjects, "soil").collect()}
    assert grouped == {"0": 1, "1": 3, "2": 2, None: 1}
    rule = Rule("width", "greater", ("0.8",))
    assert [r["dataset"] for r in counts.datasets_used(subjects, "t", "dataset", rule).collect()] == ["south"]
    assert [r["dataset"] for r in counts.datasets_used(subjects, "t", None, rule).collect()] == ["t"]
    none = Rule("width", "greater", ("9",))
    assert counts.datasets_used(subjects, "t", None, none).count() == 0
    with pytest.raises(ValueError, match="No data in table t"):
        counts.require_rows(subjects, "t", none)
