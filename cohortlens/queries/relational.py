"""Projection, predicates, counts, joins and metadata checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.model import FeatureTable, MiningQuery, Rule, RuleGroup
from cohortlens.operators import counts, dictionary, filters, joins
from cohortlens.plans.mining import features
from cohortlens.plans.registry import algorithm
from cohortlens.queries import COHORT_SQL, cohort, query, rounded, table
from cohortlens.sources import tables

ADULT_RULE = RuleGroup("AND", (
    Rule("c_acctbal", "greater_or_equal", ("0",)),
    RuleGroup("OR", (
        Rule("c_mktsegment", "in", ("BUILDING", "MACHINERY")),
        Rule("n_name", "equal", ("NATION_7",)),
    )),
))


@query("features_filtered", f"""
SELECT c_acctbal, c_mktsegment, r_name FROM {COHORT_SQL}
WHERE c_acctbal >= 0 AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR n_name = 'NATION_7')""")
def features_filtered(spark, d):
    catalog = tables.Catalog([FeatureTable("cohort", lambda s: cohort(s, d), "c_custkey", "r_name")])
    return features(spark, catalog, MiningQuery(
        variables=("c_acctbal",), covariables=("c_mktsegment",), grouping=("r_name",),
        filters=ADULT_RULE, target_table="cohort"))


@query("feature_table_sanitized", """
SELECT c_custkey AS c_custkey, c_name AS c_name, c_acctbal AS _2_balance FROM customer""")
def feature_table_sanitized(spark, d):
    source = lambda s: table(s, d, "customer").select(
        F.col("c_custkey").alias("C-CustKey"), F.col("c_name").alias("C_Name"),
        F.col("c_acctbal").alias("2-Balance"))
    return tables.feature_table(spark, FeatureTable("customer", source), sanitize=True)


@query("rows_as_json", """
SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":' ||
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}' AS json
FROM customer""")
def rows_as_json(spark, d):
    c = table(spark, d, "customer")
    return tables.as_json(c.select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment")))


@query("feature_projection", """
SELECT o_totalprice, o_orderpriority, o_orderstatus FROM orders""")
def feature_projection(spark, d):
    return filters.select_features(
        table(spark, d, "orders"), ["o_totalprice"], ["o_orderpriority", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])


_ROLES = MiningQuery(variables=("o_totalprice",), covariables=("o_orderpriority",),
                     grouping=("o_orderstatus",), target_table="orders")


@query("dependent_only", "SELECT o_totalprice, o_orderkey FROM orders")
def dependent_only(spark, d):
    return filters.dependent_only(table(spark, d, "orders"), _ROLES, "o_orderkey")


@query("independent_only", "SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders")
def independent_only(spark, d):
    return filters.independent_only(table(spark, d, "orders"), _ROLES, "o_orderkey")


# one rule per operator of the vocabulary, with its SQL
RULES = {
    "n_equal": (Rule("p_brand", "equal", ("Brand#7",)), "p_brand = 'Brand#7'"),
    "n_not_equal": (Rule("p_size", "not_equal", ("7",)), "p_size <> 7"),
    "n_in": (Rule("p_size", "in", ("1", "2", "3")), "p_size IN (1, 2, 3)"),
    "n_not_in": (Rule("brand", "not_in", ("Brand#1", "Brand#2")), "brand NOT IN ('Brand#1', 'Brand#2')"),
    "n_less": (Rule("p_size", "less", ("10",)), "p_size < 10"),
    "n_less_or_equal": (Rule("p_size", "lessOrEqual", ("10",)), "p_size <= 10"),
    "n_greater": (Rule("p_retailprice", "greater", ("950.5",)), "p_retailprice > 950.5"),
    "n_greater_or_equal": (Rule("p_retailprice", "greaterOrEqual", ("950.5",)), "p_retailprice >= 950.5"),
    "n_between": (Rule("p_size", "between", ("10", "20")), "p_size BETWEEN 10 AND 20"),
    "n_not_between": (Rule("p_size", "not_between", ("10", "20")), "p_size NOT BETWEEN 10 AND 20"),
    "n_begins_with": (Rule("p_name", "begins_with", ("red",)), "starts_with(p_name, 'red')"),
    "n_not_begins_with": (Rule("p_name", "not_begins_with", ("red",)), "NOT starts_with(p_name, 'red')"),
    "n_contains": (Rule("p_name", "contains", ("ing",)), "contains(p_name, 'ing')"),
    "n_not_contains": (Rule("p_name", "not_contains", ("ing",)), "NOT contains(p_name, 'ing')"),
    "n_ends_with": (Rule("p_name", "ends_with", ("t",)), "suffix(p_name, 't')"),
    "n_not_ends_with": (Rule("p_name", "not_ends_with", ("t",)), "NOT suffix(p_name, 't')"),
    "n_is_empty": (Rule("empty_name", "is_empty"), "empty_name = ''"),
    "n_is_not_empty": (Rule("empty_name", "is_not_empty"), "empty_name <> ''"),
    "n_is_null": (Rule("brand", "isNull"), "brand IS NULL"),
    "n_is_not_null": (Rule("brand", "is_not_null"), "brand IS NOT NULL"),
    "n_nested": (
        RuleGroup("OR", (
            RuleGroup("AND", (Rule("p_size", "less", ("10",)), Rule("brand", "not_equal", ("Brand#5",)))),
            RuleGroup("AND", (Rule("p_size", "greater", ("40",)), Rule("p_name", "contains", ("blue",)))),
        )),
        "(p_size < 10 AND brand <> 'Brand#5') OR (p_size > 40 AND contains(p_name, 'blue'))"),
}

_PART_SQL = """(SELECT *, nullif(p_brand, 'Brand#3') AS brand,
  CASE WHEN p_size < 25 THEN '' ELSE p_name END AS empty_name FROM part)"""


def _part(spark, d):
    return table(spark, d, "part").withColumn("brand", F.nullif("p_brand", F.lit("Brand#3"))).withColumn(
        "empty_name", F.when(F.col("p_size") < 25, "").otherwise(F.col("p_name")))


@query("filter_rules_all", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {sql}) AS {name}" for name, (_, sql) in RULES.items()) + f" FROM {_PART_SQL}")
def filter_rules_all(spark, d):
    p = _part(spark, d)
    return p.agg(*[
        F.count(F.when(filters.compile_rule(rule, p.schema), F.lit(1))).alias(name)
        for name, (rule, _) in RULES.items()
    ])


@query("filter_rule_tree", f"SELECT p_partkey, p_size, brand FROM {_PART_SQL} WHERE {RULES['n_nested'][1]}")
def filter_rule_tree(spark, d):
    return filters.apply_filters(_part(spark, d), RULES["n_nested"][0]).select("p_partkey", "p_size", "brand")


_SPARSE_SQL = """(SELECT c_custkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment,
  nullif(c_nationkey, 3) AS nation FROM customer)"""


def _sparse(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.nullif("c_nationkey", F.lit(3)).alias("nation"))


@query("filter_nulls", f"SELECT * FROM {_SPARSE_SQL} WHERE segment IS NOT NULL AND nation IS NOT NULL")
def filter_nulls(spark, d):
    return filters.filter_nulls(_sparse(spark, d), ["segment"], ["c_acctbal"], ["nation"])


@query("filter_nulls_targets_only", f"SELECT * FROM {_SPARSE_SQL} WHERE segment IS NOT NULL")
def filter_nulls_targets_only(spark, d):
    return filters.filter_nulls(_sparse(spark, d), ["segment"], ["nation"], covariables_can_be_null=True)


@query("experiment_null_policy", f"""
SELECT 'any' AS policy, count(*) AS n FROM {_SPARSE_SQL}
UNION ALL SELECT 'strict', count(*) FROM {_SPARSE_SQL} WHERE segment IS NOT NULL AND nation IS NOT NULL""")
def experiment_null_policy(spark, d):
    definitions = [algorithm("statisticsSummary"), algorithm("linearRegression")]
    out = None
    for name, strict in (("any", False), ("strict", True)):
        allowed = filters.experiment_null_policy(definitions, strict)
        rows = filters.filter_nulls(_sparse(spark, d), ["segment"], ["nation"], (), *allowed)
        part = counts.count_rows(rows).select(F.lit(name).alias("policy"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_PRIORITIES = ("1-URGENT", "5-LOW")


@query("filter_datasets", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def filter_datasets(spark, d):
    return filters.filter_datasets(table(spark, d, "orders"), "o_orderpriority", _PRIORITIES).select(
        "o_orderkey", "o_orderpriority")


@query("datasets_used", """
SELECT DISTINCT o_orderpriority AS dataset FROM orders WHERE o_totalprice < 100000""")
def datasets_used(spark, d):
    return counts.datasets_used(table(spark, d, "orders"), "orders", "o_orderpriority",
                                Rule("o_totalprice", "less", ("100000",)))


@query("datasets_used_plain_table", """
SELECT DISTINCT 'orders' AS dataset FROM orders WHERE o_totalprice < 100000""")
def datasets_used_plain_table(spark, d):
    return counts.datasets_used(table(spark, d, "orders"), "orders", None, Rule("o_totalprice", "less", ("100000",)))


@query("ordered_by_key", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey")
def ordered_by_key(spark, d):
    return filters.order_by(table(spark, d, "customer"), "c_custkey").select("c_custkey", "c_acctbal")


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, d):
    return counts.count_rows(table(spark, d, "lineitem"))


@query("count_dataset", """
SELECT 'column' AS how, count(*) AS n FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'table', count(*) FROM orders UNION ALL SELECT 'other', 0""")
def count_dataset(spark, d):
    o = table(spark, d, "orders")
    return (
        counts.count_dataset(o, "orders", "o_orderpriority", "5-LOW").select(F.lit("column").alias("how"), "n")
        .unionByName(counts.count_dataset(o, "orders", None, '"orders"').select(F.lit("table").alias("how"), "n"))
        .unionByName(counts.count_dataset(o, "orders", None, "lineitem").select(F.lit("other").alias("how"), "n"))
    )


@query("count_filtered", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'R'")
def count_filtered(spark, d):
    rule = RuleGroup("AND", (Rule("l_quantity", "greaterOrEqual", ("10",)), Rule("l_returnflag", "equal", ("R",))))
    return counts.count_filtered(table(spark, d, "lineitem"), rule)


@query("count_group_by", """
SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity < 25 GROUP BY 1""")
def count_group_by(spark, d):
    return counts.count_group_by(table(spark, d, "lineitem"), "l_linenumber", Rule("l_quantity", "less", ("25",)))


@query("require_rows", "SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05")
def require_rows(spark, d):
    rows = counts.require_rows(table(spark, d, "lineitem"), "lineitem", Rule("l_discount", "greater", ("0.05",)))
    return counts.count_rows(rows)


@query("key_join_two_columns", """
SELECT a.l_partkey, a.l_suppkey, a.quantity, round(b.price, 2) AS price FROM
 (SELECT l_partkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) a JOIN
 (SELECT l_partkey, l_suppkey, sum(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) b
 ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def key_join_two_columns(spark, d):
    li = table(spark, d, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    a = li.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.sum("l_quantity").alias("quantity"))
    b = li.filter("l_returnflag = 'A'").groupBy(*keys).agg(F.sum("l_extendedprice").alias("price"))
    return rounded(joins.key_join(a, b, keys), 2)


@query("scan_datasets", """
SELECT 'AFRICA' AS dataset, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA'
UNION ALL SELECT 'suppliers', s_suppkey, s_acctbal, NULL FROM supplier""")
def scan_datasets(spark, d):
    customers = lambda s: cohort(s, d).select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))
    suppliers = lambda s: table(s, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    catalog = tables.Catalog([
        FeatureTable("customers", customers, "id", "region"), FeatureTable("suppliers", suppliers, "id"),
    ])
    registry = [tables.Dataset("AFRICA", tables=("customers",)), tables.Dataset("ASIA", tables=("customers",)),
                tables.Dataset("suppliers", tables=("suppliers",))]
    return tables.scan_datasets(spark, catalog, registry, ["AFRICA", "suppliers", "unknown"])


# every customer brings a small hierarchy: segment > nation > its name, and a balance of its own
@query("flatten_hierarchy", f"""
SELECT upper(c_name) AS "table", c_mktsegment || '/' || n_name AS path, n_name || '_name' AS code, 'text' AS type, 0 AS rank
FROM {COHORT_SQL}
UNION ALL SELECT upper(c_name), c_mktsegment, 'balance', 'real', 1 FROM {COHORT_SQL}
UNION ALL SELECT upper(c_name), c_mktsegment, 'region', 'polynominal', 2 FROM {COHORT_SQL}""")
def flatten_hierarchy(spark, d):
    def variable(code, kind):
        return F.struct(code.alias("code"), F.lit(kind).alias("type"))

    inner = F.struct(F.col("n_name").alias("code"),
                     F.array(variable(F.concat("n_name", F.lit("_name")), "text")).alias("variables"))
    doc = F.struct(
        F.col("c_mktsegment").alias("code"), F.array(inner).alias("groups"),
        F.array(variable(F.lit("balance"), "real"), variable(F.lit("region"), "polynominal")).alias("variables"))
    docs = cohort(spark, d).select(F.col("c_name").alias("table"), F.to_json(doc).alias("hierarchy"))
    flat = dictionary.flatten_hierarchy(docs)
    rank = F.when(F.size("order") > 2, 0).otherwise(F.element_at("order", -1) + 1)  # sub-groups come first
    return flat.select("table", F.array_join("path", "/").alias("path"), "code", "type", rank.alias("rank"))


_METAS_SQL = """(SELECT DISTINCT CAST(user_id AS VARCHAR) AS source, event_type AS code,
  CASE WHEN event_type = 'error' THEN 'integer' ELSE 'real' END AS type, event_type AS label FROM events)"""


def _metas(spark, d):
    """Each user is a site whose variables are the event types seen there."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("code"))
    kind = F.when(F.col("code") == "error", "integer").otherwise("real")
    return e.distinct().select("source", "code", kind.alias("type"), F.col("code").alias("label"),
                               F.array("source").alias("datasets"))


@query("merge_variables_union", f"""
SELECT code, type, min(label) AS label, array_to_string(list_sort(list(DISTINCT source)), ',') AS datasets,
  count(DISTINCT source) AS sources FROM {_METAS_SQL} GROUP BY code, type""")
def merge_variables_union(spark, d):
    merged = dictionary.merge_variables(_metas(spark, d))
    return merged.withColumn("datasets", F.array_join("datasets", ","))


@query("merge_variables_exhaustive", f"""
SELECT code, type, count(DISTINCT source) AS sources FROM {_METAS_SQL} GROUP BY code, type
HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM {_METAS_SQL})""")
def merge_variables_exhaustive(spark, d):
    return dictionary.merge_variables(_metas(spark, d), exhaustive=True).select("code", "type", "sources")


_DICTIONARY = [
    {"code": "p_partkey", "type": "integer"},
    {"code": "brand", "type": "polynominal", "enumerations": [{"code": f"Brand#{i}"} for i in range(1, 21)]},
    {"code": "p_size", "type": "integer", "minValue": 5, "maxValue": 45},
    {"code": "p_retailprice", "type": "integer", "minValue": 950},
    {"code": "p_name", "type": "real"},
    {"code": "p_weight", "type": "real"},
]
_BRANDS = ", ".join(f"'Brand#{i}'" for i in range(1, 21))


@query("conformance_report", f"""
WITH p AS (SELECT p_partkey, p_name, p_type, p_size, p_retailprice, nullif(p_brand, 'Brand#3') AS brand FROM part)
SELECT 'p_partkey' AS variable, 'ok' AS status, count(*) FILTER (WHERE p_partkey IS NULL) AS null_count,
  CAST(0 AS BIGINT) AS outside_enumeration, CAST(0 AS BIGINT) AS below_min, CAST(0 AS BIGINT) AS above_max,
  CAST(0 AS BIGINT) AS not_castable FROM p
UNION ALL SELECT 'brand', 'ok', count(*) FILTER (WHERE brand IS NULL),
  count(*) FILTER (WHERE brand NOT IN ({_BRANDS})), 0, 0, 0 FROM p
UNION ALL SELECT 'p_size', 'ok', 0, 0, count(*) FILTER (WHERE p_size < 5), count(*) FILTER (WHERE p_size > 45), 0 FROM p
UNION ALL SELECT 'p_retailprice', 'ok', 0, 0, count(*) FILTER (WHERE p_retailprice < 950), 0, count(*) FILTER (WHERE p_retailprice <> floor(p_retailprice)) FROM p
UNION ALL SELECT 'p_name', 'ok', 0, 0, 0, 0, count(*) FILTER (WHERE TRY_CAST(p_name AS DOUBLE) IS NULL) FROM p
UNION ALL SELECT 'p_weight', 'missing column', 0, 0, 0, 0, 0
UNION ALL SELECT 'p_type', 'not described', 0, 0, 0, 0, 0""")
def conformance_report(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice",
                                       F.nullif("p_brand", F.lit("Brand#3")).alias("brand"))
    return dictionary.conformance_report(p, _DICTIONARY, "p_partkey")


@query("validate_key_repeated", """
WITH c AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)
SELECT CAST(sum(c) AS BIGINT) AS "rows", CAST(0 AS BIGINT) AS null_keys, count(*) FILTER (WHERE c > 1) AS duplicate_keys,
  CAST(sum(c) FILTER (WHERE c > 1) AS BIGINT) AS duplicate_rows FROM c""")
def validate_key_repeated(spark, d):
    return dictionary.validate_key(table(spark, d, "lineitem"), "l_orderkey")


@query("validate_key_unique", """
SELECT count(*) AS "rows", CAST(0 AS BIGINT) AS null_keys, CAST(0 AS BIGINT) AS duplicate_keys,
  CAST(0 AS BIGINT) AS duplicate_rows FROM customer""")
def validate_key_unique(spark, d):
    return dictionary.validate_key(table(spark, d, "customer"), "c_custkey")


@query("validate_datasets", """
WITH reg(dataset, "table") AS (VALUES ('5-LOW', 'orders'), ('6-NONE', 'orders'), ('part', 'part'), ('R', 'lineitem')),
cnt AS (SELECT o_orderpriority AS dataset, 'orders' AS "table", count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'part', 'part', count(*) FROM part
  UNION ALL SELECT l_returnflag, 'lineitem', count(*) FROM lineitem GROUP BY ALL)
SELECT reg.dataset, reg."table", coalesce(n, 0) AS n, coalesce(n, 0) > 0 AS has_rows, reg."table" <> 'part' AS has_metadata
FROM reg LEFT JOIN cnt ON reg.dataset = cnt.dataset AND reg."table" = cnt."table" """)
def validate_datasets(spark, d):
    registry = spark.createDataFrame(
        [("5-LOW", "orders"), ("6-NONE", "orders"), ("part", "part"), ("R", "lineitem")], "dataset string, table string")
    return dictionary.validate_datasets({
        "orders": (table(spark, d, "orders"), "o_orderpriority"), "part": (table(spark, d, "part"), None),
        "lineitem": (table(spark, d, "lineitem"), "l_returnflag"),
    }, registry, ["ORDERS", "lineitem"])
