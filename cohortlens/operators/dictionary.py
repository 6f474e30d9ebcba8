"""Data dictionaries: flattening, merging, and checks of tables against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import checkpoint

VARIABLE_SCHEMA = (
    "code string, label string, type string, methodology string, sql_type string, description string, "
    "units string, enumerations array<struct<code:string,label:string>>, length int, "
    "minValue double, maxValue double, datasets array<string>"
)
_GROUP_SCHEMA = f"code string, label string, groups array<string>, variables array<struct<{VARIABLE_SCHEMA}>>".replace(
    VARIABLE_SCHEMA, ", ".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in VARIABLE_SCHEMA.split(", "))
)
OWN_LAST = (1 << 31) - 1  # a group's own variables follow those of its sub-groups


def flatten_hierarchy(hierarchies: DataFrame, table: str = "table", document: str = "hierarchy") -> DataFrame:
    """(table, position, path, variable fields) of JSON hierarchies of groups.

    Table names are upper-cased, as lookups ignore their case. Sub-groups come
    first, then the group's own variables. Each level is one explode.
    """
    level = hierarchies.select(
        F.upper(F.col(table)).alias("table"), F.from_json(document, _GROUP_SCHEMA).alias("g"),
        F.array().cast("array<int>").alias("order"), F.array().cast("array<string>").alias("path"),
    )
    out = None
    while True:
        level = level.withColumn("path", F.concat("path", F.array(F.col("g.code"))))
        own = level.select(
            "table", "order", "path", F.posexplode("g.variables").alias("at", "v")
        ).select("table", F.concat("order", F.array(F.lit(OWN_LAST), F.col("at"))).alias("order"), "path", "v.*")
        out = own if out is None else out.unionByName(own)
        level = level.select("table", "order", "path", F.posexplode("g.groups").alias("at", "doc")).select(
            "table", F.from_json("doc", _GROUP_SCHEMA).alias("g"),
            F.concat("order", F.array("at")).alias("order"), "path",
        )
        level = checkpoint(level)  # one job a level: the next one starts from these groups
        if level.isEmpty():
            return out


def merge_variables(metas: DataFrame, exhaustive: bool = False, sources: int | None = None) -> DataFrame:
    """Merge variables (source, code, type, label, datasets) of several tables.

    Variables with the same code and type are one; their dataset sets are
    united. ``exhaustive`` keeps only the variables that every source has.
    """
    merged = metas.withColumn("dataset", F.explode_outer("datasets")).groupBy("code", "type").agg(
        F.min_by("label", "source").alias("label"),
        F.array_sort(F.collect_set("dataset")).alias("datasets"),
        F.count_distinct("source").alias("sources"),
    )
    if exhaustive:
        n = sources if sources is not None else metas.select("source").distinct().count()
        merged = merged.filter(F.col("sources") == n)
    return merged


_CAST_OF = {"integer": "bigint", "real": "double", "int": "bigint", "numeric": "double"}


def conformance_report(
    df: DataFrame, dictionary: list, key: str | None = None, dataset_column: str | None = None
) -> DataFrame:
    """One row per variable or column: status, and counts of values that break the dictionary.

    ``dictionary`` lists the variables as dicts with ``code``, ``type`` and
    optionally ``enumerations``, ``minValue``, ``maxValue``. All counts come from one scan.
    """
    spark, described = df.sparkSession, {v["code"]: v for v in dictionary}
    aggs, checked = [F.count(F.lit(1)).alias("rows")], []
    for code, v in described.items():
        if code not in df.columns:
            continue
        i, c = len(checked), F.col(f"`{code}`")
        checked.append(code)
        text = c.cast("string")
        bad = F.lit(False)
        if v.get("enumerations"):
            bad = ~text.isin(*[str(e["code"] if isinstance(e, dict) else e) for e in v["enumerations"]])
        number = F.expr(f"try_cast(`{code}` AS double)")
        target = _CAST_OF.get(v.get("type"))
        uncastable = F.lit(False)
        if target and isinstance(df.schema[code].dataType, T.NumericType):
            uncastable = (c != F.floor(c)) if target == "bigint" else F.lit(False)
        elif target:
            uncastable = c.isNotNull() & F.expr(f"try_cast(cast(`{code}` AS string) AS {target})").isNull()
        low = number < F.lit(float(v["minValue"])) if v.get("minValue") is not None else F.lit(False)
        high = number > F.lit(float(v["maxValue"])) if v.get("maxValue") is not None else F.lit(False)
        aggs += [
            F.count(F.when(cond, F.lit(1))).alias(f"{name}{i}")
            for name, cond in (("nulls", c.isNull()), ("enum", bad), ("low", low), ("high", high), ("cast", uncastable))
        ]
    counts = df.agg(*aggs)
    zero = F.lit(0).cast("bigint")

    def row(name, status, nulls, enum, low, high, cast):
        return F.struct(
            F.lit(name).alias("variable"), F.lit(status).alias("status"), nulls.alias("null_count"),
            enum.alias("outside_enumeration"), low.alias("below_min"), high.alias("above_max"),
            cast.alias("not_castable"),
        )

    rows = [
        row(code, "ok", *[F.col(f"{n}{i}") for n in ("nulls", "enum", "low", "high", "cast")])
        for i, code in enumerate(checked)
    ]
    rows += [row(c, "missing column", *[zero] * 5) for c in described if c not in df.columns]
    rows += [
        row(c, "not described", *[zero] * 5)
        for c in df.columns if c not in described and c not in (key, dataset_column)
    ]
    for role, c in (("key", key), ("dataset column", dataset_column)):
        if c and c not in df.columns:
            rows.append(row(c, f"missing {role}", *[zero] * 5))
    if not rows:
        return spark.createDataFrame([], counts.select(F.inline(F.array(row("", "", *[zero] * 5)))).schema)
    return counts.select(F.inline(F.array(*rows)))


def validate_key(df: DataFrame, key: str) -> DataFrame:
    """rows, null keys, keys that occur more than once and the rows they hold."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("c"))
    repeated = F.col("_key").isNotNull() & (F.col("c") > 1)
    zero = F.lit(0).cast("bigint")
    return counts.agg(
        F.coalesce(F.sum("c"), zero).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_key").isNull(), F.col("c"))), zero).alias("null_keys"),
        F.count(F.when(repeated, F.lit(1))).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("c"))), zero).alias("duplicate_rows"),
    )


def validate_datasets(
    tables: dict, registry: DataFrame, described_tables: list
) -> DataFrame:
    """Each registered (dataset, table): its rows, whether it has any, and whether metadata exist.

    ``tables`` maps a table name to (DataFrame, dataset column or None).
    """
    counts = None
    for name, (df, column) in tables.items():
        if column:
            part = df.groupBy(F.col(column).alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
        else:
            part = df.agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(name))
        part = part.select("dataset", F.lit(name).alias("table"), "n")
        counts = part if counts is None else counts.unionByName(part)
    known = F.upper("table").isin(*[t.upper() for t in described_tables]) if described_tables else F.lit(False)
    return (
        counts.join(registry.select("dataset", "table"), ["dataset", "table"], "right")
        .select("dataset", "table", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("has_rows", F.col("n") > 0)
        .withColumn("has_metadata", known)
    )


def dictionary_of(df: DataFrame, source: str) -> DataFrame:
    """Minimal metadata (source, code, type, label, datasets) read off a table's schema."""
    from cohortlens.functions.names import logical_type

    kinds = {"int": "integer", "numeric": "real", "char": "polynominal", "varchar": "polynominal"}
    rows = []
    for f in df.schema.fields:
        try:
            rows.append((source, f.name, kinds[logical_type(f)], f.name, [source]))
        except ValueError:
            continue
    schema = T.StructType([
        T.StructField("source", T.StringType()), T.StructField("code", T.StringType()),
        T.StructField("type", T.StringType()), T.StructField("label", T.StringType()),
        T.StructField("datasets", T.ArrayType(T.StringType())),
    ])
    return df.sparkSession.createDataFrame(rows, schema)
