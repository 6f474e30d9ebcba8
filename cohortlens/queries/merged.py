"""Results merged from partial states: quartiles, histograms and clusters of several datasets, and running statistics of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortlens.model import AlgorithmSpec, ExperimentQuery, FeatureTable, MiningQuery, ValidationSpec
from cohortlens.operators.sketches import rank_error
from cohortlens.plans import federation
from cohortlens.plans.cached import cached_mining
from cohortlens.plans.experiment import run_experiment
from cohortlens.plans.mining import run_mining
from cohortlens.queries import COHORT_SQL, cohort, query, rounded, table
from cohortlens.queries.models import _cv_source, _multiclass_sql
from cohortlens.session import checkpoint_dir
from cohortlens.sources.cache import table_fingerprint
from cohortlens.sources.manifest import table_mark
from cohortlens.sources.tables import Catalog
from cohortlens.streaming import keyed, states

QUARTILES = (0.25, 0.5, 0.75)


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/cohortlens-{name}-{uuid.uuid4().hex}"


def _ranks(found, rows, by=()):
    """Per group, variable and quartile: the values, and whether the quartile's rank is off by no more than the sketch's bound."""
    values = found.select(*by, "variable", "count", F.inline(F.array(*[
        F.struct(F.lit(p).alias("p"), F.col(f"`{100 * p:.0f}%`").alias("q")) for p in QUARTILES])))
    names = [r["variable"] for r in found.select("variable").distinct().collect()]
    long = rows.select(*by, F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in names]))).filter("x IS NOT NULL")
    # three rows per group and variable: by these keys a shuffle would put each variable's rows into one task
    ranked = long.join(F.broadcast(values), [*by, "variable"]).groupBy(*by, "variable", "p", "count").agg(
        F.count_if(F.col("x") < F.col("q")).alias("below"), F.count_if(F.col("x") <= F.col("q")).alias("upto"))
    off = F.greatest(F.col("below") / F.col("count") - F.col("p"), F.col("p") - F.col("upto") / F.col("count"))
    return ranked.select(*by, "variable", F.round(100 * F.col("p")).cast("int").alias("percent"), "count", (off <= rank_error()).alias("close"))


@query("map_reduce_quartiles", "\nUNION ALL ".join(f"""
SELECT '{v}' AS variable, CAST(unnest([25, 50, 75]) AS INTEGER) AS percent, count({v}) AS "count", TRUE AS close FROM lineitem"""
    for v in ("l_quantity", "l_extendedprice", "l_discount")))
def map_reduce_quartiles(spark, d):
    """Quartiles from one stored state per return flag; their ranks are counted in the rows afterwards."""
    rows, path = table(spark, d, "lineitem"), _folder(spark, "states")
    found = federation.partial_state("statisticsSummary", rows, ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag")
    federation.write_states(found, path, "statisticsSummary", "all")
    return _ranks(federation.merge_state("statisticsSummary", federation.read_states(spark, path, "statisticsSummary", ["all"])), rows)


@query("map_reduce_quartiles_small", """
SELECT c_nationkey, count(*) AS "count", quantile_disc(c_acctbal, 0.25) AS q25, quantile_disc(c_acctbal, 0.5) AS q50,
 quantile_disc(c_acctbal, 0.75) AS q75, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1""")
def map_reduce_quartiles_small(spark, d):
    """Groups of no more values than a sketch keeps have exact quartiles, also when merged from five datasets."""
    found = federation.partial_statistics(table(spark, d, "customer"), ["c_acctbal"], "c_mktsegment", ["c_nationkey"])[0]
    return federation.merge_summary(found, ["c_nationkey"]).select(
        "c_nationkey", "count", F.col("25%").alias("q25"), F.col("50%").alias("q50"), F.col("75%").alias("q75"), "min", "max")


def _mine(spark, d, code, variables, parameters=None, grouping=(), covariables=()):
    catalog = Catalog([FeatureTable("cohort", lambda s: cohort(s, d), "c_custkey", "r_name")])
    out = run_mining(spark, catalog, MiningQuery(
        variables=variables, covariables=covariables, grouping=grouping, target_table="cohort", datasets=("ASIA", "EUROPE"),
        algorithm=AlgorithmSpec(code, parameters or {})))
    if not out.merged:
        raise ValueError(f"{code} did not go through states per dataset")
    return out.data


_TWO = f"(SELECT * FROM {COHORT_SQL} WHERE r_name IN ('ASIA', 'EUROPE'))"


@query("mining_summary_merged", f"""
SELECT grp AS "group", 'c_acctbal' AS "index", count(*) AS "count", CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, round(avg(c_acctbal), 5) AS mean,
 round(quantile_cont(c_acctbal, 0.25), 5) AS q25, round(median(c_acctbal), 5) AS q50, round(quantile_cont(c_acctbal, 0.75), 5) AS q75
FROM (SELECT c_mktsegment AS grp, c_acctbal FROM {_TWO} UNION ALL SELECT 'all', c_acctbal FROM {_TWO}) GROUP BY 1
UNION ALL
SELECT grp, 'n_name', CAST(sum(n) AS BIGINT), count(*), arg_min(n_name, (-n, n_name)), NULL, NULL, NULL, NULL
FROM (SELECT grp, n_name, count(*) AS n FROM (SELECT c_mktsegment AS grp, n_name FROM {_TWO} UNION ALL SELECT 'all', n_name FROM {_TWO}) GROUP BY ALL) GROUP BY 1""")
def mining_summary_merged(spark, d):
    """A numeric and a nominal variable over two datasets, by way of one state per dataset and group."""
    out = _mine(spark, d, "statisticsSummary", ("c_acctbal",), covariables=("n_name",), grouping=("c_mktsegment",))
    return rounded(out.select(F.col("group")[0].alias("group"), "index", "count", "unique", "top", "mean", F.col("25%").alias("q25"),
                              F.col("50%").alias("q50"), F.col("75%").alias("q75")), 5)


@query("mining_histogram_merged", f"""
WITH c AS {_TWO}, e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM c),
s AS (SELECT c_mktsegment AS grp, c_acctbal AS x FROM c UNION ALL SELECT 'all', c_acctbal FROM c),
b AS (SELECT grp, least(floor((x - lo) / ((hi - lo) / 10)), 9) AS bin, count(*) AS n FROM s, e GROUP BY ALL)
SELECT g.grp AS "group", CAST(r.bin AS INTEGER) AS bin, coalesce(b.n, 0) AS "count"
FROM (SELECT DISTINCT grp FROM s) g CROSS JOIN range(10) r(bin) LEFT JOIN b ON b.grp = g.grp AND b.bin = r.bin""")
def mining_histogram_merged(spark, d):
    out = _mine(spark, d, "histograms", ("c_acctbal",), {"bins": 10}, ("c_mktsegment",))
    return out.select(F.col("group")[0].alias("group"), "bin", "count")


@query("mining_categories_merged", f"""
SELECT r AS "group", c_mktsegment AS category, count(*) AS "count"
FROM (SELECT n_name AS r, c_mktsegment FROM {_TWO} UNION ALL SELECT 'all', c_mktsegment FROM {_TWO}) GROUP BY ALL""")
def mining_categories_merged(spark, d):
    out = _mine(spark, d, "histograms", ("c_mktsegment",), grouping=("n_name",))
    return out.select(F.col("group")[0].alias("group"), "category", "count")


@query("mining_kmeans_merged", f"""
SELECT count(*) AS n, 4 AS clusters, 0.0::DOUBLE AS away, TRUE AS nearest, TRUE AS tight FROM {_TWO}""")
def mining_kmeans_merged(spark, d):
    """Clusters of two datasets: every centre is the mean of its rows, and every row is in the cluster of the nearest centre."""
    centres = _mine(spark, d, "kmeans", ("c_acctbal",), {"n_clusters": 4})
    assigned = _mine(spark, d, "kmeans", ("c_acctbal",), {"n_clusters": 4, "result": "assignments"})
    rows = assigned.join(cohort(spark, d), "c_custkey").join(
        F.broadcast(centres.select("cluster", F.col("c_acctbal").alias("centre"))), "cluster")  # one row per cluster
    gaps = F.array(*[F.abs(F.col("c_acctbal") - F.lit(r["c_acctbal"])) for r in centres.collect()])
    rows = rows.withColumn("nearest", F.abs(F.col("c_acctbal") - F.col("centre")) <= F.array_min(gaps) + 1e-9)
    per = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.avg("c_acctbal") - F.first("centre")).alias("away"), F.every("nearest").alias("nearest"),
        F.sum(F.pow(F.col("c_acctbal") - F.col("centre"), 2)).alias("inside"), F.sum("c_acctbal").alias("s"), F.sum(F.pow("c_acctbal", F.lit(2))).alias("s2"))
    whole = F.sum("s2") - F.sum("s") * F.sum("s") / F.sum("n")
    return per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("int").alias("clusters"), F.round(F.max("away"), 6).alias("away"),
                   F.every("nearest").alias("nearest"), (F.sum("inside") < whole / 8).alias("tight"))


@query("stream_quartiles", """
SELECT event_type, 'value' AS variable, CAST(unnest([25, 50, 75]) AS INTEGER) AS percent, count(value) AS "count", TRUE AS close FROM events GROUP BY 1""")
def stream_quartiles(spark, d):
    path, events = _folder(spark, "stream"), table(spark, d, "events")
    stream = states.file_stream(spark, d, events.schema, "events.parquet")
    states.stream_states(stream, path, ["value"], ["event_type"]).awaitTermination()
    return _ranks(states.read_stream_summary(spark, path, ["event_type"]), events, ["event_type"])


def _arrivals(spark, d, batches: int, folder: str):
    """The events in so many files, which a stream takes one by one."""
    events = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value") - 20))
    events.repartition(batches, "event_id").write.parquet(folder)
    return events.schema


def _restarted(spark, d, batches: int):
    """Checkpoint of a stream that ran over the first files, stopped, and went on with the others."""
    arrived, checkpoint = _folder(spark, "arrived"), _folder(spark, "progress")
    schema = _arrivals(spark, d, batches, arrived)
    for pattern in ("part-000[0-2]*.parquet", "*.parquet"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", pattern).parquet(arrived)
        keyed.running_statistics(stream, checkpoint, ["value", "user_id"], ["event_type"]).awaitTermination()
    return checkpoint


_SHIFTED = "(SELECT event_type, user_id, CASE WHEN event_id % 10 <> 0 THEN value - 20 END AS value FROM events)"


@query("stream_keyed_restart", "\nUNION ALL ".join(f"""
SELECT event_type, '{v}' AS variable, count({v}) AS "count", count(*) - count({v}) AS null_count, round(avg({v}), 6) AS mean,
 round(stddev_samp({v}), 6) AS std, CAST(min({v}) AS DOUBLE) AS min, CAST(max({v}) AS DOUBLE) AS max FROM {_SHIFTED} GROUP BY 1"""
    for v in ("value", "user_id")))
def stream_keyed_restart(spark, d):
    """Running statistics in the state store after fifty micro-batches and a restart in between."""
    found = keyed.read_statistics(spark, _restarted(spark, d, 50), ["event_type"])
    return rounded(found.drop("EX^2"))


@query("stream_keyed_bins", f"""
WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM {_SHIFTED} GROUP BY 1),
w AS (SELECT event_type, min(pow(2.0, k)) AS size FROM e, range(-20, 30) r(k)
 WHERE floor(hi / pow(2.0, k)) - floor(lo / pow(2.0, k)) < 64 GROUP BY 1),
b AS (SELECT event_type, size, floor(value / size) AS place, count(*) AS n FROM {_SHIFTED} JOIN w USING (event_type) WHERE value IS NOT NULL GROUP BY ALL)
SELECT event_type, place * size AS low, (place + 1) * size AS high, n AS "count" FROM b""")
def stream_keyed_bins(spark, d):
    """Bins whose width doubled as the range grew, without ranges given beforehand; six micro-batches."""
    found = keyed.read_bins(spark, _restarted(spark, d, 6), ["event_type"])
    return found.filter("variable = 'value' AND count > 0").select("event_type", "low", "high", "count")


@query("experiment_scores", _cv_source(4) + "\n" + _multiclass_sql("p", "CAST(f AS VARCHAR)") + "\nUNION ALL " + _multiclass_sql("p", "'all'"))
def experiment_scores(spark, d):
    """Fold and pooled scores of a model that an experiment trained and validated beside another algorithm."""
    source = lambda s: table(s, d, "orders").drop("o_orderdate")
    catalog = Catalog([FeatureTable("orders", source, "o_orderkey")])
    out = run_experiment(spark, catalog, ExperimentQuery(
        variables=("o_orderstatus",), covariables=("o_totalprice",), target_table="orders",
        algorithms=(AlgorithmSpec("statisticsSummary"), AlgorithmSpec("naiveBayes")), validations=(ValidationSpec("kfold", {"k": 4}),)))
    numbers = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "weighted_fpr"]
    scores = out.filter("algorithm = 'naiveBayes' AND result = 'kfold'").select(
        F.from_json("data", "fold string, n long, " + ", ".join(f"{c} double" for c in numbers)).alias("s")).select("s.*")
    return rounded(scores, 8)


@query("mining_not_cached", """
WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS q,
  (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () * sign(corr(l_quantity, l_extendedprice) OVER ()) AS p FROM lineitem),
s AS (SELECT unnest([1, -1]) * (l_orderkey * 10 + l_linenumber) AS id, (q + p) / sqrt(2) AS pc1 FROM z),
few AS (SELECT 2 * count(*) <= 100000 AS f FROM lineitem)
SELECT id, round(pc1, 5) AS pc1, f AS stored, f AS again_from_cache FROM s, few""")
def mining_not_cached(spark, d):
    """Every row twice: above 100,000 scores the result comes back whole and is not stored."""
    source = lambda s: table(s, d, "lineitem").select(
        F.explode(F.array(F.lit(1), F.lit(-1))).alias("copy"), "*").select(
        (F.col("copy") * (F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias("id"), "l_quantity", "l_extendedprice")
    catalog, path = Catalog([FeatureTable("lines", source, "id")]), _folder(spark, "cache")
    asked = MiningQuery(variables=("l_quantity", "l_extendedprice"), target_table="lines",
                        algorithm=AlgorithmSpec("pca", {"result": "scores", "k": 2}))
    first, second = cached_mining(spark, catalog, asked, path), cached_mining(spark, catalog, asked, path)
    row = F.from_json("row", "id long, PC1 double").alias("r")
    return second.data.select(row).select("r.id", F.round("r.PC1", 5).alias("pc1"), F.lit(first.stored).alias("stored"),
                                          F.lit(second.from_cache).alias("again_from_cache"))


@query("fingerprint_by_files", """
SELECT event_type, count(*) AS "rows", TRUE AS same_as_whole, TRUE AS same_again FROM events GROUP BY 1
UNION ALL SELECT 'all', count(*), TRUE, TRUE FROM events""")
def fingerprint_by_files(spark, d):
    """Fingerprints of a table whose files come one by one: always that of the whole table as it is."""
    data, manifest, e = _folder(spark, "files"), _folder(spark, "manifest"), table(spark, d, "events")
    held, out = FeatureTable("events", data), []
    for kind in ("click", "error", "purchase", "signup", "view", "all"):
        if kind != "all":
            e.filter(F.col("event_type") == kind).repartition(2).write.mode("append").parquet(data)
        before = out[-1][1] if out else 0
        mark = table_mark(spark, held, manifest)
        whole = "-".join(map(str, table_fingerprint(spark.read.parquet(data)).first()))
        total = int(mark.split("-", 1)[0])
        out.append((kind, total, total if kind == "all" else total - before, mark == whole, table_mark(spark, held, manifest) == mark))
    return spark.createDataFrame([(k, n, a, b) for k, _, n, a, b in out], "event_type string, rows long, same_as_whole boolean, same_again boolean")
