"""Models of very many categories or columns, next to their closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.model import AlgorithmSpec, FeatureTable, MiningQuery
from cohortlens.operators import absorb, anova, hist_boosting, knn_pivots, linear, regression, subgroups, walks, wide_pca
from cohortlens.plans.mining import run_mining
from cohortlens.queries import query, rounded, table
from cohortlens.sources.tables import Catalog

# Sums within and between the orders, of price on quantity; an order is a category.
_GROUPS = """g AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
 coalesce(regr_sxx(l_extendedprice, l_quantity), 0) AS sxx, coalesce(regr_sxy(l_extendedprice, l_quantity), 0) AS sxy,
 coalesce(regr_syy(l_extendedprice, l_quantity), 0) AS syy FROM lineitem GROUP BY 1),
w AS (SELECT sum(sxy) / sum(sxx) AS b, sum(sxx) AS sxx, (sum(syy) - sum(sxy) / sum(sxx) * sum(sxy)) / (sum(n) - count(*) - 1) AS s2, sum(n) AS n, count(*) AS k,
 sum(syy) - sum(sxy) / sum(sxx) * sum(sxy) AS rss, sum(syy) AS syy FROM g)"""

_OFF_TIES = 0.0000012345  # means of few prices end in a 5, which the engines may round either way


def _lines(spark, d):
    return table(spark, d, "lineitem").withColumn("order", F.col("l_orderkey").cast("string"))


@query("regression_many_categories", f"""
WITH {_GROUPS}, z AS (SELECT * FROM g ORDER BY k LIMIT 1),
r AS (SELECT 'intercept' AS term, z.my - b * z.mx AS coef, sqrt(s2 * (1.0 / z.n + z.mx * z.mx / w.sxx)) AS se FROM z, w
 UNION ALL SELECT 'l_quantity', b, sqrt(s2 / sxx) FROM w
 UNION ALL SELECT 'order[' || g.k || ']', g.my - z.my - b * (g.mx - z.mx),
  sqrt(s2 * (1.0 / g.n + 1.0 / z.n + (g.mx - z.mx) * (g.mx - z.mx) / w.sxx)) FROM g, z, w WHERE g.k <> z.k)
SELECT term, round(coef, 4) AS coef, round(se, 4) AS std_err, round(coef / se, 5) AS t_values FROM r""")
def regression_many_categories(spark, d):
    """Price on quantity and order: one row per order, as if every order were a 0/1 term."""
    out = regression.linear_regression(_lines(spark, d), "l_extendedprice", ["l_quantity", "order"])
    return out.select("term", F.round("coef", 4).alias("coef"), F.round("std_err", 4).alias("std_err"), F.round("t_values", 5).alias("t_values"))


@query("regression_many_categories_predicted", f"""
WITH {_GROUPS} SELECT l_orderkey, l_linenumber, round(g.my + b * (l_quantity - g.mx) + {_OFF_TIES}, 4) AS prediction
FROM lineitem JOIN g ON g.k = CAST(l_orderkey AS VARCHAR), w""")
def regression_many_categories_predicted(spark, d):
    model = regression.fit_linear(_lines(spark, d), "l_extendedprice", ["l_quantity", "order"])
    found = model.predict(_lines(spark, d))
    return rounded(found.select("l_orderkey", "l_linenumber", (F.col("prediction") + _OFF_TIES).alias("prediction")), 4)


@query("anova_many_categories", f"""
WITH {_GROUPS}, t AS (SELECT regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_sxy(l_extendedprice, l_quantity) AS sxy,
 regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem),
s AS (SELECT t.sxy * t.sxy / t.sxx AS sx, t.syy - t.sxy * t.sxy / t.sxx - rss AS sf, rss, k, n - k - 1 AS rdf FROM t, w)
SELECT 'l_quantity' AS term, 1 AS df, round(sx / 1e6, 4) AS sum_sq, round(sx / (rss / rdf), 4) AS f FROM s
UNION ALL SELECT 'order', CAST(k - 1 AS INTEGER), round(sf / 1e6, 4), round(sf / (k - 1) / (rss / rdf), 4) FROM s
UNION ALL SELECT 'Residual', CAST(rdf AS INTEGER), round(rss / 1e6, 4), NULL FROM s""")
def anova_many_categories(spark, d):
    out = anova.anova(_lines(spark, d), "l_extendedprice", ["l_quantity", "order"], "additive")
    return out.select("term", "df", F.round(F.col("sum_sq") / 1e6, 4).alias("sum_sq"), F.round("F", 4).alias("f"))


@query("anova_many_categories_first", f"""
WITH {_GROUPS}, t AS (SELECT regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem)
SELECT 'order' AS term, CAST(k - 1 AS INTEGER) AS df, round((t.syy - w.syy) / 1e6, 4) AS sum_sq FROM t, w
UNION ALL SELECT 'l_quantity', 1, round((syy - rss) / 1e6, 4) FROM w
UNION ALL SELECT 'Residual', CAST(n - k - 1 AS INTEGER), round(rss / 1e6, 4) FROM w""")
def anova_many_categories_first(spark, d):
    """As a mining query; the sums of squares follow the order of the factors."""
    catalog = Catalog([FeatureTable("lines", lambda s: _lines(s, d).drop("l_shipdate", "l_commitdate", "l_receiptdate"), "l_orderkey")])
    out = run_mining(spark, catalog, MiningQuery(
        variables=("l_extendedprice",), covariables=("order", "l_quantity"), target_table="lines",
        algorithm=AlgorithmSpec("anova", {"design": "additive"}))).data
    return out.select("term", "df", F.round(F.col("sum_sq") / 1e6, 4).alias("sum_sq"))


# one row per user and event type makes the two factors balanced, so that taking off both means is the closed form
_CELLS = "(SELECT CAST(u.user_id AS VARCHAR) AS usr, t.event_type, coalesce(sum(e.value), 0.0) AS y, count(e.event_id) AS x FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL)"


def _cells(spark, d):
    e = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"])
    wide = e.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("y"), F.count("event_id").alias("x"))
    each = [F.struct(F.lit(t).alias("event_type"), F.coalesce(F.col(f"{t}_y"), F.lit(0.0)).alias("y"), F.coalesce(F.col(f"{t}_x"), F.lit(0)).alias("x"))
            for t in ("click", "error", "purchase", "signup", "view")]
    return wide.select(F.col("user_id").cast("string").alias("usr"), F.inline(F.array(*each)))


@query("regression_two_absorbed", f"""
WITH c AS (SELECT *, avg(x) OVER (PARTITION BY usr) AS xu, avg(x) OVER (PARTITION BY event_type) AS xe, avg(x) OVER () AS xa,
  avg(y) OVER (PARTITION BY usr) AS yu, avg(y) OVER (PARTITION BY event_type) AS ye, avg(y) OVER () AS ya FROM {_CELLS}),
r AS (SELECT *, x - xu - xe + xa AS dx, y - yu - ye + ya AS dy FROM c),
b AS (SELECT sum(dx * dy) / sum(dx * dx) AS b, sum(dx * dx) AS sxx, sum(dy * dy) AS syy, count(*) - (count(DISTINCT usr) + count(DISTINCT event_type) - 1) - 1 AS df FROM r),
m AS (SELECT DISTINCT 'usr[' || usr || ']' AS term, usr AS k, 1 AS f, yu - b * xu AS v FROM c, b UNION ALL
      SELECT DISTINCT 'event_type[' || event_type || ']', event_type, 2, ye - b * xe FROM c, b)
SELECT 'x' AS term, round(b, 5) AS coef, round(sqrt((syy - b * b * sxx) / df / sxx), 5) AS std_err FROM b
UNION ALL SELECT 'intercept', round((SELECT v FROM m WHERE f = 1 ORDER BY k LIMIT 1) + (SELECT v FROM m WHERE f = 2 ORDER BY k LIMIT 1)
  - (SELECT any_value(ya) - any_value(xa) * (SELECT b FROM b) FROM c), 4), NULL
UNION ALL SELECT term, round(v - (SELECT v FROM m i WHERE i.f = m.f ORDER BY k LIMIT 1), 4), NULL FROM m
 WHERE k <> (SELECT k FROM m i WHERE i.f = m.f ORDER BY k LIMIT 1)""")
def regression_two_absorbed(spark, d):
    """Two factors absorbed at once by conjugate gradients."""
    out = absorb.absorbed_regression(_cells(spark, d), "y", ["x"], ["usr", "event_type"]).rows(spark)
    digits = F.when(F.col("term") == "x", F.round("coef", 5)).otherwise(F.round("coef", 4))
    return out.select("term", digits.alias("coef"), F.round("std_err", 5).alias("std_err"))


# 200 columns that copy two in turn: the correlation matrix has the values 100 (1 + r) and 100 (1 - r), all others 0
_R = "(SELECT abs(corr(value, user_id)) AS r, corr(value, user_id) < 0 AS minus FROM events)"


@query("pca_wide", f"""
SELECT 'PC1' AS component, round(50 * (1 + r), 6) AS explained, 200 AS columns, TRUE AS settled FROM {_R}
UNION ALL SELECT 'PC2', round(50 * (1 - r), 6), 200, TRUE FROM {_R}""")
def pca_wide(spark, d):
    e = table(spark, d, "events")
    copies = [(F.col("value") * (i + 1) + i if i % 2 else F.col("user_id") / (i + 1) - i).alias(f"c{i}") for i in range(200)]
    model = wide_pca.wide_pca(e.select(*copies), [f"c{i}" for i in range(200)], 2)
    out = model.explained(spark).select("component", F.round("explained_variance", 6).alias("explained"))
    return out.withColumn("columns", F.lit(len(model.columns))).withColumn("settled", F.lit(model.residual < 1e-9))


@query("pca_wide_scores", f"""
WITH z AS (SELECT event_id, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS v, (user_id - avg(user_id) OVER ()) / stddev_pop(user_id) OVER () AS u FROM events)
SELECT event_id, round(abs(10 * (v + CASE WHEN minus THEN -u ELSE u END) / sqrt(2)), 4) AS pc1, round(abs(10 * (v - CASE WHEN minus THEN -u ELSE u END) / sqrt(2)), 4) AS pc2
FROM z, {_R}""")
def pca_wide_scores(spark, d):
    """Scores from an array column of 200 places; their signs are a matter of which copy comes first."""
    e = table(spark, d, "events")
    places = F.array(*[(F.col("value") * (i + 1) + i if i % 2 else F.col("user_id") / (i + 1) - i) for i in range(200)])
    e = e.select("event_id", places.alias("x"))
    scores = wide_pca.wide_pca(e, "x", 2).scores(e)
    return scores.select("event_id", F.round(F.abs("PC1"), 4).alias("pc1"), F.round(F.abs("PC2"), 4).alias("pc2"))


@query("knn_many_columns", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
r AS (SELECT q.vec_id AS q, t.vec_id AS t, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, t.e), t.vec_id) AS place
 FROM v q, v t WHERE q.vec_id % 20 = 0)
SELECT q AS vec_id, CAST(sum(t) AS BIGINT) AS neighbours FROM r WHERE place <= 6 GROUP BY 1""")
def knn_many_columns(spark, d):
    """The six nearest of all vectors, in 64 columns, for every twentieth vector (itself among them)."""
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL")
    dims = len(v.first()["embedding"])
    xs = [F.get("embedding", F.lit(i)).cast("double").alias(f"_x{i}") for i in range(dims)]
    train = v.select(F.col("vec_id").alias("_key"), F.lit(0.0).alias("_y"), *xs)
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("_q"), *xs)
    found = knn_pivots.pivot_neighbours(train, asked, dims, 6)
    return found.select(F.col("_q").alias("vec_id"), F.aggregate("near", F.lit(0).cast("long"), lambda a, n: a + n["neighbour"]).alias("neighbours"))


# Rules on three nominal and two binned variables, as the beam search finds them, with the exact one-sided test.
_RULE_XS = ["shift", "size", "l_linestatus", "l_quantity", "l_discount"]


def _rules_sql(beam: int, support: float) -> str:
    cells = """SELECT l_returnflag AS t, ['shift=' || CASE WHEN l_linenumber > 4 THEN 'late' ELSE 'early' END,
 'size=' || (l_partkey % 3), 'l_linestatus=' || l_linestatus,
 CASE least(floor((l_quantity - ql) / ((qh - ql) / 4)), 3) WHEN 0 THEN printf('%g<=l_quantity<%g', ql, ql + (qh - ql) / 4)
  WHEN 1 THEN printf('%g<=l_quantity<%g', ql + (qh - ql) / 4, ql + 2 * (qh - ql) / 4)
  WHEN 2 THEN printf('%g<=l_quantity<%g', ql + 2 * (qh - ql) / 4, ql + 3 * (qh - ql) / 4) ELSE printf('%g<=l_quantity<=%g', ql + 3 * (qh - ql) / 4, ql + 4 * (qh - ql) / 4) END,
 CASE least(floor((l_discount - dl) / ((dh - dl) / 4)), 3) WHEN 0 THEN printf('%g<=l_discount<%g', dl, dl + (dh - dl) / 4)
  WHEN 1 THEN printf('%g<=l_discount<%g', dl + (dh - dl) / 4, dl + 2 * (dh - dl) / 4)
  WHEN 2 THEN printf('%g<=l_discount<%g', dl + 2 * (dh - dl) / 4, dl + 3 * (dh - dl) / 4) ELSE printf('%g<=l_discount<=%g', dl + 3 * (dh - dl) / 4, dl + 4 * (dh - dl) / 4) END] AS c
 FROM lineitem, (SELECT min(l_quantity) AS ql, max(l_quantity) AS qh, min(l_discount) AS dl, max(l_discount) AS dh FROM lineitem)"""
    places = range(1, 6)
    one = " UNION ALL ".join(f"SELECT [{i}] AS pl, [c[{i}]] AS rule, t, n FROM d" for i in places)
    two = " UNION ALL ".join(f"SELECT [{i}, {j}] AS pl, [c[{i}], c[{j}]] AS rule, t, n FROM d" for i in places for j in places if i < j)

    def scored(rows):
        return f"""SELECT pl, rule, t, cov, pos, pos / cov AS prec, pos / cov / (positives / total) AS lift, positives, total FROM
 (SELECT pl, rule, sum(n) AS cov, map_from_entries(list((t, n))) AS by_class FROM (SELECT pl, rule, t, sum(n) AS n FROM ({rows}) GROUP BY ALL) GROUP BY pl, rule) x
 CROSS JOIN (SELECT t, sum(n) AS positives, (SELECT sum(n) FROM d) AS total FROM d GROUP BY t) k CROSS JOIN LATERAL (SELECT coalesce(by_class[t], 0) AS pos)
 WHERE cov >= {support} * total AND pos > 0"""

    best = f"QUALIFY row_number() OVER (PARTITION BY t ORDER BY lift DESC, pos DESC, rule) <= {beam}"
    return f"""
WITH d AS (SELECT t, c, count(*) AS n FROM ({cells}) GROUP BY ALL),
s1 AS (SELECT * FROM ({scored(one)}) {best}),
s2 AS (SELECT * FROM ({scored(two)}) x WHERE EXISTS (SELECT 1 FROM s1 WHERE s1.t = x.t AND list_has_all(x.rule, s1.rule)) {best}),
r AS (SELECT *, 1 AS depth FROM s1 WHERE lift > 1 UNION ALL SELECT *, 2 FROM s2 WHERE lift > 1),
p AS (SELECT r.*, (SELECT sum(exp(lgamma(positives + 1) - lgamma(k + 1) - lgamma(positives - k + 1)
  + lgamma(total - positives + 1) - lgamma(cov - k + 1) - lgamma(total - positives - cov + k + 1) - lgamma(total + 1) + lgamma(cov + 1) + lgamma(total - cov + 1)))
  FROM (SELECT unnest(range(CAST(pos AS BIGINT), CAST(least(cov, positives) AS BIGINT) + 1)) AS k) WHERE cov - k <= total - positives) AS pval FROM r)
SELECT 'l_returnflag=' || t AS target, array_to_string(rule, ', ') AS rule, depth, CAST(cov AS BIGINT) AS cov, CAST(pos AS BIGINT) AS pos, round(prec, 8) AS prec,
 round(lift, 8) AS lift, round(pval, 6) AS pval FROM p WHERE pval <= 0.05"""


@query("subgroup_rules_tested", _rules_sql(6, 0.02))
def subgroup_rules_tested(spark, d):
    """Rules of up to two conditions with text, counts and test."""
    rows = table(spark, d, "lineitem").withColumn("shift", F.when(F.col("l_linenumber") > 4, "late").otherwise("early"))
    rows = rows.withColumn("size", (F.col("l_partkey") % 3).cast("string"))
    out = subgroups.subgroups(rows, "l_returnflag", _RULE_XS, beam=6, support=0.02, depth=2)
    return out.select("target", "rule", "depth", "cov", "pos", F.round("prec", 8).alias("prec"), F.round("lift", 8).alias("lift"), F.round("pval", 6).alias("pval"))


# First round of three one-cut trees: residuals of each class, the best of the four cuts, Newton leaves.
@query("boosting_three_classes", """
WITH k AS (SELECT o_orderstatus AS class, count(*) AS c, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1),
r AS (SELECT o_orderpriority AS v, class, share, count(*) AS n, count(*) FILTER (o_orderstatus = class) - count(*) * share AS r,
  count(*) * share * (1 - share) AS h FROM orders, k GROUP BY o_orderpriority, class, share),
s AS (SELECT class, v, share, n, r, h, sum(n) OVER w - n AS n0, sum(r) OVER w - r AS r0, sum(h) OVER w - h AS h0 FROM r WINDOW w AS (PARTITION BY class)),
b AS (SELECT *, 2 / 3 * r / h AS inside, 2 / 3 * r0 / h0 AS outside FROM s WHERE v > (SELECT min(o_orderpriority) FROM orders)
  QUALIFY row_number() OVER (PARTITION BY class ORDER BY r * r / n + r0 * r0 / n0 DESC, v) = 1)
SELECT r.v AS priority, r.class, round(ln(r.share) + 0.1 * CASE WHEN r.v = b.v THEN inside ELSE outside END, 8) AS score FROM r JOIN b USING (class)""")
def boosting_three_classes(spark, d):
    o = table(spark, d, "orders")
    model = hist_boosting.histogram_boosting(o, "o_orderstatus", ["o_orderpriority"], n_estimators=1, max_depth=1)
    scored = model.score_frame(o.select("o_orderpriority").distinct())
    each = [F.struct(F.lit(c).alias("class"), F.round(F.get("scores", F.lit(k)), 8).alias("score")) for k, c in enumerate(model.classes)]
    return scored.select(F.col("o_orderpriority").alias("priority"), F.inline(F.array(*each)))


@query("boosting_residual_rounds", """
WITH RECURSIVE p AS (SELECT o_orderpriority AS v, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1),
t AS (SELECT 0 AS round, map_from_entries(list((v, (SELECT sum(s) / sum(n) FROM p)))) AS score FROM p
 UNION ALL
 SELECT round + 1, (SELECT map_from_entries(list((p.v, t.score[p.v] + 0.1 * CASE WHEN p.v = b.v THEN b.r / b.n ELSE b.r0 / b.n0 END))) FROM p, (
  SELECT * FROM (SELECT v, r, n, sum(r) OVER () - r AS r0, sum(n) OVER () - n AS n0, min(v) OVER () AS first
   FROM (SELECT v, n, s - n * t.score[v] AS r FROM p)) WHERE v > first ORDER BY r * r / n + r0 * r0 / n0 DESC, v LIMIT 1) b) FROM t WHERE round < 6)
SELECT v AS priority, round(score[v], 4) AS prediction FROM t, p WHERE round = 6""")
def boosting_residual_rounds(spark, d):
    """Six rounds of one-cut trees on what the rounds before left."""
    o = table(spark, d, "orders")
    model = hist_boosting.histogram_boosting(o, "o_totalprice", ["o_orderpriority"], n_estimators=6, max_depth=1)
    return rounded(model.predict(o.select(F.col("o_orderpriority")).distinct()).withColumnRenamed("o_orderpriority", "priority"), 4)


def _walk_sql(damping: float, turns: int) -> str:
    """Full iteration over the pairs of priority and status, from every 5000th order."""
    ctes = [f"""q AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS m FROM orders GROUP BY ALL),
va AS (SELECT a, sum(m) AS deg FROM q GROUP BY 1), vb AS (SELECT b, sum(m) AS deg FROM q GROUP BY 1),
s AS (SELECT o_orderkey AS seed, o_orderpriority AS a, o_orderstatus AS b FROM orders WHERE o_orderkey % 5000 = 1),
y0 AS MATERIALIZED (SELECT seed, a, b, 1.0::DOUBLE AS y FROM s)"""]
    for i in range(turns):
        ctes.append(f"""a{i} AS (SELECT seed, a, sum(y) * {damping / 2}::DOUBLE / any_value(deg) AS f FROM y{i} JOIN va USING (a) GROUP BY seed, a),
b{i} AS (SELECT seed, b, sum(y) * {damping / 2}::DOUBLE / any_value(deg) AS f FROM y{i} JOIN vb USING (b) GROUP BY seed, b),
y{i + 1} AS MATERIALIZED (SELECT s.seed, q.a, q.b, q.m * (coalesce(a{i}.f, 0) + coalesce(b{i}.f, 0)) AS y FROM s CROSS JOIN q
 LEFT JOIN a{i} ON a{i}.seed = s.seed AND a{i}.a = q.a LEFT JOIN b{i} ON b{i}.seed = s.seed AND b{i}.b = q.b)""")
    every = " UNION ALL ".join(f"SELECT seed, a, b, y * {1 - damping} AS y FROM y{i}" for i in range(turns + 1))
    return "WITH " + ",\n".join(ctes) + f"""
SELECT seed, a AS priority, b AS status, m AS subjects, round(sum(y), 3) AS score FROM ({every}) JOIN q USING (a, b) GROUP BY ALL HAVING sum(y) > 1e-6"""


@query("subject_walks", _walk_sql(0.3, 18))
def subject_walks(spark, d):
    """Where walks from some orders over priorities and statuses go, added up over orders alike."""
    o = table(spark, d, "orders")
    seeds = o.filter("o_orderkey % 5000 = 1").select("o_orderkey")
    alike = ["o_orderpriority", "o_orderstatus"]
    found = walks.subject_walks(o, "o_orderkey", alike, seeds, 0.3, 1e-8, totals=alike)
    return found.select("seed", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
                        "subjects", F.round("score", 3).alias("score"))


# one standardised input: shrunk by 1 + share of l2 / spread of the target, after the share of l1 is taken off
@query("linear_model_penalised", """
WITH m AS (SELECT covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS c, stddev_pop(l_extendedprice) AS sy, avg(l_extendedprice) AS my FROM lineitem),
p(penalty, alpha, l1) AS (VALUES ('l2', 0.1, 0.0), ('l2', 900.0, 0.0), ('l1', 10.0, 1.0), ('l1', 1e6, 1.0), ('elasticnet', 40.0, 0.15))
SELECT penalty, CAST(alpha AS DOUBLE) AS alpha, round(sign(c) * greatest(abs(c) - alpha * l1, 0) / (1 + alpha * (1 - l1) / sy), 4) + 0.0 AS coef, round(my, 4) AS intercept FROM p, m""")
def linear_model_penalised(spark, d):
    """Penalised least squares against their closed forms, also where the penalty leaves nothing."""
    li, out = table(spark, d, "lineitem"), None
    for penalty, alpha in (("l2", 0.1), ("l2", 900.0), ("l1", 10.0), ("l1", 1e6), ("elasticnet", 40.0)):
        rows = linear.linear_model(li, "l_extendedprice", ["l_quantity"], alpha=alpha, penalty=penalty).rows(spark)
        row = rows.agg(F.max(F.when(F.col("term") == "l_quantity", F.col("coef"))).alias("coef"),
                       F.max(F.when(F.col("term") == "intercept", F.col("coef"))).alias("intercept")).select(
            F.lit(penalty).alias("penalty"), F.lit(alpha).alias("alpha"), (F.round("coef", 4) + 0.0).alias("coef"), F.round("intercept", 4).alias("intercept"))
        out = row if out is None else out.unionByName(row)
    return out


# with three groups the tail of F(2, d) is (1 + 2 F / d) ** (-d / 2)
@query("anova_p_value", """
WITH g AS (SELECT kind, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS w FROM
  (SELECT CASE event_type WHEN 'click' THEN 'a' WHEN 'error' THEN 'b' ELSE 'c' END AS kind, value FROM events) GROUP BY 1),
s AS (SELECT sum(n) - 3 AS d, sum(w) AS ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb FROM g)
SELECT 'kind' AS term, 2 AS df, round(ssb / 2 / (ssw / d), 5) AS f, round((1 + 2 * (ssb / 2 / (ssw / d)) / d) ** (-d / 2), 6) AS p FROM s
UNION ALL SELECT 'Residual', CAST(d AS INTEGER), NULL, NULL FROM s""")
def anova_p_value(spark, d):
    kind = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "error", "b").otherwise("c").alias("kind")
    out = anova.anova(table(spark, d, "events").select("value", kind), "value", ["kind"])
    return out.select("term", "df", F.round("F", 5).alias("f"), F.round("PR(>F)", 6).alias("p"))
