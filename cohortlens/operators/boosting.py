"""Gradient-boosted trees for regression and classification."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.names import complete_rows, is_nominal
from cohortlens.operators import gram as G
from cohortlens.session import checkpoint_dir


@dataclass
class BoostedModel:
    terms: list
    classes: list
    fitted: object

    def vectors(self, df: DataFrame) -> DataFrame:
        names = [f"_t{i}" for i in range(len(self.terms))]
        wide = df.select("*", *[t.column.alias(n) for n, t in zip(names, self.terms)])
        out = VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="keep").transform(wide)
        return out.drop(*names)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """All rows come back; one with a null or NaN input has a null prediction."""
        known = reduce(lambda a, b: a & b, [t.column.isNotNull() & ~F.isnan(t.column) for t in self.terms])
        scored = self.fitted.transform(self.vectors(df.withColumn("_known", known)))
        value = F.when(F.col("_known"), F.col("_prediction"))
        if self.classes:
            value = F.get(F.array(*[F.lit(c) for c in self.classes]), value.cast("int"))
        kept = [F.col(f"`{c}`") for c in df.columns]
        return scored.select(*kept, value.alias(output))


    def rows(self, spark) -> DataFrame:
        """(class, tree, weight, nodes, depth, rules) of every tree; the class is null for a regression."""
        def trees(model, name):
            return [(name, i, float(w), t.numNodes, t.depth, t.toDebugString)
                    for i, (t, w) in enumerate(zip(model.trees, model.treeWeights))]

        if hasattr(self.fitted, "models"):
            out = [r for name, m in zip(self.classes, self.fitted.models) for r in trees(m, name)]
        else:
            out = trees(self.fitted, self.classes[1] if self.classes else None)
        return spark.createDataFrame(out, "class string, tree int, weight double, nodes int, depth int, rules string")


def gradient_boosting(
    df: DataFrame, y: str, xs: list, learning_rate: float = 0.1, n_estimators: int = 100,
    max_depth: int = 3, min_samples_leaf: int = 1, min_weight_fraction_leaf: float = 0.0,
    min_impurity_decrease: float = 0.0, min_samples_split: int = 2, seed: int = 17,
) -> BoostedModel:
    """Boosted trees; more than two classes are fitted one against the rest.

    Spark's trees bound the rows of a leaf, not of a split, so
    ``min_samples_split`` raises the leaf bound to half of it.
    """
    checkpoint_dir(df.sparkSession)
    rows = complete_rows(df, [y, *xs])
    d = G.design(rows, xs)
    terms = [t for x in xs for t in d[x]]
    classes = G.nominal_levels(rows, [y])[y] if is_nominal(df, y) else []
    model = BoostedModel(terms, classes, None)
    label = F.col(f"`{y}`").cast("double")
    if classes:
        label = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(f"`{y}`").cast("string")) - 1).cast("double")
    table = model.vectors(rows.withColumn("_label", label)).select("_label", "_features")
    common = dict(
        featuresCol="_features", labelCol="_label", predictionCol="_prediction", stepSize=learning_rate,
        maxIter=max(n_estimators, 1), maxDepth=max_depth,
        minInstancesPerNode=max(min_samples_leaf, min_samples_split // 2, 1),
        minWeightFractionPerNode=min_weight_fraction_leaf, minInfoGain=min_impurity_decrease,
        seed=seed, checkpointInterval=10, cacheNodeIds=False,
    )
    if not classes:
        estimator = GBTRegressor(**common)
    elif len(classes) == 2:
        estimator = GBTClassifier(**common)
    else:
        estimator = OneVsRest(
            classifier=GBTClassifier(**common), featuresCol="_features", labelCol="_label",
            predictionCol="_prediction",
        )
    model.fitted = estimator.fit(table)
    return model
