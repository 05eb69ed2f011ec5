"""The pixel classifier: boosted trees with soft targets as two weighted rows, on Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def soft_rows(rows: DataFrame, *, target: str = "target", weight: str = "weight") -> DataFrame:
    """A target y of weight w as label 1 with weight w y and label 0 with weight w (1 - y): their log-losses add up to the weighted cross-entropy."""
    y = F.least(F.greatest(F.col(target), F.lit(0.0)), F.lit(1.0))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col(weight) * y).alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col(weight) * (1 - y)).alias("w"))))
    return rows.withColumn("s", both).select("*", "s.label", "s.w").drop("s").filter("w > 0")


#: Bins of the scores that average precision is counted over.
BINS = 4096


def fit(
    rows: DataFrame, names: list[str], *, trees: int = 20, rate: float = 0.05, depth: int = 6, least: int = 200, share: float = 0.9, columns: float = 0.9, seed: int = 0,
    validation: DataFrame | None = None, patience: int = 50, positive_weight: float | None = None,
) -> PipelineModel:
    """Boosted trees on rows (features, target, weight).

    validation: rows of the same columns. With them the trees up to the least loss are kept, where the loss didn't fall below it in `patience` more trees; a plateau
    shorter than that doesn't end it. Trees are fitted in runs of growing length, as a fit can't be taken up again: each has twice the trees of the one before, which are
    the same as far as they go.
    positive_weight multiplies the weight of positives (for hard targets)."""
    x = rows.select(*names, "target", "weight")
    if positive_weight is not None:
        x = x.withColumn("weight", F.when(F.col("target") > 0, F.col("weight") * positive_weight).otherwise(F.col("weight")))
    many = trees if validation is None else min(trees, max(1, 2 * patience))
    while True:
        gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="w", maxIter=many, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, subsamplingRate=share, featureSubsetStrategy=str(columns), seed=seed)
        fitted = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), gbt]).fit(soft_rows(x))
        if validation is None:
            return fitted
        losses = losses_of(fitted, validation)
        best = best_iteration(losses, patience)
        if many >= trees or best + patience <= len(losses):
            return truncated(fitted, best)
        many = min(trees, 2 * many)


def best_iteration(losses: list[float], patience: int) -> int:
    """How many trees to keep: those up to the first least loss that isn't beaten within `patience` further trees."""
    best = 0
    for i, v in enumerate(losses):
        if v < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def losses_of(model: PipelineModel, rows: DataFrame) -> list[float]:
    """The mean loss on rows after each tree, from one pass."""
    return [float(v) for v in model.stages[-1].evaluateEachIteration(model.stages[0].transform(soft_rows(rows)))]


def truncated(model: PipelineModel, trees: int) -> PipelineModel:
    """The same model with its first trees only."""
    whole = model.stages[-1]
    if trees >= whole.getNumTrees:
        return model
    sc = SparkSession.getActiveSession().sparkContext
    kept, java = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, trees), whole._java_obj.trees()
    weights = sc._gateway.new_array(sc._jvm.double, trees)
    for i in range(trees):
        kept[i], weights[i] = java[i], float(whole.treeWeights[i])
    cut = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(whole.uid, kept, weights, whole.numFeatures, 2)
    return PipelineModel([model.stages[0], GBTClassificationModel(cut.copy(whole._java_obj.extractParamMap()))])


def trees_of(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def history(model: PipelineModel, **sets: DataFrame) -> DataFrame:
    """iteration, and for each named set its mean loss after that many trees. One pass over each set for all iterations; a row for each tree."""
    losses = {k: losses_of(model, x) for k, x in sets.items()}
    spark = next(iter(sets.values())).sparkSession
    rows = [(i + 1, *map(float, v)) for i, v in enumerate(zip(*losses.values()))]
    return spark.createDataFrame(rows, "iteration int, " + ", ".join(f"{k} double" for k in losses))


def average_precision(scored: DataFrame, *, target: str = "target") -> float:
    x = scored.select(F.col("prob").alias("rawPrediction"), (F.col(target) > 0).cast("double").alias("label"))
    return BinaryClassificationEvaluator(metricName="areaUnderPR").evaluate(x)


def _leaves(node) -> list[float]:
    """A tree's leaf values from left to right, which is how Spark numbers them."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if at.subtreeDepth() == 0:
            out.append(float(at.prediction()))
        else:
            todo += [at.rightChild(), at.leftChild()]
    return out


def precision_history(model: PipelineModel, rows: DataFrame, *, target: str = "target") -> DataFrame:
    """iteration, average_precision on rows after each tree, from one scan: each row's score after every tree is the running sum over the leaves it falls into, and tasks count
    positives and rows by iteration and bin of the score (BINS), so at most trees x BINS rows are exchanged. Scores of one bin are ties."""
    gbt = model.stages[-1]
    values = [np.array(_leaves(t._call_java("rootNode"))) * w for t, w in zip(gbt.trees, gbt.treeWeights)]

    def scores(leaf: pd.Series) -> pd.Series:
        at = np.stack(leaf.to_numpy()).astype(np.int64)
        margin = np.cumsum(np.stack([v[at[:, k]] for k, v in enumerate(values)], 1), axis=1)
        return pd.Series(list(np.minimum((BINS / (1 + np.exp(-2 * margin))).astype(np.int32), BINS - 1)))

    gbt = gbt.copy()
    gbt.setLeafCol("leaf")
    fallen = gbt.transform(model.stages[0].transform(rows)).select(vector_to_array("leaf").alias("leaf"), (F.col(target) > 0).cast("long").alias("hit"))
    each = fallen.select("hit", F.posexplode(F.pandas_udf(scores, "array<int>")("leaf")).alias("i", "bin"))
    counts = each.groupBy("i", "bin").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    down = W.partitionBy("i").orderBy(F.desc("bin"))
    x = counts.withColumns({"h": F.sum("hits").over(down), "m": F.sum("n").over(down), "every": F.sum("hits").over(W.partitionBy("i"))})
    return x.groupBy((F.col("i") + 1).alias("iteration")).agg(F.sum(F.when(F.col("every") > 0, F.col("hits") / F.col("every") * F.col("h") / F.col("m")).otherwise(0.0)).alias("average_precision")).orderBy("iteration")


def predict(model: PipelineModel, rows: DataFrame, *, forest: str | None = None) -> DataFrame:
    """Adds prob; outside the forest it is 0."""
    p = vector_to_array("probability")[1]
    x = model.transform(rows)
    return x.withColumn("prob", F.when(F.col(forest), p).otherwise(0.0) if forest else p).drop("features", "rawPrediction", "probability", "prediction")


def quality(scored: DataFrame, *, target: str = "target", weight: str = "weight") -> DataFrame:
    """Weighted log-loss against soft targets, and counts."""
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -(F.col(target) * F.log(p) + (1 - F.col(target)) * F.log(1 - p))
    return scored.agg(F.count("*").alias("n"), (F.sum(loss * F.col(weight)) / F.sum(weight)).alias("log_loss"), F.avg(F.col("prob")).alias("mean_prob"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
