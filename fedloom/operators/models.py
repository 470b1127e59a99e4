"""Training jobs on MLlib and on sufficient statistics.

Every estimator shares one interface: ``fit`` on a DataFrame, ``predict`` adds
a column, ``parameters`` gives plain numbers, ``evaluate`` a metrics table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import argmax_class, metrics_report, sign_class
from ..functions.vectors import array_literal, dot
from ..session import materialize, spread
from .columns import as_double, q
from .descent import descend, federated_descent, federated_rounds, linear_gd, moment_sums  # noqa: F401
from .scoring import landmark_features, pick_landmarks, score_svm

FEATURES = "_features"
MODELS_AT_ONCE = 4


def _added_prediction(fitted, df: DataFrame, name: str) -> DataFrame:
    """The input with only the prediction added."""
    out = fitted.transform(df)
    added = [c for c in out.columns if c not in df.columns and c != "prediction"]
    return out.drop(*added).withColumnRenamed("prediction", name)


@dataclass
class Model:
    """A fitted pipeline over named input columns."""

    kind: str
    inputs: Sequence[str]
    label: str
    pipeline: PipelineModel
    settings: dict = field(default_factory=dict)

    @property
    def fitted(self):
        return self.pipeline.stages[-1]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if isinstance(self.fitted, C.OneVsRestModel):
            # its own transform runs Python per row; the margins are plain expressions
            found = self.parameters()
            return df.withColumn(name, score_svm(self.inputs, found["weights"], found["biases"]).cast("double"))
        return _added_prediction(self.pipeline, df, name)

    def evaluate(self, df: DataFrame, metrics: Sequence[str], average: str = "binary") -> DataFrame:
        """Metrics of the predictions; area and log loss of a two-class model come from its probabilities."""
        y = q(self.label).cast("double").alias("label")
        if getattr(self.fitted, "numClasses", None) == 2 and hasattr(self.fitted, "getProbabilityCol"):
            out = self.pipeline.transform(df)
            one = vector_to_array(F.col(self.fitted.getProbabilityCol()))[1]
            return metrics_report(out.select(y, F.col("prediction").cast("double").alias("prediction"), one.alias("score")), metrics, average=average, score="score")
        scored = self.predict(df).select(y, F.col("prediction").cast("double").alias("prediction"))
        return metrics_report(scored, metrics, average=average)

    def parameters(self) -> dict:
        """Plain numbers of the model: coefficients, or importances and tree sizes."""
        m = self.fitted
        if isinstance(m, (R.LinearRegressionModel, C.LogisticRegressionModel, C.LinearSVCModel)):
            return {"weights": m.coefficients.toArray().tolist(), "intercept": float(m.intercept)}
        if isinstance(m, C.OneVsRestModel):
            return {"weights": [s.coefficients.toArray().tolist() for s in m.models], "biases": [float(s.intercept) for s in m.models]}
        if isinstance(m, C.MultilayerPerceptronClassificationModel):
            return {"layers": m.getLayers(), "weights": m.weights.toArray().tolist()}
        out = {"importances": m.featureImportances.toArray().tolist()}
        trees = getattr(m, "trees", [m])
        out["trees"] = len(trees)
        out["average_depth"] = sum(t.depth for t in trees) / len(trees)
        out["average_nodes"] = sum(t.numNodes for t in trees) / len(trees)
        # a binary tree with n nodes has (n + 1) / 2 leaves
        out["average_leaves"] = (out["average_nodes"] + 1) / 2
        return out


def _train(kind: str, df: DataFrame, inputs: Sequence[str], label: str, stages: list, settings: dict | None = None) -> Model:
    """Assemble vectors, fit, keep the pipeline.

    Iterative estimators read the slim training table many times, so it is
    written once to the shared folder.  Rows with a NULL or NaN are refused:
    they would be missing from the fit and fail in ``predict``.
    """
    slim = materialize(spread(df.select(*[as_double(df, c).alias(c) for c in inputs], q(label).cast("double").alias(label))))
    gaps = slim.agg(F.count_if(reduce(or_, [q(c).isNull() | F.isnan(q(c)) for c in slim.columns]))).first()[0]
    if gaps:
        raise ValueError(f"{gaps} rows have a NULL or NaN in {[*inputs, label]}; fill or drop them first")
    assembler = VectorAssembler(inputCols=list(inputs), outputCol=FEATURES)
    return Model(kind, list(inputs), label, Pipeline(stages=[assembler, *stages]).fit(slim), settings or {})


def linear_regression(df: DataFrame, inputs: Sequence[str], label: str, **options) -> Model:
    """Least squares on standardised inputs, coefficients in original units."""
    return _train("linear_regression", df, inputs, label, [R.LinearRegression(featuresCol=FEATURES, labelCol=label, **options)])


def logistic_regression(df: DataFrame, inputs: Sequence[str], label: str, **options) -> Model:
    return _train("logistic_regression", df, inputs, label, [C.LogisticRegression(featuresCol=FEATURES, labelCol=label, **options)])


def linear_svm(df: DataFrame, inputs: Sequence[str], label: str, binary: bool = True, **options) -> Model:
    """Linear support vectors; several classes by one against the rest."""
    svc = C.LinearSVC(featuresCol=FEATURES, labelCol=label, **options)
    stage = svc if binary else C.OneVsRest(classifier=svc, featuresCol=FEATURES, labelCol=label, parallelism=MODELS_AT_ONCE)
    return _train("linear_svm", df, inputs, label, [stage])


def decision_tree(df: DataFrame, inputs: Sequence[str], label: str, task: str = "classification", **options) -> Model:
    kind = C.DecisionTreeClassifier if task == "classification" else R.DecisionTreeRegressor
    return _train("decision_tree", df, inputs, label, [kind(featuresCol=FEATURES, labelCol=label, **options)])


def random_forest(df: DataFrame, inputs: Sequence[str], label: str, task: str = "classification", **options) -> Model:
    kind = C.RandomForestClassifier if task == "classification" else R.RandomForestRegressor
    return _train("random_forest", df, inputs, label, [kind(featuresCol=FEATURES, labelCol=label, **options)])


def gradient_boosting(df: DataFrame, inputs: Sequence[str], label: str, **options) -> Model:
    return _train("gradient_boosting", df, inputs, label, [R.GBTRegressor(featuresCol=FEATURES, labelCol=label, **options)])


def mlp_classifier(df: DataFrame, inputs: Sequence[str], label: str, hidden: Sequence[int], classes: int, **options) -> Model:
    """Feed-forward classifier on standardised inputs."""
    scaled = "_scaled"
    scaler = StandardScaler(inputCol=FEATURES, outputCol=scaled, withMean=True)
    network = C.MultilayerPerceptronClassifier(featuresCol=scaled, labelCol=label, layers=[len(inputs), *hidden, classes], **options)
    return _train("mlp_classifier", df, inputs, label, [scaler, network])


@dataclass
class LandmarkModel:
    """Linear support vectors on kernel features against landmark rows."""

    features: str
    label: str
    landmarks: list[list[float]]
    kernel: dict
    fitted: object

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        kernels = landmark_features(q(self.features), self.landmarks, **self.kernel)
        models = self.fitted.models if isinstance(self.fitted, C.OneVsRestModel) else [self.fitted]
        margins = [dot(F.col(FEATURES), array_literal(m.coefficients)) + F.lit(float(m.intercept)) for m in models]
        found = sign_class(margins[0]) if len(margins) == 1 else argmax_class(F.array(*margins))
        return df.withColumn(FEATURES, kernels).withColumn(name, found.cast("double")).drop(FEATURES)


def landmark_svm(df: DataFrame, features: str, label: str, key: str, landmarks: int = 15, binary: bool = True,
                 kernel: dict | None = None, **options) -> LandmarkModel:
    chosen = pick_landmarks(df, features, key, landmarks)
    kernel = kernel or {"kernel": "rbf", "gamma": 1.0}
    near = landmark_features(q(features), chosen, **kernel)
    vectors = F.when(q(features).isNotNull() & ~F.exists(q(features), lambda v: v.isNull()), array_to_vector(near))
    table = materialize(spread(df.select(vectors.alias(FEATURES), q(label).cast("double").alias(label))))
    bad = q(FEATURES).isNull() | F.exists(vector_to_array(FEATURES), lambda v: v.isNull() | F.isnan(v)) | q(label).isNull() | F.isnan(q(label))
    gaps = table.agg(F.count_if(bad)).first()[0]
    if gaps:
        raise ValueError(f"{gaps} rows have a NULL or NaN in {[features, label]}; fill or drop them first")
    svc = C.LinearSVC(featuresCol=FEATURES, labelCol=label, **options)
    stage = svc if binary else C.OneVsRest(classifier=svc, featuresCol=FEATURES, labelCol=label, parallelism=MODELS_AT_ONCE)
    return LandmarkModel(features, label, chosen, kernel, stage.fit(table))
