"""Row-partitioned trainers of Spark ML and MLlib, for comparison with the column-partitioned ones."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the baseline configurations.
MLR_ITERATIONS = 10
MLP_HIDDEN = 100
MLP_SEED = 1234


def baseline(
    data: DataFrame,
    model: str,
    *,
    num_features: int,
    iterations: int,
    reg: float = 0.0,
    step: float = 1.0,
    fraction: float = 1.0,
    batch_size: int = 128,
    classes: int = 2,
):
    """Fit ``svm``, ``lr``, ``mlr``, ``svm_sgd``, ``lr_sgd`` or ``mlp`` on ``(label, features VECTOR)``.

    No model has an intercept or standardises its input, except the perceptron, whose layers are fixed
    by the library.
    """
    common = {"regParam": reg, "fitIntercept": False, "standardization": False}
    if model == "svm":
        return LinearSVC(maxIter=iterations, tol=0.0, **common).fit(data)
    if model == "lr":
        return LogisticRegression(maxIter=iterations, elasticNetParam=0.0, **common).fit(data)
    if model == "mlr":
        trainer = LogisticRegression(
            maxIter=MLR_ITERATIONS, elasticNetParam=0.0, family="multinomial", **common
        )
        return trainer.fit(data)
    if model == "mlp":
        trainer = MultilayerPerceptronClassifier(
            layers=[num_features, MLP_HIDDEN, classes], blockSize=batch_size, seed=MLP_SEED,
            maxIter=iterations, solver="gd", stepSize=step,
        )
        return trainer.fit(data)
    if model in ("svm_sgd", "lr_sgd"):
        return _row_sgd(data, model, iterations, step, reg, fraction)
    raise ValueError(f"unknown baseline {model!r}")


def _row_sgd(data: DataFrame, model: str, iterations: int, step: float, reg: float, fraction: float):
    from pyspark.mllib.classification import LogisticRegressionWithSGD, SVMWithSGD
    from pyspark.mllib.linalg import Vectors as OldVectors
    from pyspark.mllib.regression import LabeledPoint

    rows = data.rdd.map(lambda row: LabeledPoint(row[0], OldVectors.fromML(row[1])))
    if model == "svm_sgd":
        return SVMWithSGD.train(
            rows, iterations=iterations, step=step, regParam=reg, miniBatchFraction=fraction
        )
    # No regularisation for this one: its weight is left at zero.
    return LogisticRegressionWithSGD.train(
        rows, iterations=iterations, step=step, miniBatchFraction=fraction, regParam=0.0
    )


def coefficients(model) -> list[tuple[int, int, float]]:
    """``(feature, k, w)`` of a fitted linear baseline."""
    if hasattr(model, "weights"):
        return [(f, 0, float(w)) for f, w in enumerate(model.weights.toArray())]
    matrix = getattr(model, "coefficientMatrix", None)
    if matrix is None:
        return [(f, 0, float(w)) for f, w in enumerate(model.coefficients.toArray())]
    return [(f, k, float(w)) for k, row in enumerate(matrix.toArray()) for f, w in enumerate(row)]


def predictions(model, data: DataFrame) -> DataFrame:
    """Predicted and true label counts of a fitted Spark ML baseline."""
    scored = model.transform(data)
    pair = [F.col("label").cast("double"), F.col("prediction")]
    return scored.groupBy(*pair).agg(F.count("*").alias("n_rows"))
