"""Pipelines: a scaler and a model that are fitted on training rows and score tables in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrad.functions.metrics import binary_metrics, regression_metrics
from loomgrad.operators.models import LinearRegression, LogisticBinaryClassifier, NotFittedError
from loomgrad.operators.scaling import FittedScaler, Scaler
from loomgrad.operators.training import BatchGradientDescent, EpochCallback
from loomgrad.operators.validate import check_threshold, classify, validate_training_table


class _Pipeline:
    """The caller's table is never changed; a failed refit leaves the pipeline unfitted."""

    model_type: type[LinearRegression]

    def __init__(self, scaler: Scaler | None = None, optimiser=None) -> None:
        self.scaler = scaler or Scaler("z_score")
        self.model = self.model_type(optimiser or BatchGradientDescent())
        self.fitted_scaler: FittedScaler | None = None

    def fit(self, train: DataFrame, on_epoch: EpochCallback | None = None):
        """One aggregate that validates the table and fits the scaler, then training on scaled rows."""
        self.fitted_scaler = None
        if hasattr(self.scaler, "fit_checked"):
            facts, scaler = self.scaler.fit_checked(train, self.model.binary, type(self).__name__)
        else:  # a scaler of the caller's own
            facts = validate_training_table(train, self.model.binary, type(self).__name__)
            scaler = self.scaler.fit(train, facts.features)
        scaled = scaler.transform(train.select("id", "features", "target"), check=False)
        self.model.fit(scaled, on_epoch, facts.features)
        self.fitted_scaler = scaler
        return self

    @property
    def trained(self):
        if self.fitted_scaler is None:
            raise NotFittedError("fit the pipeline first")
        return self.model.trained

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the model's output; features stay as they came. A projection: streams work too."""
        if self.fitted_scaler is None:
            raise NotFittedError("fit the pipeline first")
        # Features are checked once, before scaling.
        return self.model.predict(self.fitted_scaler.transform(df.withColumn("_lg_raw", F.col("features"))), check=False).withColumn(
            "features", F.col("_lg_raw")
        ).drop("_lg_raw")


class RegressionPipeline(_Pipeline):
    model_type = LinearRegression

    def evaluate(self, test: DataFrame, tolerance: float = 0.1) -> DataFrame:
        return regression_metrics(self.predict(test), tolerance=tolerance)


class BinaryClassificationPipeline(_Pipeline):
    model_type = LogisticBinaryClassifier

    def predict_class(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict(df).withColumn("predicted", classify(F.col("probability"), threshold))

    def evaluate(self, test: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Predicted classes use ``threshold``; expected classes are targets of at least 0.5."""
        return binary_metrics(self.predict(test), threshold=check_threshold(threshold))


def score_binary_model(model, test: DataFrame) -> DataFrame:
    """Metrics of any fitted model with a ``probability``, both classes at 0.5."""
    return binary_metrics(model.predict(test))
