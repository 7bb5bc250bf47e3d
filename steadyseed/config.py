"""Configuration objects, fixed values and the session settings read by operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Problem kinds, metrics, imputation methods and variable types.
PROBLEM_TYPES = ("classification", "regression")
CLASSIFICATION_METRICS = ("accuracy", "precision", "recall", "f1")
REGRESSION_METRICS = ("mae", "rmse", "r2")
BINARY_METRICS = ("precision", "recall", "f1")
AGREEMENT_METRICS = ("kappa", "mcc")  # of a comparison of models only
HIGHER_IS_BETTER = ("accuracy", "precision", "recall", "f1", "r2", *AGREEMENT_METRICS)
IMPUTE_METHODS = ("mean", "iterative")
VARIABLE_TYPES = ("ordinal", "nominal")
METRIC_DISPLAY = {
    "accuracy": "Accuracy",
    "precision": "Prec.",
    "recall": "Recall",
    "f1": "F1",
    "kappa": "Kappa",
    "mcc": "MCC",
    "mae": "MAE",
    "rmse": "RMSE",
    "r2": "R2",
}
MIN_ITERATIONS, MAX_ITERATIONS, DEFAULT_ITERATIONS = 10, 1000, 100
TEST_SHARE = 0.3
IMBALANCE_THRESHOLD = 0.6

# Largest lookup table that is broadcast or brought to the driver; anything
# larger takes the distributed path of the operator concerned.
MAX_LOOKUP_ROWS = 10_000


def default_metric(problem_type: str) -> str:
    return "accuracy" if problem_type == "classification" else "mae"


def metrics_for(problem_type: str) -> tuple[str, ...]:
    return CLASSIFICATION_METRICS if problem_type == "classification" else REGRESSION_METRICS


def higher_is_better(metric: str) -> bool:
    return metric.lower() in HIGHER_IS_BETTER


@dataclass(frozen=True)
class CategoricalConfig:
    """How one categorical column is to be encoded."""

    variable_name: str
    variable_type: str
    value_ordering: tuple[str, ...] = ()

    def __post_init__(self):
        if self.variable_type not in VARIABLE_TYPES:
            raise ValueError(f"variable_type must be one of {VARIABLE_TYPES}, got {self.variable_type!r}")
        object.__setattr__(self, "value_ordering", tuple(self.value_ordering or ()))


@dataclass
class AnalysisConfig:
    """One analysis request; ``oversample=None`` lets the class balance decide.

    ``average='macro'`` scores precision, recall and f1 over all classes.
    """

    target: str
    problem_type: str
    metric: str | None = None
    iterations: int = DEFAULT_ITERATIONS
    remove_columns: list[str] = field(default_factory=list)
    impute_method: str = "mean"
    categorical_configs: list[CategoricalConfig] = field(default_factory=list)
    oversample: bool | None = None
    oversample_scope: str = "all"
    null_target: str = "error"
    id_col: str | None = None
    average: str = "binary"
    trees: int = 100
    max_depth: int = 5
    parallelism: int = 4
    skip_leaderboard: bool = False
    skip_report: bool = False

    @property
    def resolved_metric(self) -> str:
        return (self.metric or default_metric(self.problem_type)).lower()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A session without that setting gets a folder below its warehouse directory,
    the other folder that the driver and all executors share; no folder of one
    machine is ever used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_steadyseed_checkpoints"
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()
