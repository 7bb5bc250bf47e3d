"""steadyseed: how much of a model's score is luck of the split, on Spark.

The library loads tables, profiles them, suggests and validates a
configuration, describes the target, encodes / imputes / oversamples the
features, repeats split-fit-score over many seeds and summarises the resulting
score distribution.  Operators take and return DataFrames.
"""

from steadyseed.config import AnalysisConfig, CategoricalConfig

__all__ = ["AnalysisConfig", "CategoricalConfig"]
