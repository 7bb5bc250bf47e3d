"""Summary of a score distribution ``(seed, score)``, of at most 1000 seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyseed.config import higher_is_better
from steadyseed.operators.target import equal_width_histogram

SCORE_BINS = 20


def _highest(value: str) -> Column:
    return F.max_by(value, F.struct(F.col("score"), -F.col("seed")))


def _lowest(value: str) -> Column:
    return F.min_by(value, F.struct("score", "seed"))


def _best(value: str, metric: str) -> Column:
    return _highest(value) if higher_is_better(metric) else _lowest(value)


def _worst(value: str, metric: str) -> Column:
    return _lowest(value) if higher_is_better(metric) else _highest(value)


def best_and_worst(results: DataFrame, metric: str) -> DataFrame:
    """Best and worst seed in the direction of the metric; ties go to the lowest seed."""
    return results.agg(
        _best("seed", metric).alias("best_seed"), _best("score", metric).alias("best_score"),
        _worst("seed", metric).alias("worst_seed"), _worst("score", metric).alias("worst_score"),
        F.lit(higher_is_better(metric)).alias("higher_is_better"),
    )


def modal_score(results: DataFrame) -> DataFrame:
    """The most frequent exact score; ties go to the score met first in seed order."""
    counted = results.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("first_seed"))
    return counted.agg(F.max_by("score", F.struct(F.col("n"), -F.col("first_seed"))).alias("most_common_score"))


def modal_seeds(results: DataFrame) -> DataFrame:
    """The modal score with every seed that has it, in order."""
    modal = modal_score(results).scalar()
    return results.where(F.col("score") == modal).agg(
        F.first("score").alias("most_common_score"), F.sort_array(F.collect_list("seed")).alias("common_seeds")
    )


def spread(results: DataFrame) -> DataFrame:
    return results.agg(
        F.min("score").alias("score_range_min"), F.max("score").alias("score_range_max"),
        F.stddev_pop("score").alias("standard_deviation"), F.avg("score").alias("mean_score"),
    )


def summarize(results: DataFrame, metric: str) -> DataFrame:
    """Best, worst, modal score and seeds, range, spread and mean in one row."""
    modal = modal_seeds(results)
    both = results.agg(
        _best("seed", metric).alias("best_seed"), _best("score", metric).alias("best_score"),
        _worst("seed", metric).alias("worst_seed"), _worst("score", metric).alias("worst_score"),
        F.min("score").alias("score_range_min"), F.max("score").alias("score_range_max"),
        F.stddev_pop("score").alias("standard_deviation"), F.avg("score").alias("mean_score"),
    )
    return both.select(
        "best_seed", "best_score", "worst_seed", "worst_score",
        modal.select("most_common_score").scalar().alias("most_common_score"),
        modal.select("common_seeds").scalar().alias("common_seeds"),
        "score_range_min", "score_range_max", "standard_deviation", "mean_score",
        F.lit(higher_is_better(metric)).alias("higher_is_better"),
    )


def score_range_width(summary: DataFrame) -> DataFrame:
    return summary.select((F.col("score_range_max") - F.col("score_range_min")).alias("score_range_width"))


def rank_seeds(results: DataFrame, metric: str) -> DataFrame:
    """Seeds from best to worst with rank and a best / worst tag."""
    order = F.col("score").desc() if higher_is_better(metric) else F.col("score").asc()
    ends = best_and_worst(results, metric)
    best, worst = ends.select("best_seed").scalar(), ends.select("worst_seed").scalar()
    tag = F.when(F.col("seed") == best, "best").when(F.col("seed") == worst, "worst")
    return results.select(
        "seed", "score", F.row_number().over(Window.orderBy(order, "seed")).alias("rank"), tag.alias("tag")
    )


def score_histogram(results: DataFrame, bins: int = SCORE_BINS) -> DataFrame:
    return equal_width_histogram(results, "score", F.lit(bins))


def modal_bin_center(histogram: DataFrame) -> DataFrame:
    """Centre of the fullest bin, the first of equals."""
    center = (F.col("lo") + F.col("hi")) / 2
    return histogram.agg(F.max_by(center, F.struct(F.col("n"), -F.col("bin"))).alias("modal_bin_center"))


def score_series(results: DataFrame, metric: str) -> DataFrame:
    """The line chart: scores in seed order with the marker values beside them."""
    ends = best_and_worst(results, metric)
    return results.orderBy("seed").select(
        "seed", "score",
        modal_score(results).scalar().alias("common_score"),
        ends.select("best_seed").scalar().alias("best_seed"),
        ends.select("worst_seed").scalar().alias("worst_seed"),
    )
