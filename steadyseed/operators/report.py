"""The analysis as one record and as report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.config import METRIC_DISPLAY, AnalysisConfig

TOP = 5
# The labelled lines of the report.
PROBLEM = "Problem Type: {}"
TARGET = "Target Variable: {}"
METRIC = "Metric Used: {}"
ITERATIONS = "Iterations: {} random seeds"
BEST = "Best Seed: %d -> %.4f"
WORST = "Worst Seed: %d -> %.4f"
COMMON = "Most Common Score: %.4f"
RANGE = "Score Range: %.4f to %.4f"
DEVIATION = "Standard Deviation: %.4f"
MEAN = "Mean Score: %.4f"
MODELS = "%s Seed - Top 5 Models"


def analysis_record(
    results: DataFrame, summary: DataFrame, cfg: AnalysisConfig, seconds: float,
    leaderboard_available: bool = False, report_available: bool = False,
) -> DataFrame:
    """One row: status, configuration, summary, seed results and elapsed time."""
    config = F.struct(
        F.lit(cfg.target).alias("target_column"),
        F.lit(cfg.problem_type).alias("problem_type"),
        F.lit(cfg.resolved_metric).alias("metric"),
        F.lit(cfg.iterations).alias("iterations"),
        F.array(*[F.lit(c) for c in cfg.remove_columns]).cast("array<string>").alias("remove_columns"),
        F.lit(cfg.impute_method).alias("impute_method"),
        F.lit(cfg.oversample).cast("boolean").alias("oversample"),
    )
    seeds = results.agg(F.sort_array(F.collect_list(F.struct("seed", "score"))).alias("seed_results"))
    return summary.select(
        F.lit("completed").alias("status"),
        config.alias("analysis_config"),
        F.struct(*summary.columns).alias("summary"),
        seeds.scalar().alias("seed_results"),
        F.lit(leaderboard_available).alias("leaderboard_available"),
        F.lit(report_available).alias("report_available"),
        F.lit(float(seconds)).alias("execution_time"),
    )


def _decimals(value: Column) -> Column:
    return F.format_string("%.4f", value)


def stability_report(
    summary: DataFrame, problem_type: str, target: str, metric: str, iterations: int, ranked: DataFrame | None = None
) -> DataFrame:
    """``(section, position, line)``: the findings, then the top models of each seed role."""
    lines = [
        F.lit(PROBLEM.format(problem_type.title())),
        F.lit(TARGET.format(target)),
        F.lit(METRIC.format(metric.upper())),
        F.lit(ITERATIONS.format(iterations)),
        F.format_string(BEST, "best_seed", "best_score"),
        F.format_string(WORST, "worst_seed", "worst_score"),
        F.format_string(COMMON, "most_common_score"),
        F.format_string(RANGE, "score_range_min", "score_range_max"),
        F.format_string(DEVIATION, "standard_deviation"),
        F.format_string(MEAN, "mean_score"),
    ]
    findings = summary.select(F.lit("Findings").alias("section"), F.posexplode(F.array(*lines)).alias("position", "line"))
    if ranked is None:
        return findings
    shown = [d for d in METRIC_DISPLAY.values() if d in ranked.columns]
    values = [F.concat(F.lit(f"{d}="), F.coalesce(_decimals(F.col(f"`{d}`")), F.lit("n/a"))) for d in shown]
    models = ranked.where(F.col("rank") <= TOP).select(
        F.format_string(MODELS, "seed_role").alias("section"),
        (F.col("rank") - 1).cast("int").alias("position"),
        F.concat_ws(" ", "model", *values).alias("line"),
    )
    return findings.unionByName(models)


def report_text(report: DataFrame) -> DataFrame:
    """One text row per section."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda e: e["line"]), "\n")
    return report.groupBy("section").agg(joined.alias("text"))
