"""Whole analyses, composed of operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
import time

from pyspark.sql import DataFrame, functions as F, types as T

from steadyseed.config import AnalysisConfig, ensure_checkpoint_dir
from steadyseed.functions.hashing import with_row_id
from steadyseed.functions.columns import col
from steadyseed.operators.encode import coerce_numeric_target, distinct_name, encode_features, index_target
from steadyseed.operators.impute import impute_iterative, impute_mean
from steadyseed.operators.leaderboard import (
    compare_models_for_seeds,
    leaderboard_input,
    pick_leaderboard_seeds,
    rank_leaderboard,
)
from steadyseed.operators.profile import column_profile, preview
from steadyseed.operators.report import analysis_record, stability_report
from steadyseed.operators.resample import adasyn
from steadyseed.operators.suggest import (
    default_categorical_configs,
    default_target,
    suggest_categorical_types,
    suggest_removals,
    suggest_targets,
)
from steadyseed.operators.summary import (
    modal_bin_center,
    rank_seeds,
    score_histogram,
    score_series,
    summarize,
)
from steadyseed.operators.sweep import seed_sweep
from steadyseed.operators.target import oversampling_recommendation
from steadyseed.operators.validate import findings, validate_categorical_configs, validate_configuration


@dataclass
class ProcessedData:
    """Rows ``(row_id, features, label, is_synthetic)`` ready for fitting."""

    table: DataFrame
    features: list[str]
    findings: list[tuple] = field(default_factory=list)
    oversampled: bool = False


def describe_table(df: DataFrame, order_by: str | None = None) -> dict[str, DataFrame]:
    """What a user sees first: profile, preview and suggestions."""
    profile = column_profile(df, order_by)
    suggestions = suggest_categorical_types(df, order_by)
    return {
        "profile": profile,
        "preview": preview(df, order_by),
        "suggested_targets": suggest_targets(profile),
        "suggested_removals": suggest_removals(profile),
        "default_target": default_target(profile),
        "categorical_suggestions": suggestions,
        "default_configs": default_categorical_configs(suggestions),
    }


def _identified(df: DataFrame, cfg: AnalysisConfig) -> tuple[DataFrame, str]:
    """The table with a key; a derived one is written out once, as every later step needs the same."""
    if cfg.id_col:
        return df, cfg.id_col
    ensure_checkpoint_dir(df.sparkSession)
    return with_row_id(df).checkpoint(), "row_id"


def process_data(df: DataFrame, cfg: AnalysisConfig) -> ProcessedData:
    """Target, features, imputation and, for classification, oversampling.

    With ``oversample=None`` the class balance decides. With
    ``oversample_scope='train_only'`` the sweep oversamples each training part
    instead of the whole table.
    """
    unknown = [c for c in cfg.remove_columns if c not in df.columns]
    notes = [("warning", "removals", c, f"Column '{c}' to remove not found in dataset") for c in unknown]
    keyed, row_id = _identified(df, cfg)
    wanted = _wants_oversampling(df, cfg)
    if cfg.problem_type == "classification":
        labelled = index_target(keyed, cfg.target, cfg.null_target, row_id)
    else:
        labelled = coerce_numeric_target(keyed, cfg.target, cfg.null_target)
    kept = labelled.drop(*[c for c in cfg.remove_columns if c in df.columns and c not in (row_id, "label")])
    valid, _ = validate_categorical_configs(df, cfg.categorical_configs)
    encoded = encode_features(kept, [row_id, "label"], valid, row_id)
    notes += encoded.findings
    if cfg.impute_method == "iterative":
        filled, more = impute_iterative(encoded.table, encoded.numeric, row_id)
    else:
        filled, more = impute_mean(encoded.table, encoded.numeric)
    notes += more
    features = [c for c in filled.columns if c not in (row_id, "label")]
    plain = filled.withColumnRenamed(row_id, "row_id").withColumn("is_synthetic", F.lit(False))
    if not wanted or cfg.oversample_scope == "train_only":
        return ProcessedData(plain, features, notes, False)
    filled = _arrays_as_columns(filled, features)
    features = [c for c in filled.columns if c not in (row_id, "label")]
    balanced, reason = adasyn(filled, row_id, features, "label")
    if reason:
        notes.append(("warning", "oversampling", None, f"Oversampling left the rows unchanged: {reason}"))
    return ProcessedData(balanced.withColumnRenamed(row_id, "row_id"), features, notes, reason is None)


def _arrays_as_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """Number columns ``name_0``, ``name_1``, .. in place of array features; shorter arrays are filled with 0."""
    arrays = [f for f in features if isinstance(df.schema[f].dataType, T.ArrayType)]
    if not arrays:
        return df
    widths = df.agg(*[F.max(F.size(col(a))).alias(str(i)) for i, a in enumerate(arrays)]).first()
    taken = {c.lower() for c in df.columns}
    cells = [
        F.coalesce(F.get(col(a), k).cast("double"), F.lit(0.0)).alias(distinct_name(f"{a}_{k}", taken))
        for i, a in enumerate(arrays) for k in range(widths[i] or 0)
    ]
    return df.select(*[col(c) for c in df.columns if c not in arrays], *cells)


def _wants_oversampling(df: DataFrame, cfg: AnalysisConfig) -> bool:
    if cfg.problem_type != "classification":
        return False
    if cfg.oversample is not None:
        return cfg.oversample
    return oversampling_recommendation(df, cfg.target, cfg.problem_type).first()["recommended"]


def run_analysis(df: DataFrame, cfg: AnalysisConfig, leaderboard_models: list[str] | None = None, folds: int = 10) -> dict[str, DataFrame]:
    """Validate, process, sweep, summarise, compare and report; tables by name.

    An invalid configuration ends with its findings.
    """
    started = time.monotonic()
    valid, found = validate_configuration(df, cfg)
    if not valid:
        return {"findings": found}
    metric = cfg.resolved_metric
    df, row_id = _identified(df, cfg)
    cfg = replace(cfg, id_col=row_id)
    data = process_data(df, cfg)
    seeds = list(range(1, cfg.iterations + 1))
    train_only = cfg.oversample_scope == "train_only" and _wants_oversampling(df, cfg)
    results = seed_sweep(
        data.table, "row_id", data.features, "label", cfg.problem_type, seeds, metric,
        trees=cfg.trees, max_depth=cfg.max_depth, parallelism=cfg.parallelism, average=cfg.average,
        oversample_train=train_only,
    )
    summary = summarize(results, metric)
    histogram = score_histogram(results)
    tables = {
        "findings": found.unionByName(findings(df.sparkSession, data.findings)),
        "processed": data.table,
        "seed_results": results,
        "summary": summary,
        "ranking": rank_seeds(results, metric),
        "series": score_series(results, metric),
        "histogram": histogram,
        "modal_bin": modal_bin_center(histogram),
    }
    ranked = None
    if not cfg.skip_leaderboard:
        labelled = (
            index_target(df, cfg.target, "drop", row_id) if cfg.problem_type == "classification"
            else coerce_numeric_target(df, cfg.target, "drop")
        )
        raw, features = leaderboard_input(labelled, cfg.remove_columns, "label", row_id)
        board = compare_models_for_seeds(
            raw, row_id, features, "label", cfg.problem_type, pick_leaderboard_seeds(summary),
            models=leaderboard_models, folds=folds, trees=cfg.trees, parallelism=2 * cfg.parallelism,
            average=cfg.average if cfg.problem_type == "classification" else None,
        )
        ranked = rank_leaderboard(board, metric)
        tables["leaderboard"] = ranked
    if not cfg.skip_report:
        tables["report"] = stability_report(summary, cfg.problem_type, cfg.target, metric, cfg.iterations, ranked)
    tables["analysis_record"] = analysis_record(
        results, summary, cfg, time.monotonic() - started, ranked is not None, not cfg.skip_report
    )
    return tables
