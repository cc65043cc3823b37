"""Trials of a benchmark: their plan, the best attempt a cell, and grouped reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Page presets and scenarios of the benchmark.
PRESETS = {"": [12, 13, 31, 32, 59, 60], "bleed-smoke": [12, 13, 31, 32, 59, 60], "figure-adjacent": [12, 13, 31, 32, 42, 43, 59, 60, 87, 88, 97, 98, 112, 113, 115, 116]}
SCENARIOS = ("target-only", "target-plus-text-context", "single-block-target-first", "multi-block-labeled", "multi-block-unlabeled", "context-first-negative-control")
DEFAULT_SCENARIO = "target-only"


def scenarios(values: Sequence[str]) -> list[str]:
    """Names of a comma list, in order; an unknown one is an error, none is the default."""
    names = [p.strip() for v in values for p in v.split(",") if p.strip()]
    if unknown := [n for n in names if n not in SCENARIOS]:
        raise ValueError(f"unknown scenario {unknown[0]!r}")
    return names or [DEFAULT_SCENARIO]


def plan(spark: SparkSession, pages: Sequence[int], names: Sequence[str], most: int = 0) -> DataFrame:
    """(trial_id, target_page, scenario) of pages by scenarios, pages first; ids by place. Both lists are short literals."""
    rows = [(p, s) for p in pages for s in names][: most or None]
    return spark.createDataFrame([(f"trial-{i:04d}", p, s) for i, (p, s) in enumerate(rows, 1)], "trial_id string, target_page int, scenario string")


def rank(score: str = "target_only_score", status: str = "status", parse_ok: str = "json_parse_ok", bleed: str = "suspected_bleed", error: str = "error") -> Column:
    """What makes one attempt better than another: success, then a parsed answer, no bleed, no error, and the score."""
    flag = lambda test, weight: F.when(F.coalesce(test, F.lit(False)), float(weight)).otherwise(0.0)
    no = lambda c: F.coalesce(F.col(c), F.lit(False)) == F.lit(False)
    return F.coalesce(F.col(score), F.lit(0.0)) + flag(F.col(status) == "succeeded", 1000) + flag(F.col(parse_ok), 100) + flag(no(bleed), 10) + flag(F.coalesce(error, F.lit("")) == "", 1)


def logical(trials: DataFrame, keys: Sequence[str], order: Sequence[str], score: Column) -> DataFrame:
    """The best trial of each cell; of equal ones the first."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), *[F.col(c).asc() for c in order])
    return trials.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replacements(trials: DataFrame, keys: Sequence[str], order: Sequence[str], score: Column) -> DataFrame:
    """(keys, trials, duplicates, replacements) of each cell: how often an attempt beat all before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = trials.withColumn("__r", score).withColumn("__before", F.max("__r").over(w))
    return r.groupBy(*keys).agg(F.count("*").alias("trials"), (F.count("*") - 1).alias("duplicates"), F.count_if(F.col("__before").isNotNull() & (F.col("__r") > F.col("__before"))).alias("replacements"))


def run_summary(trials: DataFrame) -> DataFrame:
    """Per run, and per run and scenario (scenario null for the run): one pass with grouping sets. A failed parse counts as succeeded here."""
    done = F.col("status").isin("succeeded", "parse_failed")
    return trials.groupingSets([["run_id", "scenario"], ["run_id"]], "run_id", "scenario").agg(
        F.grouping("scenario").cast("int").alias("whole_run"), F.count("*").alias("trials"), F.count_if(done).alias("succeeded"), F.count_if(~F.coalesce(done, F.lit(False))).alias("failed"),
        F.count_if("suspected_bleed").alias("bleed"), F.round(F.avg(F.coalesce("target_only_score", F.lit(0.0))), 6).alias("avg_score"),
    )


def grouped_report(trials: DataFrame, key: str) -> DataFrame:
    """Trials by a key: counts, mean and least score (1 at most). Captions aren't counted a second time among forbidden hits."""
    return trials.groupBy(key).agg(
        F.count("*").alias("trials"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if("json_parse_ok").alias("parse_ok"), F.count_if("suspected_bleed").alias("bleed"), F.count_if("schema_repaired").alias("schema_repaired"),
        F.coalesce(F.sum("forbidden_phrase_hits"), F.lit(0)).alias("forbidden_hits"), F.round(F.avg(F.coalesce("target_only_score", F.lit(0.0))), 6).alias("avg_score"), F.round(F.least(F.lit(1.0), F.min(F.coalesce("target_only_score", F.lit(0.0)))), 6).alias("min_score"),
    )


def notable(trials: DataFrame) -> DataFrame:
    """Trials to look at: below full score, with forbidden hits or bleed, or not succeeded."""
    return trials.where((F.coalesce("target_only_score", F.lit(0.0)) < 1) | (F.coalesce("forbidden_phrase_hits", F.lit(0)) > 0) | F.coalesce("suspected_bleed", F.lit(False)) | (F.coalesce("status", F.lit("")) != "succeeded"))


def with_metrics(trials: DataFrame, metrics: DataFrame) -> DataFrame:
    """Trials, one row each, with their metrics where there are some; both are keyed by run and trial."""
    from folioscope.sources.tables import one_per_key

    t = one_per_key(trials, ["run_id", "id"], [F.col("seq").asc_nulls_last(), F.col("started_at").asc_nulls_last()])
    m = one_per_key(metrics, ["run_id", "trial_id"], [F.col("target_only_score").desc_nulls_last()]).withColumnRenamed("trial_id", "id")
    m = m.select("run_id", "id", *[c for c in m.columns if c not in t.columns])  # of clashing names the trial's column stays
    return t.join(m, ["run_id", "id"], "left")
