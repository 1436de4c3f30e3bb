"""Evaluation reports in JSON: a summary with one entry per question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION_SCHEMA = (
    "question string, reference_text string, base_response string, "
    "fine_tuned_response string, base_perplexity double, fine_tuned_perplexity double, "
    "improvement double, improved boolean"
)
SUMMARY_SCHEMA = (
    "avg_base_perplexity double, avg_fine_tuned_perplexity double, improvement_pct double, "
    "questions_improved bigint, total_questions bigint"
)
REPORT_SCHEMA = (
    "evaluation_timestamp string, test_passed boolean, "
    f"summary_statistics struct<{SUMMARY_SCHEMA}>, "
    f"detailed_results array<struct<{QUESTION_SCHEMA}>>"
)


def read_eval_report(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Report files as stored: summary struct and array of questions."""
    return spark.read.schema(REPORT_SCHEMA).json(path, multiLine=multi_line)


def report_questions(reports: DataFrame) -> DataFrame:
    """One row per question of each report."""
    return reports.select(
        "evaluation_timestamp",
        "test_passed",
        F.explode("detailed_results").alias("q"),
    ).select("evaluation_timestamp", "test_passed", "q.*")


def write_eval_report(reports: DataFrame, path: str) -> None:
    """Write reports as JSON, one per line."""
    reports.write.mode("overwrite").json(path)
