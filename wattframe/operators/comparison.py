"""Model comparison over per-question scores, lower being better."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE, TUNED = "base_perplexity", "fine_tuned_perplexity"


def question_improvement(questions: DataFrame) -> DataFrame:
    """Per question the score gained and whether the tuned model is better."""
    return questions.withColumns(
        {
            "improvement": F.col(BASE) - F.col(TUNED),
            "improved": F.col(TUNED) < F.col(BASE),
        }
    )


def model_comparison(questions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Averages, improvement in percent, questions improved, and the pass flag."""
    base, tuned = F.avg(BASE), F.avg(TUNED)
    return questions.groupBy(*keys).agg(
        base.alias("avg_base_perplexity"),
        tuned.alias("avg_fine_tuned_perplexity"),
        F.try_divide((base - tuned) * 100, base).alias("improvement_pct"),
        F.count_if(F.col(TUNED) < F.col(BASE)).alias("questions_improved"),
        F.count("*").alias("total_questions"),
        (tuned < base).alias("test_passed"),
    )


def report_documents(questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One nested report per key, in the stored report's shape.

    A report is one JSON object, so the key must be one evaluation run with the
    questions of a test set, not an open-ended log.
    """
    scored = question_improvement(questions)
    entry = F.struct(
        "question",
        *(
            (F.col(c) if c in questions.columns else F.lit(None).cast("string")).alias(c)
            for c in ("reference_text", "base_response", "fine_tuned_response")
        ),
        BASE,
        TUNED,
        "improvement",
        "improved",
    )
    entries = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("detailed_results"))
    totals = model_comparison(questions, keys)
    summary = F.struct(
        "avg_base_perplexity",
        "avg_fine_tuned_perplexity",
        "improvement_pct",
        "questions_improved",
        "total_questions",
    )
    return totals.join(entries, list(keys)).select(
        F.concat_ws("|", *keys).alias("evaluation_timestamp"),
        "test_passed",
        summary.alias("summary_statistics"),
        "detailed_results",
    )
