"""Evaluation of answered cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def details(cases: DataFrame) -> DataFrame:
    """Completed cases with routing_match and abstained_correctly; latency with 2 digits."""
    done = cases.where("not errored")
    return done.select("id", "expected_workflow", "actual_workflow", (F.col("actual_workflow") == F.col("expected_workflow")).alias("routing_match"), "should_abstain", "abstained", (F.col("abstained") == F.col("should_abstain")).alias("abstained_correctly"), "verification_status", F.round("latency", 2).alias("latency"))


def summary(cases: DataFrame) -> DataFrame:
    """One row: completed cases, routing accuracy among them; abstention accuracy among all cases that should abstain (100
    if there are none) and grounding among all others, cases with errors counting as wrong; mean latency by workflow."""
    ok = ~F.col("errored")
    share = lambda yes, of, none: F.coalesce(100.0 * F.count_if(yes) / F.nullif(F.count_if(of), F.lit(0)), F.lit(none))
    abstain = F.col("should_abstain")
    grounded = ok & ~abstain & ~F.col("abstained") & F.col("verification_status").isin("supported", "partially_supported")
    mean = lambda w: F.round(F.coalesce(F.avg(F.when(ok & (F.col("actual_workflow") == w), F.col("latency"))), F.lit(0.0)), 2)
    return cases.agg(
        F.count_if(ok).alias("completed"),
        F.round(share(ok & (F.col("actual_workflow") == F.col("expected_workflow")), ok, 0.0), 1).alias("routing_accuracy"),
        F.round(share(ok & abstain & F.col("abstained"), abstain, 100.0), 1).alias("abstention_accuracy"),
        F.round(share(grounded, ~abstain, 0.0), 1).alias("grounding"),
        mean("simple_rag").alias("latency_simple"),
        mean("agentic").alias("latency_agentic"),
    )
