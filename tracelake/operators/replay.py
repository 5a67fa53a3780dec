"""Predictions against curated answers: precision, recall and what missed a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.tiers import metrics


def set_counts(predicted: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, tp, fp, fn) over distinct values of each key; keys on one side only are kept."""
    p = predicted.select(*keys, value).where(F.col(value) != "").distinct().withColumn("_p", F.lit(1))
    e = expected.select(*keys, value).where(F.col(value) != "").distinct().withColumn("_e", F.lit(1))
    both = p.join(e, [*keys, value], "full_outer")
    return both.groupBy(*keys).agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_e").isNotNull()).alias("tp"),
        F.count_if(F.col("_e").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"),
    )


def evidence_counts(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(replay_id, tp, fp, fn) of case ids: predicted and expected both (replay_id, scenario, case_id).

    Only scenarios that were predicted and have expected evidence count; what is expected
    of a scenario that was not predicted is missed as a scenario, not as evidence.
    """
    asked = expected.select("replay_id", "scenario").distinct()
    seen = predicted.select("replay_id", "scenario").distinct()
    p = predicted.join(asked, ["replay_id", "scenario"], "left_semi")
    e = expected.join(seen, ["replay_id", "scenario"], "left_semi")
    return set_counts(p, e, ["replay_id"], "case_id")


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.select("*", *metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def overall(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Micro average: counts added up over everything but keys, then rated."""
    return with_metrics(counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def set_differences(predicted: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, kind, value): missing and unexpected values."""
    p, e = predicted.select(*keys, value).distinct(), expected.select(*keys, value).distinct()
    missing = e.join(p, [*keys, value], "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionByName(p.join(e, [*keys, value], "left_anti").withColumn("kind", F.lit("unexpected")))


def threshold_misses(rated: DataFrame, thresholds: dict[str, float], kind: str = "kind") -> DataFrame:
    """(metric, value, threshold) of metrics kind_precision, kind_recall and kind_f1 that are below their threshold."""
    flat = rated.select(F.explode(F.array(*[F.struct(F.concat_ws("_", kind, F.lit(m)).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")])).alias("x")).select("x.*")
    if not thresholds:
        return flat.withColumn("threshold", F.lit(None).cast("double")).limit(0)
    wanted = F.element_at(F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))]), F.col("metric"))
    return flat.withColumn("threshold", wanted).where("value < threshold")
