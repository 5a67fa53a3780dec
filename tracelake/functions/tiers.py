"""Trust tiers and the numbers reports are made of, as columns."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tier of a case by its validation status.
STATUS_TIER = {"validated": "trusted", "partial": "candidate", "unverified": "candidate", "conflict": "conflict", "rejected": "rejected"}
# Tiers from the one that prevails to the one that yields.
TIER_ORDER = ("conflict", "trusted", "candidate", "rejected")
#: Loss of score per hop in the code graph.
DECAY = 0.7


def tier_of_status(status: Column) -> Column:
    """Tier of a case; an unknown or absent status is a candidate."""
    pairs = F.create_map(*[F.lit(x) for pair in STATUS_TIER.items() for x in pair])
    return F.coalesce(F.element_at(pairs, F.coalesce(status, F.lit(""))), F.lit("candidate"))


def item_tier(case_tier: Column, evidence_kind: Column) -> Column:
    """An item of a trusted case that is only inferred is a candidate."""
    return F.when((case_tier == "trusted") & (evidence_kind == "inferred"), "candidate").otherwise(case_tier)


def effective_tier(tier: Column, propagated: Column) -> Column:
    """Every item of a case reached by propagation is a candidate."""
    return F.when(propagated, "candidate").otherwise(tier)


def tier_rank(tier: Column) -> Column:
    """0 for the tier that prevails; unknown tiers yield to all."""
    at = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), tier)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.lit(len(TIER_ORDER) - 1))


def prevailing_tier(tier: Column) -> Column:
    """Aggregate: the tier that prevails in a group."""
    return F.element_at(F.array(*[F.lit(t) for t in TIER_ORDER]), F.min(tier_rank(tier)).cast("int") + 1)


def requires_confirmation(tier: Column) -> Column:
    return tier != "trusted"


def capped_third(x: Column) -> Column:
    return F.least(x / 3, F.lit(1.0))


def decayed(depth: Column) -> Column:
    return F.round(F.pow(F.lit(DECAY), depth), 4)


@F.pandas_udf(T.DoubleType())
def exact_round4(values: pd.Series) -> pd.Series:
    """Four decimals by the exact binary value, ties to even; for thresholds that hang on the last digit."""
    step = Decimal("0.0001")
    return values.map(lambda v: float(Decimal(v).quantize(step, ROUND_HALF_EVEN)), na_action="ignore")


def metrics(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 of counts.

    Nothing predicted is precise only if nothing was expected; nothing expected is fully recalled.
    """
    precision = F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1")]
