"""What a change affects: merged scenarios and services with provenance, and services that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import match_key
from tracelake.functions.tiers import capped_third, effective_tier, prevailing_tier, requires_confirmation
from tracelake.operators.matching import first_by

# Parts of the co-change score.
PARTS = {"context": 0.35, "business_similarity": 0.15, "change_similarity": 0.15, "frequency": 0.2, "trusted_ratio": 0.15}
#: What makes a pair of services expand the result: cases, score, best similarity.
EXPAND = (2, 0.6, 0.5)


def matched_cases(direct: DataFrame, propagated: DataFrame) -> DataFrame:
    """(spec_id, case_id, propagated, score): direct matches and cases reached by relations."""
    a = direct.select("spec_id", "case_id", F.lit(False).alias("propagated"), "score")
    b = propagated.select("spec_id", "case_id", F.lit(True).alias("propagated"), F.lit(None).cast("double").alias("score"))
    return a.unionByName(b)


def merged_items(rows: DataFrame, key: str, display: str, order: list[str]) -> DataFrame:
    """(spec_id, key, display, n_cases, n_evidence, direct, knowledge_tier, requires_confirmation): one row per item.

    The item is shown as its first row by order shows it; its tier is the one that prevails.
    """
    merged = rows.groupBy("spec_id", key).agg(
        F.min(F.struct(*order, F.col(display).alias("_d"))).getField("_d").alias(display),
        F.count_distinct("case_id").alias("n_cases"),
        F.count(F.lit(1)).alias("n_evidence"),
        F.bool_or(~F.col("propagated")).alias("direct"),
        prevailing_tier(F.col("tier")).alias("knowledge_tier"),
    )
    return merged.withColumn("requires_confirmation", requires_confirmation(F.col("knowledge_tier")))


def merged_values(rows: DataFrame, key: str, order: list[str], fields: dict[str, Column]) -> DataFrame:
    """(spec_id, key, field, value, first): the distinct values of each merged item, with the order of their first row.

    fields: name -> array<string> column. One row per value: an item found in a third of
    all cases has as many rows as it has values, and none of them has to hold the others.
    """
    lists = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("values")) for n, v in fields.items()]))
    flat = rows.select("spec_id", key, *order, lists.alias("f")).select("spec_id", key, *order, "f.field", F.posexplode("f.values").alias("pos", "value"))
    return flat.where("value <> ''").groupBy("spec_id", key, "field", "value").agg(F.min(F.struct(*order, "pos")).alias("first"))


def in_order(values: DataFrame, key: str) -> DataFrame:
    """(spec_id, key, field, values): the values of merged_values as lists in order, for a report that people read."""
    listed = values.groupBy("spec_id", key, "field").agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("x"))
    return listed.select("spec_id", key, "field", F.transform("x", lambda v: v["value"]).alias("values"))


SCENARIO_ORDER = ["name", "case_id", "scenario_id"]
SERVICE_ORDER = ["normalized_service", "case_id", "service_change_id"]


def scenario_rows(scenarios: DataFrame, matched: DataFrame, key=match_key, canonical=lambda k: k) -> DataFrame:
    """Scenarios of matched cases with spec_id, scenario_key and tier.

    scenarios: scenario_id, case_id, name, precondition, trigger_text, expected_behavior,
    knowledge_tier, evidence_json. Items of propagated cases are candidates. Rows without
    name or case are left out; repeated rows count once.
    """
    rows = scenarios.where("name IS NOT NULL AND case_id IS NOT NULL").join(matched.select("spec_id", "case_id", "propagated"), "case_id")
    return rows.withColumn("scenario_key", canonical(key("name"))).withColumn("tier", effective_tier(F.col("knowledge_tier"), F.col("propagated"))).distinct()


def merge_scenarios(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, values) of scenario_rows, merged by name; see merged_items and merged_values."""
    fields = {"preconditions": F.array("precondition"), "triggers": F.array("trigger_text"), "expected_behaviors": F.array("expected_behavior"), "case_ids": F.array("case_id")}
    items = merged_items(rows, "scenario_key", "name", SCENARIO_ORDER).withColumnRenamed("name", "scenario")
    return items, merged_values(rows, "scenario_key", SCENARIO_ORDER, fields)


def service_rows(changes: DataFrame, matched: DataFrame, key=match_key, canonical=lambda k: k) -> DataFrame:
    """Service changes of matched cases with spec_id, service_key and tier.

    changes: service_change_id, case_id, service, normalized_service, responsibility,
    asset_types_json, modification, knowledge_tier, evidence_json.
    """
    rows = changes.where("service IS NOT NULL AND case_id IS NOT NULL").join(matched.select("spec_id", "case_id", "propagated"), "case_id")
    return rows.withColumn("service_key", canonical(key("service"))).withColumn("tier", effective_tier(F.col("knowledge_tier"), F.col("propagated"))).distinct()


def merge_services(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, values) of service_rows, merged by service."""
    types = F.coalesce(F.from_json("asset_types_json", "array<string>"), F.array().cast("array<string>"))
    fields = {"responsibilities": F.array("responsibility"), "asset_types": types, "modifications": F.array("modification"), "case_ids": F.array("case_id")}
    items = merged_items(rows, "service_key", "service", SERVICE_ORDER).withColumn("source", F.lit("matched-history"))
    return items, merged_values(rows, "service_key", SERVICE_ORDER, fields)


def add_code_services(services: DataFrame, code: DataFrame) -> DataFrame:
    """History services with the number of code entities that belong to them; services only code knows are candidates.

    services as merge_services gives its items; code: spec_id, service_key, service, n_entities.
    """
    c = code.select("spec_id", "service_key", F.col("service").alias("c_service"), "n_entities")
    both = services.join(c, ["spec_id", "service_key"], "full_outer")
    new = F.col("service").isNull()
    none = F.lit(0).cast("long")
    return both.select(
        "spec_id", "service_key", F.coalesce("service", "c_service").alias("service"), F.coalesce("n_cases", none).alias("n_cases"),
        (F.coalesce("n_evidence", none) + F.when(F.col("n_entities").isNotNull(), 1).otherwise(0)).alias("n_evidence"), F.coalesce("direct", F.lit(False)).alias("direct"),
        F.when(new, "candidate").otherwise(F.col("knowledge_tier")).alias("knowledge_tier"), F.when(new, True).otherwise(F.col("requires_confirmation")).alias("requires_confirmation"),
        F.when(new, "offline-code-candidate").otherwise(F.col("source")).alias("source"), F.coalesce("n_entities", none).alias("n_entities"),
    )


def cochange_cases(changes: DataFrame, cases: DataFrame) -> DataFrame:
    """(service_a, service_b, case_id): services that change in one trusted or candidate case, a < b, once per case."""
    usable = cases.where("knowledge_tier IN ('trusted', 'candidate')").select("case_id").distinct()
    rows = changes.where("normalized_service <> ''").select("case_id", "normalized_service").distinct().join(usable, "case_id", "left_semi")
    a, b = rows.withColumnRenamed("normalized_service", "service_a"), rows.withColumnRenamed("normalized_service", "service_b")
    return a.join(b, "case_id").where("service_a < service_b").select("service_a", "service_b", "case_id")


def build_cochange(pair_cases: DataFrame) -> DataFrame:
    """(service_a, service_b, case_count)."""
    return pair_cases.groupBy("service_a", "service_b").agg(F.count("case_id").alias("case_count"))


def score_cochange(pair_cases: DataFrame, direct_services: DataFrame, scores: DataFrame, fields: DataFrame, cases: DataFrame, canonical=lambda k: k) -> DataFrame:
    """Pairs with a service that matches directly, scored: spec_id, service_a, service_b, case_count, parts, score, expanded.

    pair_cases: service_a, service_b, case_id; direct_services: spec_id, service_key;
    scores and fields as in matching; cases: case_id, knowledge_tier. A pair's context and
    similarities are the best of its cases; cases not scored count 0.
    """
    pairs = build_cochange(pair_cases)
    sides = pairs.select("service_a", "service_b", "case_count", F.explode(F.array(canonical(F.col("service_a")), canonical(F.col("service_b")))).alias("service_key"))
    kept = sides.join(direct_services, "service_key").select("spec_id", "service_a", "service_b", "case_count").distinct()
    flat = kept.join(pair_cases, ["service_a", "service_b"])
    tiers = cases.groupBy("case_id").agg(F.max("knowledge_tier").alias("tier"))
    wide = fields.where("field IN ('business_objects', 'change_types')").groupBy("spec_id", "case_id").agg(
        F.max(F.when(F.col("field") == "business_objects", F.col("best"))).alias("o"), F.max(F.when(F.col("field") == "change_types", F.col("best"))).alias("t")
    )
    x = flat.join(tiers, "case_id", "left").join(scores, ["spec_id", "case_id"], "left").join(wide, ["spec_id", "case_id"], "left")
    zero = F.lit(0.0)
    s = x.groupBy("spec_id", "service_a", "service_b", "case_count").agg(
        capped_third(F.coalesce(F.max("score"), zero)).alias("context"),
        F.coalesce(F.max("o"), zero).alias("business_similarity"),
        F.coalesce(F.max("t"), zero).alias("change_similarity"),
        (F.count_if(F.col("tier") == "trusted") / F.greatest(F.count("case_id"), F.lit(1))).alias("trusted_ratio"),
    )
    s = s.withColumn("frequency", capped_third(F.col("case_count").cast("double")))
    total = sum((F.col(k) * w for k, w in PARTS.items()), F.lit(0.0))
    s = s.withColumn("score", F.round(F.round(total, 8), 4))
    least, score, best = EXPAND
    expanded = (F.col("case_count") >= least) & (F.col("score") >= score) & (F.greatest("business_similarity", "change_similarity") >= best)
    return s.withColumn("expanded", expanded).select(
        "spec_id", "service_a", "service_b", "case_count", *[F.round(k, 4).alias(k) for k in PARTS], "score", "expanded"
    )


def expand_services(scored: DataFrame, services: DataFrame, canonical=lambda k: k) -> DataFrame:
    """(spec_id, service_key, service, score): services one hop away through expanding pairs; the first pair by name counts."""
    sides = scored.where("expanded").select(
        "spec_id", "score", "service_a", "service_b", F.posexplode(F.array("service_a", "service_b")).alias("side", "service")
    ).withColumn("service_key", canonical(F.col("service")))
    new = sides.join(services.select("spec_id", "service_key"), ["spec_id", "service_key"], "left_anti")
    return first_by(new, ["spec_id", "service_key"], ["service_a", "service_b", "side"]).select("spec_id", "service_key", "service", "score")


def tier_counts(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", "knowledge_tier").distinct().groupBy("knowledge_tier").agg(F.count(F.lit(1)).alias("n_cases"))


def scan_counts(matched: DataFrame, cases: DataFrame) -> DataFrame:
    """(spec_id, total_cases, matched_cases, direct_matches, relation_propagated_matches)."""
    total = cases.select("case_id").distinct().count()
    return matched.groupBy("spec_id").agg(
        F.lit(total).cast("long").alias("total_cases"), F.count(F.lit(1)).alias("matched_cases"),
        F.count_if(~F.col("propagated")).alias("direct_matches"), F.count_if("propagated").alias("relation_propagated_matches"),
    )


def items_of_matched(items: DataFrame, matched: DataFrame) -> DataFrame:
    """Omissions or conflicts of matched cases, with the tier they have there; items without tier keep none."""
    x = items.join(matched.select("spec_id", "case_id", "propagated"), "case_id")
    if "knowledge_tier" in items.columns:
        x = x.withColumn("knowledge_tier", effective_tier(F.col("knowledge_tier"), F.col("propagated")))
    return x.drop("propagated")
