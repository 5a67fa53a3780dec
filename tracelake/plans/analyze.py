"""From change specs and stores to what they affect."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import match_key
from tracelake.operators import graph, impact, matching, replay, shred
from tracelake.runtime import cut


@dataclass
class Impact:
    """Results for all specs, one table each; every table has spec_id."""

    matched: DataFrame
    matches: DataFrame
    history_paths: DataFrame
    scenarios: DataFrame
    scenario_values: DataFrame
    services: DataFrame
    service_values: DataFrame
    cochanges: DataFrame
    expanded_services: DataFrame
    omissions: DataFrame
    conflicts: DataFrame
    code_impacts: DataFrame | None
    code_paths: DataFrame | None
    issues: list[tuple[str, str]]


def stored_terms(history: dict[str, DataFrame]) -> DataFrame:
    """Terms to match with: the stored ones, and behaviours, which are kept in the records only."""
    records = history["cases"].withColumn("v", F.parse_json("full_json"))
    behaviours = shred.case_terms(records, shred.MATCHED_FIELDS)
    terms = history["case_terms"].select("case_id", "term_type", "term", "field_ord", "pos").unionByName(behaviours.select("case_id", "term_type", "term", "field_ord", "pos"))
    return terms.withColumn("ord", F.col("field_ord") * 1_000_000 + F.col("pos"))


def analyze(
    spark: SparkSession,
    history: dict[str, DataFrame],
    specs: dict[str, dict],
    aliases: DataFrame | None = None,
    code: dict[str, DataFrame] | None = None,
    min_match_score: float = 1.0,
    graph_depth: int = 2,
) -> Impact:
    """Match all specs against a history store, and a code store if given. No result is cut to its best rows."""
    keyed = matching.alias_keys(aliases) if aliases is not None else None
    resolve = lambda key: matching.canonical(key, keyed)
    named = lambda c: resolve(match_key(c))
    terms = cut(matching.spec_terms(spark, specs, keyed), "analyze-specs")
    stored = stored_terms(history)
    keys = cut(matching.case_keys(stored, named("term"), "ord"), "analyze-keys")
    matches = cut(matching.term_matches(terms, keys), "analyze-matches")
    fields = matching.field_scores(matches)
    scores = cut(matching.case_scores(fields), "analyze-scores")
    cases = history["cases"].drop("full_json", "validation_json")
    direct = matching.direct_matches(scores, cases, min_match_score)
    relations = history["relations"].withColumn("relation_ord", F.struct("file_ord", "case_ord", "pos", "stable_id"))
    hits = graph.propagate_relations(relations, terms.select("spec_id", "key"), graph_depth)
    matched = cut(impact.matched_cases(direct, graph.propagated_cases(hits, direct.select("spec_id", "case_id"))), "analyze-matched")
    scenarios, scenario_values = impact.merge_scenarios(impact.scenario_rows(history["scenarios"].withColumn("scenario_id", F.col("pos")), matched, named, resolve))
    changes = history["service_changes"].withColumn("service_change_id", F.col("pos") * 1_000_000 + F.col("sub_pos"))
    services, service_values = impact.merge_services(impact.service_rows(changes, matched, named, resolve))
    services = cut(services, "analyze-services")
    impacts = paths = None
    merged = services.withColumn("n_entities", F.lit(0).cast("long"))
    if code is not None:
        mappings = code["business_mappings"].withColumn("mapping_ord", F.col("ord"))
        edges = code["relations"].withColumn("relation_ord", F.col("ord"))
        seeds = graph.mapping_seeds(mappings, terms, code["entities"], named)
        impacts, paths = graph.code_walk(edges, code["entities"], seeds, graph_depth)
        merged = impact.add_code_services(services, graph.code_services(impacts, code["entities"]))
    pairs = impact.cochange_cases(changes, cases)
    scored = impact.score_cochange(pairs, services.where("direct").select("spec_id", "service_key"), scores, fields, cases, named)
    expanded = impact.expand_services(scored, merged, named)
    return Impact(
        matched, matches, hits, scenarios, scenario_values, merged, service_values, scored, expanded,
        impact.items_of_matched(history["historical_omissions"], matched), impact.items_of_matched(history["conflicts"], matched), impacts, paths, matching.spec_issues(specs),
    )


def replay_metrics(found: Impact, answers: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(per case, overall) metrics by kind: scenario, service and evidence; spec_id is the answer's id.

    answers: {id, expected_scenarios, expected_services: lists of names, as text or objects;
    expected_evidence: list of {scenario, case_ids}}. Evidence counts for scenarios that were
    found; of entries for one scenario the last counts.
    """
    counts = answer_counts(found, answers)
    return replay.with_metrics(counts), replay.overall(counts, ["kind"])


def answer_counts(found: Impact, answers: list[dict]) -> DataFrame:
    """(kind, spec_id, tp, fp, fn), see replay_metrics; every answer has a row for each kind."""
    spark = found.matched.sparkSession
    rows = []
    for a in answers:
        for kind, field in (("scenario", "scenario"), ("service", "service")):
            values = a.get(f"expected_{kind}s")
            for x in values if isinstance(values, list) else []:
                name = x.get(field) if isinstance(x, dict) else x
                if isinstance(name, str) and name.strip():
                    rows.append((kind, a["id"], name))
    expected = spark.createDataFrame(rows, "kind string, spec_id string, name string").withColumn("name", match_key("name"))
    names = found.scenarios.select(F.lit("scenario").alias("kind"), "spec_id", match_key("scenario").alias("name"))
    for services in (found.services, found.expanded_services):
        names = names.unionByName(services.select(F.lit("service").alias("kind"), "spec_id", match_key("service").alias("name")))
    ids = spark.createDataFrame([(a["id"],) for a in answers], "spec_id string")
    counts = replay.set_counts(names.join(ids, "spec_id", "left_semi"), expected, ["kind", "spec_id"], "name")
    wanted: dict[tuple[str, str], list[str]] = {}
    for a in answers:
        values = a.get("expected_evidence")
        for x in values if isinstance(values, list) else []:
            if isinstance(x, dict) and isinstance(x.get("scenario"), str) and isinstance(x.get("case_ids", []), list):
                wanted[a["id"], x["scenario"]] = [c for c in x.get("case_ids", []) if isinstance(c, str)]
    asked = spark.createDataFrame([(*k, v) for k, v in wanted.items()], "replay_id string, scenario string, ids array<string>")
    asked = asked.select("replay_id", match_key("scenario").alias("scenario"), F.explode_outer("ids").alias("case_id")).withColumn("case_id", F.coalesce(match_key("case_id"), F.lit("")))
    shown = found.scenarios.select("spec_id", "scenario_key", match_key("scenario").alias("scenario"))
    held = found.scenario_values.where("field = 'case_ids'").join(shown, ["spec_id", "scenario_key"]).select(F.col("spec_id").alias("replay_id"), "scenario", match_key("value").alias("case_id"))
    evidence = replay.evidence_counts(held.join(ids.withColumnRenamed("spec_id", "replay_id"), "replay_id", "left_semi"), asked)
    evidence = evidence.select(F.lit("evidence").alias("kind"), F.col("replay_id").alias("spec_id"), "tp", "fp", "fn")
    every = ids.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("scenario", "service", "evidence")])))
    some = every.join(counts.unionByName(evidence), ["kind", "spec_id"], "left")
    return some.select("kind", "spec_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
