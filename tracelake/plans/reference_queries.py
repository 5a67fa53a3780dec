"""The library's operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.functions import tiers
from tracelake.functions.digests import digest_value
from tracelake.operators import graph, impact, manifest, matching, replay, rules, shred
from tracelake.runtime import cut, table
from tracelake.sources import inventory

#: Two change specs, in terms the tables have.
SPECS = {
    "freeze": {
        "business_objects": ["customer order", "deposit invoice"], "capabilities": ["voucher rollover", "deposit suspension"], "change_types": ["archiving rule", "notification window"],
        "actions": ["transfer order", "freeze deposit"], "states": ["order pending", "deposit rejected"], "actors": ["itinerary cashier"], "triggers": ["throttling signal"],
        "invariants": ["no deposit withdrawal twice"], "changed_rules": ["splitting limit per envelope"], "before_behaviors": ["ships at once"], "after_behaviors": [],
    },
    "refund": {"business_objects": ["refund licence", "预付押金"], "change_types": ["reversal channel"], "states": ["warehouse overdue"], "actions": ["replay refund"]},
}


def _low(c):
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


# ---- tables -----------------------------------------------------------------------------


def _cases(spark, d):
    return table(spark, d, "cases").distinct()


def _changes(spark, d):
    return table(spark, d, "service_changes").distinct()


def _manifest(spark, d, snapshot: int):
    rows = table(spark, d, "manifest").where(F.col("snapshot_no") == snapshot).select("path", F.hex(digest_value("sha256")).alias("sha256"), "received_at")
    return manifest.current_documents(rows)


def _sourced_cases(spark, d):
    """Cases with the content their document had in the fourth snapshot."""
    then = _manifest(spark, d, 4).select(F.col("path_key").alias("k"), F.col("sha256").alias("source_sha"))
    rows = _cases(spark, d).select("case_id", "doc_path", "validation_status", X.path_key("doc_path").alias("k"))
    return rows.join(then, "k", "left").drop("k")


def _decisions(spark, d):
    return _manifest(spark, d, 8).where("path LIKE '%.yaml'").select("path", "sha256", F.lit("non-design").alias("classification"))


def _case_keys(spark, d):
    terms = table(spark, d, "case_terms").withColumn("normalized", F.trim("normalized"))
    return matching.case_keys(terms, F.col("normalized"), "term_id")


def _spec_terms(spark):
    return matching.spec_terms(spark, SPECS)


def _scored(spark, d):
    matches = matching.term_matches(_spec_terms(spark), _case_keys(spark, d))
    fields = cut(matching.field_scores(matches), "reference-fields")
    return fields, matching.case_scores(fields)


def _direct(spark, d):
    return matching.direct_matches(_scored(spark, d)[1], _cases(spark, d))


def _matched(spark, d):
    direct = _direct(spark, d)
    none = direct.select("spec_id", "case_id").limit(0)
    return impact.matched_cases(direct, none)


def _relations(spark, d):
    """A relation of each case from its first business object to its first state."""
    terms = table(spark, d, "case_terms").where("normalized <> ''")
    first = lambda t: F.min(F.when(F.col("term_type") == t, F.col("normalized")))
    rows = terms.groupBy("case_id").agg(first("business_object").alias("source"), first("state").alias("target")).where("source IS NOT NULL AND target IS NOT NULL")
    rows = rows.join(_cases(spark, d).select("case_id", "knowledge_tier"), "case_id")
    modes = F.array(*[F.lit(m) for m in ("forward", "reverse", "bidirectional", "none")])
    return rows.withColumn("propagation", F.element_at(modes, F.length("source") % 4 + 1)).withColumn("relation_ord", F.col("case_id"))


def _code(spark, d):
    """Services as code entities, but for audits; services that change together as edges."""
    rows = table(spark, d, "service_cochange").select(F.least(_low("service_a"), _low("service_b")).alias("source_id"), F.greatest(_low("service_a"), _low("service_b")).alias("target_id"))
    edges = rows.where("source_id <> target_id").distinct().withColumn("relation_ord", F.concat_ws(">", "source_id", "target_id"))
    names = edges.select(F.col("source_id").alias("entity_id")).union(edges.select("target_id")).distinct()
    entities = names.where("entity_id NOT LIKE '%-audit'").withColumn("service", F.col("entity_id")).withColumn("entity_type", F.element_at(F.split("entity_id", "-"), -1))
    mappings = names.select(
        F.col("entity_id").alias("mapping_ord"), F.element_at(F.split("entity_id", "-"), 1).alias("business_object"), F.lit(None).cast("string").alias("state"),
        F.lit(None).cast("string").alias("action"), F.col("entity_id").alias("asset_id"), F.lit("medium").alias("confidence"),
    )
    return edges, entities, mappings


def _code_specs(spark):
    return matching.spec_terms(spark, {"code": {"business_objects": ["wallet", "parcel"]}})


def _seeds(spark, d):
    _, entities, mappings = _code(spark, d)
    return graph.mapping_seeds(mappings, _code_specs(spark), entities, key=_low)


# ---- queries ----------------------------------------------------------------------------


def _deltas(spark, d):
    """The delta of each of the eight snapshots to the one before it."""
    one = lambda n: manifest.manifest_delta(_manifest(spark, d, n), _manifest(spark, d, n - 1)).select(F.lit(n).alias("snapshot_no"), "path", "from_path", "change_kind")
    return rules.union([one(n) for n in range(2, 9)])


def r_manifest_delta(spark, d):
    """JN4, JN5, SO1: listings compared, moves told from additions and removals."""
    return _deltas(spark, d)


def r_delta_counts(spark, d):
    return _deltas(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("n_documents"))


def r_case_lifecycle(spark, d):
    """JN3, JN6: what became of each case's document."""
    return manifest.case_lifecycle(_sourced_cases(spark, d), _manifest(spark, d, 8)).select("case_id", "status", "new_path")


def r_lifecycle_counts(spark, d):
    return manifest.lifecycle_counts(manifest.case_lifecycle(_sourced_cases(spark, d), _manifest(spark, d, 8)))


def r_pending_extraction(spark, d):
    """JN7, SC9: documents nothing was extracted from."""
    docs = _manifest(spark, d, 8).where("sha256 IS NOT NULL")
    return manifest.pending_extraction(docs, _sourced_cases(spark, d), _decisions(spark, d)).select("path")


def r_pending_validation(spark, d):
    """JN8, FL11: documents with unverified cases."""
    return manifest.pending_validation(_manifest(spark, d, 8), _sourced_cases(spark, d)).select("path")


def r_document_index(spark, d):
    """SK7: the cases of each document."""
    return manifest.document_index(_cases(spark, d))


def r_documents_first(spark, d):
    """AG16: each document's first case names it."""
    rows = _cases(spark, d).withColumn("version", F.lit(None).cast("string"))
    return manifest.first_documents(rows, "case_id").select("doc_path", "title")


def r_discovery(spark, d):
    """SC2, SC3, SC5, SF8, SF12: discovery filter, version hint and design score of each path."""
    rows = table(spark, d, "manifest").select("path", "relative_path", "extension").distinct()
    keep = F.col("extension").isin(*inventory.extensions(None)) & inventory.not_excluded(F.col("relative_path"), ["escrow/*", "*refund*.pdf"])
    keep = keep & inventory.in_workspace(F.col("relative_path"), False)
    return rows.where(keep).select("path", X.extension("path").alias("extension"), X.possible_version("path").alias("possible_version"), X.design_score("path").alias("design_score"))


def r_multi_root(spark, d):
    """SC4: of a document found under several roots, the first root's row counts."""
    rows = table(spark, d, "manifest").select("root", "relative_path").distinct()
    order = rows.select("root").distinct().groupBy().agg(F.sort_array(F.collect_set("root")).alias("r")).select(F.posexplode("r").alias("root_ord", "root"))
    rows = rows.join(order, "root").withColumnRenamed("relative_path", "path")
    return inventory.first_root_wins(rows, F.lower("path"), "root_ord").select("path", "root")


def r_snapshot_states(spark, d):
    """SF13, AG11: the last capture of each repository against the one before."""
    from pyspark.sql import Window

    from tracelake.functions.digests import same_commit

    by = Window.partitionBy("name").orderBy("capture_no")
    rows = table(spark, d, "repositories").groupBy("name", "capture_no").agg(F.max(F.struct("received_at", "commit_sha")).getField("commit_sha").alias("commit_sha"))
    rows = rows.withColumn("before", F.lag("commit_sha").over(by)).withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("capture_no")))).where("n = 1")
    status = F.when(F.col("before").isNull() | F.col("commit_sha").isNull(), "unknown").when(same_commit(F.col("commit_sha"), F.col("before")), "fresh").otherwise("stale")
    return rows.select("name", status.alias("status"))


def r_term_keys(spark, d):
    """SF1, SF9: stored keys and stable ids of terms."""
    rows = table(spark, d, "case_terms").select("normalized").distinct().where("normalized <> ''")
    return rows.select("normalized", X.term_id("normalized").alias("term_key"))


def r_term_tokens(spark, d):
    """SF5: lexical tokens of the distinct terms."""
    rows = table(spark, d, "case_terms").select("normalized").distinct().where("normalized <> ''")
    return rows.select("normalized", F.concat_ws("|", F.sort_array(X.lexical_tokens("normalized"))).alias("tokens"))


def r_relation_ids(spark, d):
    """SF10: stable ids of relations."""
    r = _relations(spark, d)
    return r.select("case_id", X.relation_id(F.col("case_id"), F.col("source"), F.lit("affects"), F.col("target"), F.lit(None).cast("string"), F.col("propagation")).alias("stable_id"))


def r_best_matches(spark, d):
    """JN1, WN1, FL5: the best term of each case for each spec term."""
    m = matching.term_matches(_spec_terms(spark), _case_keys(spark, d))
    return m.select("spec_id", "case_id", "field", "wanted", "actual", "score", "match_type")


def r_case_scores(spark, d):
    """AG1: weighted scores of cases."""
    return _scored(spark, d)[1]


def r_direct_matches(spark, d):
    """FL3, FL4: cases that match directly."""
    return _direct(spark, d)


def r_scan_counts(spark, d):
    """AG8: how many cases were scanned and matched."""
    return impact.scan_counts(_matched(spark, d), _cases(spark, d))


def r_tier_counts(spark, d):
    """SN1, AG8: cases by tier, which follows from their validation status."""
    rows = _cases(spark, d).withColumn("knowledge_tier", tiers.tier_of_status(F.col("validation_status")))
    return impact.tier_counts(rows)


def r_item_tiers(spark, d):
    """SN2: tiers of scenarios."""
    rows = table(spark, d, "scenarios").distinct().join(_cases(spark, d).select("case_id", F.col("knowledge_tier").alias("case_tier")), "case_id")
    tier = tiers.item_tier(F.col("case_tier"), F.get_json_object("evidence_json", "$.kind"))
    return rows.select("scenario_id", tier.alias("item_tier"), tiers.requires_confirmation(tier).alias("requires_confirmation"))


def _first(*columns):
    return [F.col(f"first.{c}").alias(f"first_{c}") for c in columns]


def r_scenario_merge(spark, d):
    """AG2, AG4: scenarios of matched cases, merged by name."""
    items, _ = impact.merge_scenarios(impact.scenario_rows(table(spark, d, "scenarios"), _matched(spark, d), key=_low))
    return items.select("spec_id", "scenario_key", "scenario", "n_cases", "n_evidence", "knowledge_tier", "requires_confirmation")


def r_scenario_values(spark, d):
    """AG2, WN3: what the merged scenarios hold, in order of first appearance."""
    _, values = impact.merge_scenarios(impact.scenario_rows(table(spark, d, "scenarios"), _matched(spark, d), key=_low))
    return values.select("spec_id", "scenario_key", "field", "value", *_first("name", "case_id", "scenario_id"))


def _services(spark, d):
    return impact.merge_services(impact.service_rows(_changes(spark, d), _matched(spark, d), key=_low))


def r_service_merge(spark, d):
    """AG3, AG4: services of matched cases, merged by name."""
    return _services(spark, d)[0].select("spec_id", "service_key", "service", "n_cases", "n_evidence", "knowledge_tier", "requires_confirmation")


def r_service_values(spark, d):
    """AG3: what the merged services hold, in order of first appearance."""
    return _services(spark, d)[1].select("spec_id", "service_key", "field", "value", *_first("normalized_service", "case_id", "service_change_id"))


def r_cochange_build(spark, d):
    """JN13, AG5: services that change in one case."""
    return impact.build_cochange(impact.cochange_cases(_changes(spark, d), _cases(spark, d)))


def _cochange_scored(spark, d, least: float = 1.0):
    fields, scores = _scored(spark, d)
    strong = matching.direct_matches(scores, _cases(spark, d), least)
    matched = impact.matched_cases(strong, strong.select("spec_id", "case_id").limit(0))
    services = cut(impact.service_rows(_changes(spark, d), matched, key=_low).select("spec_id", "service_key").distinct(), "reference-services")
    pairs = impact.cochange_cases(_changes(spark, d), _cases(spark, d))
    return impact.score_cochange(pairs, services, scores, fields, _cases(spark, d)), services


def r_cochange_score(spark, d):
    """JN12, AG6, AG7, FL8, FL9: scored pairs around the services that match directly."""
    return _cochange_scored(spark, d)[0]


def r_service_expansion(spark, d):
    """GR6, WN8: services one hop away from those of cases that score 4 or more (of all cases, nearly every service matches directly)."""
    scored, services = _cochange_scored(spark, d, 4.0)
    return impact.expand_services(scored, services)


def r_quality_report(spark, d):
    """AG9: the quality report."""
    none = _cases(spark, d).select("case_id").limit(0)
    return shred.quality_counts(_cases(spark, d), table(spark, d, "scenarios").distinct(), _changes(spark, d), none)


def r_review_queue(spark, d):
    """AG9: cases for people to look at."""
    return shred.review_queue(_cases(spark, d)).select("case_id", "title", "validation_status", "confidence")


def r_relation_walk(spark, d):
    """GR1, JN2, FL6, FL10: relations reached from the spec's terms."""
    seeds = _spec_terms(spark).select("spec_id", "key")
    return graph.propagate_relations(_relations(spark, d), seeds, 2, endpoint_key=lambda c: F.col(c)).select("spec_id", "depth", "case_id")


def r_propagated_cases(spark, d):
    """GR2, SO2: cases that only relations lead to."""
    seeds = _spec_terms(spark).select("spec_id", "key")
    hits = graph.propagate_relations(_relations(spark, d), seeds, 2, endpoint_key=lambda c: F.col(c))
    return graph.propagated_cases(hits, _direct(spark, d).select("spec_id", "case_id"))


def r_code_seeds(spark, d):
    """GR3, JN9, FL7, WN4: code assets whose mapping matches."""
    return _seeds(spark, d).select("spec_id", "entity_id", "score")


def r_code_walk(spark, d):
    """GR4, JN10, SN8, WN5: code reached from the seeds."""
    edges, entities, _ = _code(spark, d)
    impacts, _ = graph.code_walk(edges, entities, _seeds(spark, d), 2)
    return impacts.select("spec_id", "entity_id", "depth", "score", "source")


def r_code_paths(spark, d):
    """GR4: every edge walked, with its depth."""
    edges, entities, _ = _code(spark, d)
    _, paths = graph.code_walk(edges, entities, _seeds(spark, d), 2)
    return paths.select("spec_id", "depth", "source_id", "target_id")


def r_code_services(spark, d):
    """AG13: impacted services."""
    edges, entities, _ = _code(spark, d)
    impacts, _ = graph.code_walk(edges, entities, _seeds(spark, d), 2)
    return graph.code_services(impacts, entities, key=_low)


def r_all_services(spark, d):
    """JN11: services of history and code, merged."""
    _, entities, _ = _code(spark, d)
    items, _ = _services(spark, d)
    impacts = entities.select(F.lit("freeze").alias("spec_id"), "entity_id")
    code = graph.code_services(impacts, entities, key=_low)
    return impact.add_code_services(items, code).select("spec_id", "service_key", "n_evidence", "knowledge_tier", "source", "n_entities")


def _predictions(spark, d):
    rows = _changes(spark, d).where("normalized_service <> ''").select(F.lit("services").alias("kind"), "case_id", "normalized_service", "asset_types_json", "knowledge_tier")
    return rows.where("asset_types_json LIKE '%api%'"), rows.where("knowledge_tier = 'trusted'")


def r_replay_metrics(spark, d):
    """JN16, SO3, SN12, AG14: precision and recall per case."""
    return replay.with_metrics(replay.set_counts(*_predictions(spark, d), ["kind", "case_id"], "normalized_service")).drop("kind")


def r_replay_overall(spark, d):
    """AG14: the micro average."""
    return replay.overall(replay.set_counts(*_predictions(spark, d), ["kind", "case_id"], "normalized_service"), ["kind"])


def r_threshold_misses(spark, d):
    """FL13: metrics below their threshold."""
    rated = replay.overall(replay.set_counts(*_predictions(spark, d), ["kind", "case_id"], "normalized_service"), ["kind"])
    return replay.threshold_misses(rated, {"services_precision": 0.9, "services_recall": 0.1, "services_f1": 0.99})


def r_replay_differences(spark, d):
    """SO3, ST4: services missed and not expected."""
    return replay.set_differences(*_predictions(spark, d), ["case_id"], "normalized_service").select("case_id", "kind", "normalized_service")


def r_replay_evidence(spark, d):
    """JN17: evidence of scenarios that were predicted."""
    rows = table(spark, d, "scenarios").where("name IS NOT NULL").select(F.lower("name").alias("scenario"), "case_id", "knowledge_tier").join(_cases(spark, d).select("case_id", F.coalesce("domain", F.lit("none")).alias("replay_id")), "case_id")
    return replay.evidence_counts(rows.where("knowledge_tier = 'trusted'").drop("knowledge_tier"), rows.where("knowledge_tier <> 'rejected'").drop("knowledge_tier"))


def r_rule_errors(spark, d):
    """V rules, SF14, SN: rules over manifest rows in one pass."""
    rows = table(spark, d, "manifest").withColumn("id", F.concat_ws("#", "snapshot_no", "path"))
    found = rules.check(rows, "id", [
        rules.Rule("sha256", ~X.is_digest("sha256"), "sha256 is no digest"), rules.Rule("size", F.col("size").isNull(), "size is not given"),
        rules.Rule("extension", rules.not_in(F.col("extension"), (".md", ".txt", ".html", ".docx", ".pdf")), "extension is not known"),
    ])
    return found.groupBy("path", "message").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("object_id").alias("n_objects"))


def r_missing_references(spark, d):
    """JN14: cases whose document the last listing does not have, and terms without case."""
    cases, docs = _cases(spark, d), _manifest(spark, d, 8)
    a = rules.missing_reference(cases, "case_id", "doc_path", docs, "path", "cases[].doc_path", "not in the manifest")
    b = rules.missing_reference(table(spark, d, "case_terms"), "term_id", "case_id", cases, "case_id", "case_terms[].case_id", "no such case")
    return rules.union([a, b])


def r_duplicates(spark, d):
    """WN2, WN7: terms that repeat a key, with the first of each."""
    return rules.duplicates(table(spark, d, "case_terms"), ["case_id", "term_type", "normalized"], ["term_id"], "term_id").select("term_id", "first_seen")


def r_unverified(spark, d):
    """V4, JN15 pattern: trusted changes without explicit evidence."""
    rows = _changes(spark, d).withColumn("kind", F.get_json_object("evidence_json", "$.kind"))
    return rows.where("knowledge_tier = 'trusted'").where(rules.not_in(F.col("kind"), ("explicit",))).select("service_change_id")


def r_unproven_mappings(spark, d):
    """JN15: mappings of high confidence whose call is not ok and fresh: trusted changes as mappings, their cases as calls."""
    mappings = _changes(spark, d).select(F.col("service_change_id").alias("ord"), F.col("case_id").alias("_call"), F.when(F.col("knowledge_tier") == "trusted", "high").otherwise("low").alias("confidence"))
    calls = _cases(spark, d).select(
        F.col("case_id").alias("call_id"), F.when(F.col("validation_status") == "validated", "ok").otherwise("error").alias("status"),
        F.when(F.col("confidence") == "high", "fresh").otherwise("unknown").alias("staleness"),
    )
    return rules.unproven_mappings(mappings, calls).select(F.col("object_id").cast("long").alias("service_change_id"))


def r_snapshot_status(spark, d):
    """AG11: the state of a snapshot, from what its captures say of each call: one row for all captures, one for those of the last."""
    rows = table(spark, d, "repositories")
    calls = lambda df: df.select(F.when(F.col("path").isNull(), "error").otherwise("ok").alias("status"), F.when(F.col("commit_sha").isNull(), "unknown").otherwise("fresh").alias("staleness"))
    last = rows.where("path IS NOT NULL AND commit_sha IS NOT NULL")
    return shred.snapshot_status(calls(rows)).withColumn("part", F.lit("all")).unionByName(shred.snapshot_status(calls(last)).withColumn("part", F.lit("known")))


def r_compiled_rows(spark, d):
    """SH2, SH3: the rows that shredding gives for terms and scenarios, not only how many."""
    tables = shred.history_tables(nested_cases(spark, d))
    terms = tables["case_terms"].select("case_id", F.col("term_type").alias("part"), "term")
    return terms.unionByName(tables["scenarios"].select("case_id", F.lit("scenario").alias("part"), F.col("name").alias("term")))


def r_shredded(spark, d):
    """SH1-SH4, SN9-SN11: cases nested to JSON records and shredded again into terms, scenarios and changes."""
    tables = shred.history_tables(nested_cases(spark, d))
    one = lambda name: tables[name].groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).select("case_id", F.lit(name).alias("part"), "n")
    return rules.union([one(n) for n in ("cases", "case_terms", "scenarios", "service_changes")])


def nested_cases(spark, d) -> DataFrame:
    """The tables as nested case records, as a loader of case files gives them."""
    types = {t: f for f, t in shred.TERM_FIELDS.items()}
    terms = table(spark, d, "case_terms").groupBy("case_id").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("term_type") == t, F.struct("term_id", "term")))), lambda x: x["term"]).alias(f) for t, f in types.items()
    ])
    scen = table(spark, d, "scenarios").distinct().groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct("scenario_id", "name", "precondition", F.col("trigger_text").alias("trigger"), "expected_behavior"))).alias("scenarios")
    )
    chg = _changes(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("service_change_id", "service", "responsibility", F.array("modification").alias("modifications")))).alias("service_changes"))
    base = _cases(spark, d).select(
        "case_id", "title", "domain", F.struct(F.col("doc_path").alias("path")).alias("source"), F.struct(F.col("validation_status").alias("status"), "confidence").alias("validation")
    )
    rows = base.join(terms, "case_id", "left").join(scen, "case_id", "left").join(chg, "case_id", "left")
    raw = F.to_json(F.struct(*rows.columns))
    loaded = rows.select(F.lit(0).alias("file_ord"), F.col("case_id").alias("case_ord"), raw.alias("raw"), F.parse_json(raw).alias("v"))
    return cut(shred.case_rows(loaded).drop("v"), "reference-nested").withColumn("v", F.parse_json("full_json"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("r_")}
