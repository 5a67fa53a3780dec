"""Nested JSON records shredded into relational tables, with trust tiers and stable ids.

Records are VARIANT beside their text. Every list keeps its positions, so the order of the
input is the order of the rows; nothing depends on the order of a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as X
from tracelake.functions.jsons import items_at, kind, one_or_many, text_at, truthy
from tracelake.functions.tiers import item_tier, tier_of_status
from tracelake.operators.manifest import first_documents
from tracelake.operators.matching import first_by

# Lists of a case that become terms, with their term types.
TERM_FIELDS = {
    "business_objects": "business_object", "capabilities": "capability", "change_types": "change_type", "actions": "action", "states": "state",
    "actors": "actor", "triggers": "trigger", "business_invariants": "invariant", "changed_rules": "changed_rule",
}
# Lists of a case that are matched like terms but not stored as such.
MATCHED_FIELDS = {"before_behaviors": "before_behavior", "after_behaviors": "after_behavior"}


def json_at(v: Column, path: str, absent: str) -> Column:
    """JSON text of the value at path, absent where there is none."""
    return F.coalesce(F.to_json(F.try_variant_get(v, path, "variant")), F.lit(absent))


def case_rows(loaded: DataFrame) -> DataFrame:
    """(file_ord, case_ord, case_id, title, doc_path, source_sha, version, domain, validation_status, confidence, knowledge_tier, validation_json, full_json, v)."""
    v = F.col("v")
    status = text_at(v, "$.validation.status")
    return loaded.select(
        "file_ord", "case_ord", F.trim(text_at(v, "$.case_id")).alias("case_id"), text_at(v, "$.title").alias("title"),
        text_at(v, "$.source.path").alias("doc_path"), text_at(v, "$.source.sha256").alias("source_sha"), text_at(v, "$.source.version").alias("version"),
        text_at(v, "$.domain").alias("domain"), status.alias("validation_status"), text_at(v, "$.validation.confidence").alias("confidence"),
        tier_of_status(status).alias("knowledge_tier"), json_at(v, "$.validation", "{}").alias("validation_json"), F.col("raw").alias("full_json"), "v",
    )


def fresh_cases(cases: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, stale): cases whose source has another content now are stale; cases without usable source are kept, to be found invalid."""
    x = cases.withColumn("_key", X.path_key("doc_path")).join(active.select(F.col("path_key").alias("_key"), F.col("sha256").alias("_sha")), "_key", "left")
    usable = F.col("doc_path").isNotNull() & F.col("source_sha").isNotNull()
    stale = usable & ~F.coalesce(F.col("_sha") == F.lower("source_sha"), F.lit(False))
    return x.where(~stale).select(*cases.columns), x.where(stale).select(*cases.columns)


def _live(cases: DataFrame) -> DataFrame:
    return cases.where("knowledge_tier <> 'rejected'")


def _each(cases: DataFrame, path: str) -> DataFrame:
    """One row per object of the list at path, with its position."""
    return _live(cases).select("file_ord", "case_ord", "case_id", "knowledge_tier", F.posexplode(items_at(F.col("v"), path)).alias("pos", "item"))


def case_terms(cases: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """(case_id, term_type, term, normalized, pos): strings of the term lists that are not blank; of equal keys the first."""
    fields = TERM_FIELDS if fields is None else fields
    lists = F.array(*[F.struct(F.lit(n).alias("field_ord"), F.lit(t).alias("term_type"), items_at(F.col("v"), f"$.{f}").alias("items")) for n, (f, t) in enumerate(fields.items())])
    rows = _live(cases).select("file_ord", "case_ord", "case_id", F.explode(lists).alias("f")).select("file_ord", "case_ord", "case_id", "f.field_ord", "f.term_type", F.posexplode("f.items").alias("pos", "item"))
    rows = rows.where(kind(F.col("item")) == "string").withColumn("term", F.try_variant_get("item", "$", "string")).where(F.trim("term") != "")
    rows = rows.withColumn("normalized", X.stored_key("term"))
    return first_by(rows, ["case_id", "term_type", "normalized"], ["file_ord", "case_ord", "pos"]).select("case_id", "term_type", "term", "normalized", "field_ord", "pos")


def scenarios(cases: DataFrame) -> DataFrame:
    item = F.col("item")
    rows = _each(cases, "$.scenarios").where((kind(item) == "object") & truthy(F.try_variant_get(item, "$.name", "variant")))
    return rows.select(
        "case_id", "pos", text_at(item, "$.name").alias("name"), text_at(item, "$.precondition").alias("precondition"), text_at(item, "$.trigger").alias("trigger_text"),
        text_at(item, "$.expected_behavior").alias("expected_behavior"), item_tier(F.col("knowledge_tier"), text_at(item, "$.evidence.kind")).alias("knowledge_tier"),
        json_at(item, "$.evidence", "{}").alias("evidence_json"),
    )


def service_changes(cases: DataFrame) -> DataFrame:
    """One row per modification; a change without any has one row with ''."""
    item = F.col("item")
    rows = _each(cases, "$.service_changes").where((kind(item) == "object") & truthy(F.try_variant_get(item, "$.service", "variant")))
    rows = rows.withColumn("service", F.trim(text_at(item, "$.service"))).select("*", F.posexplode(one_or_many(item, "$.modifications")).alias("sub_pos", "modification"))
    return rows.select(
        "case_id", "pos", "sub_pos", "service", X.stored_key("service").alias("normalized_service"), text_at(item, "$.responsibility").alias("responsibility"),
        json_at(item, "$.asset_types", "[]").alias("asset_types_json"), F.coalesce("modification", F.lit("")).alias("modification"),
        item_tier(F.col("knowledge_tier"), text_at(item, "$.evidence.kind")).alias("knowledge_tier"), json_at(item, "$.evidence", "{}").alias("evidence_json"),
    )


def relations(cases: DataFrame) -> DataFrame:
    """Relations with source, type and target, under a stable id; of equal ids the first."""
    item = F.col("item")
    rows = _each(cases, "$.relations").where(kind(item) == "object")
    for name, path in (("source", "$.source"), ("relation_type", "$.type"), ("target", "$.target")):
        rows = rows.withColumn(name, text_at(item, path))
    rows = rows.where("source <> '' AND relation_type <> '' AND target <> ''")
    rows = rows.withColumn("direction", F.coalesce(text_at(item, "$.direction"), F.lit("forward"))).withColumn("propagation", F.coalesce(text_at(item, "$.propagation"), F.lit("bidirectional")))
    rows = rows.withColumn("stable_id", X.relation_id(*[F.col(c) for c in ("case_id", "source", "relation_type", "target", "direction", "propagation")]))
    return first_by(rows, ["stable_id"], ["file_ord", "case_ord", "pos"]).select(
        "stable_id", "file_ord", "case_ord", "pos", "case_id", X.term_id("source").alias("source_id"), "source", "relation_type", X.term_id("target").alias("target_id"), "target",
        "direction", "propagation", json_at(item, "$.conditions", "[]").alias("conditions_json"), json_at(item, "$.version_scope", "{}").alias("version_scope_json"),
        item_tier(F.col("knowledge_tier"), text_at(item, "$.evidence.kind")).alias("knowledge_tier"), json_at(item, "$.evidence", "{}").alias("evidence_json"),
    )


def omissions(cases: DataFrame) -> DataFrame:
    """Omissions, given as objects or as bare descriptions."""
    item = F.col("item")
    bare = F.when(kind(item) == "string", F.try_variant_get("item", "$", "string"))
    rows = _each(cases, "$.historical_omissions").withColumn("description", F.coalesce(bare, F.when(kind(item) == "object", text_at(item, "$.description")))).where("description <> ''")
    return rows.select(
        "case_id", "pos", "description", text_at(item, "$.severity").alias("severity"), text_at(item, "$.source").alias("source"),
        item_tier(F.col("knowledge_tier"), text_at(item, "$.evidence.kind")).alias("knowledge_tier"), json_at(item, "$.evidence", "{}").alias("evidence_json"),
    )


def conflicts(cases: DataFrame) -> DataFrame:
    item = F.col("item")
    rows = _each(cases, "$.conflicts").where((kind(item) == "object") & truthy(F.try_variant_get(item, "$.topic", "variant")))
    return rows.select("case_id", "pos", text_at(item, "$.topic").alias("topic"), text_at(item, "$.resolution_status").alias("resolution_status"), F.to_json("item").alias("conflict_json"))


def history_tables(cases: DataFrame) -> dict[str, DataFrame]:
    """The store's tables by name."""
    from tracelake.operators.impact import build_cochange, cochange_cases

    changes = service_changes(cases)
    order = F.struct("file_ord", "case_ord")
    return {
        "documents": first_documents(cases.withColumn("_ord", order), "_ord"),
        "cases": cases.drop("v"),
        "case_terms": case_terms(cases),
        "scenarios": scenarios(cases),
        "service_changes": changes,
        "relations": relations(cases),
        "historical_omissions": omissions(cases),
        "conflicts": conflicts(cases),
        "service_cochange": build_cochange(cochange_cases(changes, cases)),
    }


def quality_counts(cases: DataFrame, scenarios_: DataFrame, changes: DataFrame, conflicts_: DataFrame) -> DataFrame:
    """(metric, value): cases by status and tier, scenarios, services and conflicts of cases that are not rejected, and those to review."""
    cases = cases.select("case_id", "validation_status", "knowledge_tier").distinct()
    by = lambda c, name: cases.groupBy(F.concat(F.lit(f"{name}:"), F.coalesce(c, F.lit("none"))).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    one = lambda df, name, value: df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")
    live = cases.where("knowledge_tier <> 'rejected'").select("case_id")
    kept = lambda df: df.join(live, "case_id", "left_semi")
    parts = [
        by("validation_status", "status"), by("knowledge_tier", "tier"), one(cases, "cases", F.count(F.lit(1))), one(kept(scenarios_), "scenarios", F.count(F.lit(1))),
        one(kept(changes), "services", F.count_distinct(F.trim("service"))), one(kept(conflicts_), "conflicts", F.count(F.lit(1))),
        one(cases.where("knowledge_tier IN ('candidate', 'conflict')"), "review_queue", F.count(F.lit(1))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def review_queue(cases: DataFrame) -> DataFrame:
    """Candidates and conflicts, for people to look at."""
    return cases.where("knowledge_tier IN ('candidate', 'conflict')").select(
        "case_id", "title", "validation_status", "confidence", F.coalesce(F.get_json_object("validation_json", "$.issues"), F.lit("[]")).alias("issues")
    )


# ---- captures of code facts -------------------------------------------------------------


def code_tables(capture: DataFrame) -> dict[str, DataFrame]:
    """Tables of a capture (one row with VARIANT v): metadata, calls, seeds, repositories, entities, relations, mappings."""
    v = F.col("v")

    def each(path: str, *columns: Column) -> DataFrame:
        return capture.select(F.posexplode(items_at(v, path)).alias("ord", "item")).select("ord", *columns)

    item = F.col("item")
    at = lambda path, name: text_at(item, f"$.{path}").alias(name)
    flag = lambda name: F.coalesce(F.when(kind(F.try_variant_get(item, f"$.{name}", "variant")) == "boolean", F.try_variant_get(item, f"$.{name}", "boolean")), F.lit(False)).alias(name)
    meta = F.try_variant_get(v, "$.mcp", "map<string,variant>")
    return {
        "mcp_metadata": capture.select(F.explode(meta).alias("key", "value")).select("key", F.to_json("value").alias("value_json")),
        "mcp_calls": each("$.mcp_calls", at("id", "call_id"), at("repository", "repository"), at("tool", "tool"), json_at(item, "$.arguments", "{}").alias("arguments_json"),
                          at("response_path", "response_path"), at("response_sha256", "response_sha256"), at("observed_at", "observed_at"), at("status", "status"), at("staleness", "staleness")),
        "query_seeds": each("$.query_seeds", at("repository", "repository"), at("category", "category"), at("seed", "seed"), at("status", "status"),
                            json_at(item, "$.mcp_call_ids", "[]").alias("mcp_call_ids_json"), at("notes", "notes")),
        "repositories": each("$.repositories", at("name", "name"), at("path", "path"), at("branch", "branch"), at("commit", "commit_sha"), at("indexed_at", "indexed_at"),
                             json_at(item, "$.coverage", "[]").alias("coverage_json"), json_at(item, "$.not_covered", "[]").alias("not_covered_json")),
        "entities": each("$.entities", at("id", "entity_id"), at("type", "entity_type"), at("name", "name"), at("service", "service"), at("repository", "repository"),
                         json_at(item, "$.location", "{}").alias("location_json"), json_at(item, "$.evidence", "{}").alias("evidence_json")),
        "relations": each("$.relations", at("source_id", "source_id"), at("type", "relation_type"), at("target_id", "target_id"), at("repository", "repository"), flag("source_external"),
                          flag("target_external"), at("source_repository", "source_repository"), at("target_repository", "target_repository"), json_at(item, "$.evidence", "{}").alias("evidence_json")),
        "business_mappings": each("$.business_mappings", at("business_object", "business_object"), at("state", "state"), at("action", "action"), at("asset_id", "asset_id"),
                                  at("confidence", "confidence"), json_at(item, "$.evidence", "{}").alias("evidence_json")),
    }


def snapshot_status(calls: DataFrame) -> DataFrame:
    """(status): stale if a call failed or is stale, else unknown if one is unknown or there is none, else fresh."""
    bad = F.bool_or((F.coalesce("status", F.lit("")) != "ok") | F.coalesce(F.col("staleness") == "stale", F.lit(False)))
    unknown = F.bool_or(F.coalesce("staleness", F.lit("unknown")) == "unknown")
    return calls.agg(F.when(bad, "stale").when(F.coalesce(unknown, F.lit(True)), "unknown").otherwise("fresh").alias("status"))
