"""Bounded propagation over history relations and code relations.

Both walk hop by hop; the number of hops is a small parameter. Each hop's frontier and what
was seen so far are cut to the shared folder, so a lost executor costs no earlier hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import match_key
from tracelake.functions.tiers import decayed
from tracelake.operators.matching import first_by, piece_index, similar_keys, weight_of
from tracelake.runtime import cut

#: Least similarity of a relation's endpoint to a frontier term.
ENDPOINT = 0.7
#: Least score of a mapping that seeds the code graph.
SEED = 0.8


def propagate_relations(relations: DataFrame, seeds: DataFrame, max_depth: int = 2, endpoint_key=match_key) -> DataFrame:
    """(spec_id, depth, relation_ord, case_id): relations reached from seed terms, once per depth they are reached at.

    relations: relation_ord (unique), case_id, source, target, propagation, knowledge_tier;
    seeds: spec_id, key. A relation may be entered by its source (propagation forward or
    bidirectional), its target (reverse, bidirectional) or not at all (none); the endpoint
    more similar to the frontier is where it is entered, on a tie the source, and the other
    is reached. Terms seen before are not walked again. Rejected relations, null endpoints
    and other modes of propagation are never entered.
    """
    sides = relations.where("knowledge_tier <> 'rejected' AND source IS NOT NULL AND target IS NOT NULL").select(
        "relation_ord", "case_id", endpoint_key("source").alias("source"), endpoint_key("target").alias("target"), "propagation"
    )
    sides = cut(sides, "graph-relations")
    entries = sides.where("propagation IN ('forward', 'bidirectional')").select("relation_ord", "case_id", F.lit(0).alias("side"), F.col("source").alias("key"), F.col("target").alias("other"))
    entries = entries.unionByName(sides.where("propagation IN ('reverse', 'bidirectional')").select("relation_ord", "case_id", F.lit(1).alias("side"), F.col("target").alias("key"), F.col("source").alias("other")))
    frontier = cut(seeds.where("key <> ''").select("spec_id", "key").distinct(), "graph-frontier")
    seen, hits = frontier, None
    everywhere = F.lit(1).alias("_all")
    # the endpoints' pieces are made once and met at every depth
    index = piece_index(entries.select(everywhere, "key"), ["_all"], ENDPOINT, keep=True) if max_depth > 0 else None
    for depth in range(1, max(0, max_depth) + 1):
        if frontier.isEmpty():
            break
        similar = similar_keys(frontier.select(everywhere, "key"), index, ["_all"], ENDPOINT)
        reached = entries.join(similar, "key").join(frontier.withColumnRenamed("key", "wanted_key"), "wanted_key")
        best = reached.groupBy("spec_id", "relation_ord", "case_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "side", "other")).alias("x"))
        step = cut(best.select("spec_id", F.lit(depth).alias("depth"), "relation_ord", "case_id", F.col("x.other").alias("key")), "graph-hop")
        hits = step if hits is None else hits.unionByName(step)
        frontier = cut(step.select("spec_id", "key").distinct().join(seen, ["spec_id", "key"], "left_anti"), "graph-frontier")
        seen = seen.unionByName(frontier)
    if hits is None:
        hits = entries.select(F.lit("").alias("spec_id"), F.lit(0).alias("depth"), "relation_ord", "case_id", "key").limit(0)
    return hits.drop("key")


def propagated_cases(hits: DataFrame, direct: DataFrame) -> DataFrame:
    """(spec_id, case_id, n_paths) of cases that relations lead to and that do not match themselves."""
    return hits.groupBy("spec_id", "case_id").agg(F.count(F.lit(1)).alias("n_paths")).join(direct, ["spec_id", "case_id"], "left_anti")


def mapping_seeds(mappings: DataFrame, specs: DataFrame, entities: DataFrame, key=match_key) -> DataFrame:
    """(spec_id, entity_id, score, confidence) of declared assets whose mapping matches the spec.

    mappings: mapping_ord, business_object, state, action, asset_id, confidence. The score
    adds the weighted best match of each field that is given. Of several mappings of an
    asset that match, the last counts.
    """
    parts = [("business_objects", "business_object"), ("states", "state"), ("actions", "action")]
    values = None
    for field, column in parts:
        part = mappings.select("mapping_ord", F.lit(field).alias("field"), key(column).alias("key")).where("key <> ''")
        values = part if values is None else values.unionByName(part)
    similar = similar_keys(specs, values, ["field"])
    best = (
        values.join(similar, ["field", "key"])
        .join(specs.select("spec_id", "field", F.col("key").alias("wanted_key")), ["field", "wanted_key"])
        .groupBy("spec_id", "mapping_ord", "field")
        .agg(F.max(F.round("score", 4)).alias("best"))
    )
    scored = best.groupBy("spec_id", "mapping_ord").agg(F.sum(weight_of(F.col("field")) * F.col("best")).alias("score")).where(F.col("score") >= SEED)
    rows = scored.join(mappings, "mapping_ord").join(entities.select(F.col("entity_id").alias("asset_id")), "asset_id", "left_semi")
    last = rows.groupBy("spec_id", "asset_id").agg(F.max(F.struct("mapping_ord", "score", "confidence")).alias("x"))
    return last.select("spec_id", F.col("asset_id").alias("entity_id"), F.round("x.score", 4).alias("score"), F.col("x.confidence").alias("confidence"))


def code_walk(relations: DataFrame, entities: DataFrame, seeds: DataFrame, max_depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(impacts: spec_id, entity_id, depth, score, confidence, source; paths: spec_id, depth, source_id, relation_ord, target_id).

    relations: relation_ord, source_id, target_id; entities: entity_id; seeds: spec_id,
    entity_id, score, confidence. The walk is undirected. Every edge of the frontier is a
    path, edges back and edges to undeclared entities too; only declared entities not
    visited before are impacts and are walked on from, with 0.7 of the score per hop.
    """
    edges = relations.select("relation_ord", F.col("source_id").alias("a"), F.col("target_id").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    edges = edges.unionByName(edges.select("relation_ord", F.col("b").alias("a"), F.col("a").alias("b")))
    known = entities.select("entity_id").distinct()
    seeds = cut(seeds.select("spec_id", "entity_id", F.lit(0).alias("depth"), "score", "confidence", F.lit("offline-code-mapping").alias("source")), "graph-seeds")
    impacts, paths = seeds, None
    frontier = seeds.select("spec_id", "entity_id").distinct()
    for depth in range(1, max(0, max_depth) + 1):
        if frontier.isEmpty():
            break
        step = frontier.select("spec_id", F.col("entity_id").alias("a")).join(edges, "a")
        step = cut(step.select("spec_id", F.lit(depth).alias("depth"), F.col("a").alias("source_id"), "relation_ord", F.col("b").alias("target_id")), "graph-paths")
        paths = step if paths is None else paths.unionByName(step)
        fresh = step.select("spec_id", F.col("target_id").alias("entity_id")).distinct().join(known, "entity_id", "left_semi")
        fresh = cut(fresh.join(impacts.select("spec_id", "entity_id"), ["spec_id", "entity_id"], "left_anti"), "graph-fresh")
        found = fresh.select(
            "spec_id", "entity_id", F.lit(depth).alias("depth"), decayed(F.lit(depth)).alias("score"), F.lit("medium").alias("confidence"),
            F.lit("offline-code-propagation").alias("source"),
        )
        impacts, frontier = impacts.unionByName(found), fresh.select("spec_id", "entity_id")
    if paths is None:
        paths = relations.select(F.lit("").alias("spec_id"), F.lit(0).alias("depth"), "source_id", "relation_ord", "target_id").limit(0)
    return impacts, paths


def first_reached_by(paths: DataFrame, impacts: DataFrame) -> DataFrame:
    """(spec_id, entity_id, relation_ord, source_id): the edge that reached each impact first, by source and then edge order."""
    hops = paths.withColumnRenamed("target_id", "entity_id").join(impacts.where("depth > 0").select("spec_id", "entity_id", "depth"), ["spec_id", "entity_id", "depth"])
    return first_by(hops, ["spec_id", "entity_id"], ["source_id", "relation_ord"]).select("spec_id", "entity_id", "relation_ord", "source_id")


def code_services(impacts: DataFrame, entities: DataFrame, key=match_key) -> DataFrame:
    """(spec_id, service_key, service, n_types, n_entities): impacted entities by service, shown as the first entity's; those without one are left out."""
    rows = impacts.select("spec_id", "entity_id").join(entities.select("entity_id", "service", "entity_type"), "entity_id")
    rows = rows.withColumn("service_key", key("service")).where("service_key <> ''")
    return rows.groupBy("spec_id", "service_key").agg(
        F.min(F.struct(F.lower("entity_id").alias("o"), "service")).getField("service").alias("service"),
        F.count_distinct("entity_type").alias("n_types"), F.count_distinct("entity_id").alias("n_entities"),
    )
