import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import got
from tracelake.functions.text import lexical_tokens, similarity
from tracelake.operators import graph, matching


def keys(seed, n):
    rng = random.Random(seed)
    words = ["order", "orders", "freeze", "pay", "订单", "订单状态", "状态", "я", "x", "сумма", "refund order", "a", "支付"]
    return sorted({" ".join(rng.choices(words, k=rng.randrange(1, 6))) for _ in range(n)})


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_blocked_join_finds_what_all_pairs_have(rows, threshold):
    wanted, actual = rows([("f", k) for k in keys(1, 60)], "field string, key string"), rows([("f", k) for k in keys(2, 120)] + [("g", "order")], "field string, key string")
    all_pairs = wanted.select("field", F.col("key").alias("wanted_key")).join(actual, "field")
    s = similarity(F.col("wanted_key"), F.col("key"), lexical_tokens("wanted_key"), lexical_tokens("key"))
    expected = got(all_pairs.withColumn("s", s).where(F.col("s.score") >= threshold), "wanted_key", "key")
    assert expected
    for most in (0, 1000):
        assert got(matching.similar_keys(wanted, actual, ["field"], threshold, most), "wanted_key", "key") == expected


def test_aliases():
    closed = matching.close_aliases([("a", "b"), ("b", "c"), ("p", "q"), ("q", "p"), ("x", "p"), ("s", "s")])
    assert closed == {"a": "c", "b": "c", "p": "p", "q": "q", "x": "p", "s": "s"}


def test_specs_and_ties(rows, spark):
    aliases = matching.alias_keys(rows([("Purchase", "Order")], "alias string, canonical string"))
    specs = matching.spec_terms(spark, {"s": {"business_objects": ["Order", " purchase ", 3, "", None, "Refund"]}}, aliases)
    assert got(specs, "key", "display", "pos") == [("order", "Order", 0), ("refund", "Refund", 5)]
    terms = rows(
        [("c1", "business_object", "refund x", 5), ("c1", "business_object", "refund y", 4), ("c1", "business_object", "Purchase", 9), ("c2", "state", "order", 1), (None, "business_object", "order", 1), ("c3", "odd", "order", 1)],
        "case_id string, term_type string, term string, pos int",
    )
    stored = matching.case_keys(terms, matching.canonical(F.lower("term"), aliases), "pos")
    found = got(matching.term_matches(specs, stored), "case_id", "wanted", "actual", "score", "match_type")
    # of two equally good terms the first of the case counts
    assert found == [("c1", "Order", "Purchase", 1.0, "exact"), ("c1", "Refund", "refund y", 0.9, "contains")]
    scores = matching.case_scores(matching.field_scores(matching.term_matches(specs, stored)))
    assert got(scores) == [("s", "c1", 2.0)]
    cases = rows([("c1", "rejected")], "case_id string, knowledge_tier string")
    assert matching.direct_matches(scores, cases).count() == 0
    assert matching.spec_issues({"s": {"business_objects": ["x"]}}) == [("s", f"{f} is empty") for f in ("before_behaviors", "after_behaviors", "change_types")]


RELATIONS = "relation_ord int, case_id string, source string, target string, propagation string, knowledge_tier string"


def test_propagation(rows):
    relations = rows(
        [(1, "c1", "order", "payment", "forward", "trusted"), (2, "c2", "shipping", "payment", "reverse", "trusted"), (3, "c3", "order", "x", "none", "trusted"), (4, "c4", "order", "y", "forward", "rejected"),
         (5, "c5", "shipping", "dock", "bidirectional", "trusted"), (6, "c6", "payment", "order", "forward", "candidate"), (7, "c7", None, "order", "reverse", "trusted")],
        RELATIONS,
    )
    seeds = rows([("s", "order"), ("s", "")], "spec_id string, key string")
    hits = graph.propagate_relations(relations, seeds, 3)
    assert got(hits, "depth", "case_id") == [(1, "c1"), (2, "c2"), (2, "c6"), (3, "c5")]
    assert got(graph.propagate_relations(relations, seeds, 1), "case_id") == [("c1",)]
    assert graph.propagate_relations(relations, seeds, 0).count() == 0
    direct = rows([("s", "c2")], "spec_id string, case_id string")
    assert got(graph.propagated_cases(hits, direct), "case_id", "n_paths") == [("c1", 1), ("c5", 1), ("c6", 1)]


def test_code_walk(rows):
    edges = rows([(1, "a", "b"), (2, "b", "c"), (3, "a", "out"), (4, "z", "a"), (5, "b", None)], "relation_ord int, source_id string, target_id string")
    entities = rows([(e,) for e in "abcz"], "entity_id string")
    seeds = rows([("s", "a", 2.0, "high")], "spec_id string, entity_id string, score double, confidence string")
    impacts, paths = graph.code_walk(edges, entities, seeds, 2)
    assert got(impacts, "entity_id", "depth", "score") == [("a", 0, 2.0), ("b", 1, 0.7), ("c", 2, 0.49), ("z", 1, 0.7)]
    assert got(paths, "depth", "source_id", "target_id") == [(1, "a", "b"), (1, "a", "out"), (1, "a", "z"), (2, "b", "a"), (2, "b", "c"), (2, "z", "a")]
    assert got(graph.first_reached_by(paths, impacts), "entity_id", "relation_ord") == [("b", 1), ("c", 2), ("z", 4)]
    assert graph.code_walk(edges, entities, seeds, 0)[1].count() == 0
    assert graph.code_walk(edges, entities, seeds.limit(0), 2)[0].count() == 0


def test_mapping_seeds(rows, spark):
    specs = matching.spec_terms(spark, {"s": {"business_objects": ["order"], "actions": ["freeze"]}})
    mappings = rows(
        [(1, "order", None, None, "a", "low"), (2, "order", None, "freeze", "a", "high"), (3, None, "x", None, "b", "low"), (4, "order", None, None, "lost", "low"), (5, None, None, "order", "a", "mid")],
        "mapping_ord int, business_object string, state string, action string, asset_id string, confidence string",
    )
    seeds = graph.mapping_seeds(mappings, specs, rows([("a",), ("b",)], "entity_id string"))
    assert got(seeds) == [("s", "a", 3.5, "high")]
