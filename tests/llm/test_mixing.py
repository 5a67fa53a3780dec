import os
import random

import pytest

from tests.conftest import got
from tracelake.llm import mixing as M

SIZED = "doc long, source string, tokens long, rate string"
TARGETS = "source string, target_share double, max_repeats int"


def documents(seed=1, n=4000):
    rng = random.Random(seed)
    return [(i, rng.choices(["big", "mid", "small", "unwanted", ""], [60, 30, 4, 5, 1])[0], rng.choice([0, 5, 40, 40, 300]), "clash") for i in range(n)]


def test_shares_and_caps(rows):
    targets = rows([(" Big", 0.3, 1), ("mid", 0.5, 3), ("small", 0.2, 4), ("absent", 0.1, 2), (None, 0.1, 1), ("mid", 0.0, 9)], TARGETS)
    mixed = M.mix(rows(documents(), SIZED), targets).persist()
    assert mixed.count() == 4000
    used = {r.source: r for r in M.shares(mixed, targets.where("source IS NOT NULL")).collect()}
    assert abs(used["big"].actual_share - 0.3) < 0.01 and abs(used["mid"].actual_share - 0.5) < 0.01 and abs(used["small"].actual_share - 0.2) < 0.01
    assert used["absent"].documents == 0 and used["unwanted"].tokens_mixed == 0 and used[""].tokens_mixed == 0
    most = {r.source: r.m for r in mixed.groupBy("source").agg({"copies": "max"}).withColumnRenamed("max(copies)", "m").collect()}
    assert most["big"] <= 1 and most["mid"] <= 3 and most["small"] <= 4
    assert mixed.where("tokens = 0 AND copies > 0").count() == 0
    # the source that runs out first is used to its cap
    assert mixed.where("source = 'small' AND tokens > 0 AND copies <> 4").count() == 0
    assert got(M.mix(rows(documents(), SIZED), targets), "doc", "copies") == got(mixed, "doc", "copies")


def test_the_dual_is_solved(rows):
    histogram = rows([("a", 10, 100), ("a", 200, 50), ("b", 30, 500)], "source string, tokens long, documents long")
    multipliers, caps, total = M.solve(histogram, {"a": (0.5, 3), "b": (0.5, 1)}, total=20_000)
    from math import exp

    rate = lambda s, t: min(caps[s], exp(multipliers[s] * t))
    assert abs(100 * 10 * rate("a", 10) + 50 * 200 * rate("a", 200) - 10_000) < 1e-3
    assert abs(500 * 30 * rate("b", 30) - 10_000) < 1e-3
    assert M.solve(histogram, {"b": (1.0, 2)}, total=1e9)[0] == {"b": float("inf")}
    assert M.solve(histogram, {"zzz": (1.0, 2)}) == ({}, {}, 0.0)


def test_nothing_to_mix(rows):
    targets = rows([("a", 1.0, 1)], TARGETS)
    assert M.mix(rows([], SIZED), targets).count() == 0
    assert got(M.mix(rows([(1, "b", 5, "")], SIZED), targets), "copies") == [(0,)]
    assert got(M.mix(rows([(1, "a", 5, "")], SIZED), targets.limit(0)), "copies") == [(0,)]
    assert M.shares(M.mix(rows([], SIZED), targets), targets).first().actual_share == 0


@pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer file")
def test_tokens(rows):
    data = [("hello world <|endoftext|>",), (None,), ("",), ("word " * 50_000,)]
    counts = [r[0] for r in rows(data, "text string").select(M.token_count("text")).collect()]
    assert counts[0] > 4 and counts[1:3] == [0, 0] and 49_000 < counts[3] < 51_100
