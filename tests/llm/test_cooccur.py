import math
import random
from collections import Counter
from itertools import combinations

import pytest

from tests.conftest import got
from tracelake.llm import cooccur as C


def data(seed=3):
    rng = random.Random(seed)
    out = [(f"b{rng.randrange(80)}", rng.choice(["A ", "a", "B", "c", "D", "e", None, " "]), "x") for _ in range(900)]
    return out + [(f"b{i}", "hot", "") for i in range(80)] + [(None, "a", "")]


def brute(rows):
    baskets = {}
    for b, i, _ in rows:
        if b is not None and i is not None and i.strip():
            baskets.setdefault(b, set()).add(i.strip().lower())
    single, pairs = Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        pairs.update(combinations(sorted(items), 2))
    return len(baskets), single, pairs


def llr(c, a, b, n):
    out = 0.0
    for k, row, col in ((c, a, b), (a - c, a, n - b), (b - c, n - a, b), (n - a - b + c, n - a, n - b)):
        if k > 0:
            out += 2 * k * math.log(k * n / (row * col))
    return out


def test_stripes_against_brute_force(rows):
    n, single, pairs = brute(data())
    baskets = C.baskets(rows(data(), "basket string, item string, n string"), "basket", "item")
    entries = C.entries_of(C.merged_stripes(C.basket_stripes(baskets)))
    assert {(r.item_a, r.item_b): r.c for r in entries.collect()} == dict(pairs)
    for r in C.significance(entries, baskets).collect():
        a, b, c = single[r.item_a], single[r.item_b], pairs[r.item_a, r.item_b]
        assert (r.c, r.n_a, r.n_b, r.n) == (c, a, b, n)
        assert math.isclose(r.lift, c * n / (a * b)) and math.isclose(abs(r.llr), llr(c, a, b, n), abs_tol=1e-6)
        assert (r.llr < 0) == (r.lift < 1) or abs(r.llr) < 1e-6


def test_stripes_are_passed_on_in_parts(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(C, "HELD_ENTRIES", 5)
    batches = [pd.DataFrame({"left_items": [list("abcd")] * 50, "right_items": [None] * 50})]
    parts = list(C._stripe_batches(iter(batches)))
    assert len(parts) > 1
    total = Counter()
    for part in parts:
        for item, near, counts in part.itertuples(index=False):
            for b, c in zip(near, counts, strict=True):
                total[item, b] += c
    assert total == {p: 50 for p in combinations("abcd", 2)}


def test_partial_counts(rows):
    schema = "batch_no int, item_a string, item_b string, n long, ids array<string>, extra string"
    lines = [
        (1, "A", "b ", 2, ["x", "y"], ""), (1, "b", "a", 2, ["x", "y"], ""), (2, "a", "b", None, ["z", "z", "q"], ""), (3, "a", "b", None, None, ""), (3, "a", "a", 5, [], ""), (1, None, "b", 1, [], ""), (1, "", "b", 1, [], ""),
    ]
    stripes = C.partial_count_stripes(rows(lines, schema))
    assert got(C.merged_stripes(stripes)) == [("a", 0, ["b"], [4])]
    assert got(C.entries_of(C.merged_stripes(stripes))) == [("a", "b", 4)]


@pytest.mark.parametrize("block, entries", [(2, 3), (1, 1), (1000, 50_000)])
def test_long_baskets_and_long_stripes_are_split(rows, block, entries):
    n, single, pairs = brute(data())
    baskets = C.baskets(rows(data(), "basket string, item string, n string"), "basket", "item")
    merged = C.merged_stripes(C.basket_stripes(baskets, block), entries)
    assert {(r.item_a, r.item_b): r.c for r in C.entries_of(merged).collect()} == dict(pairs)
    parts = got(merged, "item", "part")
    assert len(parts) == len(set(parts))
    if entries < 50_000:
        assert len(parts) > len({item for item, _ in parts})


def test_merging_decides(rows, monkeypatch):
    """Without the merge of arrays by key the counts stay in parts."""
    lines = [(b, "a", "b", 3, [], "") for b in range(40)]
    stripes = C.partial_count_stripes(rows(lines, "batch_no int, item_a string, item_b string, n long, ids array<string>, extra string").repartition(4))
    assert got(C.entries_of(C.merged_stripes(stripes))) == [("a", "b", 120)]
    monkeypatch.setattr(C, "_merge", lambda batches: iter(()))
    assert got(C.entries_of(C.merged_stripes(stripes))) == []


def test_significance_of_strong_pairs():
    """Five cases and a lift of 3.7 are significant whatever the sizes."""
    for n in (50, 1000, 10**6):
        for a in range(5, n, max(1, n // 40)):
            b = int(5 * n / (a * 3.7))
            if 5 <= b and a + b - 5 <= n:
                assert llr(5, a, b, n) > C.SIGNIFICANT


def test_no_rows(rows):
    baskets = C.baskets(rows([], "basket string, item string"), "basket", "item")
    assert got(C.significance(C.entries_of(C.merged_stripes(C.basket_stripes(baskets))), baskets)) == []
