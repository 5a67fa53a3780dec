import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import got
from tracelake.llm import canonical as K

NAMES = ["customer order", "warehouse withdrawal", "splitting limit per envelope", "póliza de envío", "grösse ändern", "超时自动解冻", "срочный отзыв", "no parcel notification twice", "withdrawal window"]
MATCHER = K.Matcher(list(enumerate(NAMES)), [(0, "client purchase")])


@pytest.mark.parametrize(
    "value, name",
    [
        ("customer order", 0), ("  CUSTOMER   Order", 0), ("customer-order", 0), ("CustomerOrder", 0), ("order, customer", 0), ("custoemr order", 0), ("cutomer odrer", 0), ("customer orders", 0),
        ("ｃｕｓｔｏｍｅｒ оrder", 0), ("client purchase", 0), ("whse. withdrawal", 1), ("withdrawal whse", 1), ("warehousewithdrawal", 1), ("warehousewithdrawl", 1), ("splitting limit per envelopes", 2),
        ("poliza de envio", 3), ("größe ändern", 4), ("GRÖSSE ÄNDERN", 4), ("超时自·动解冻", 5), ("сpoчный отзыв", 6), ("no parcle notification twice", 7),
        ("customer", None), ("customer order new", None), ("order order", None), ("warehouse window", None), ("splitting limit envelope", None), ("splitting limit for envelope", None),
        ("", None), ("   ", None), ("...", None), ("订单", None), ("customer orderly conduct", None),
    ],
)
def test_values(value, name):
    found = MATCHER.match(value)
    assert (found[0] if found else None) == name


UMLAUTS = K.Matcher([(1, "Lieferschein Prüfstück"), (2, "überfällige Rückläufer"), (3, "ueberpruefte maengel"), (4, "grösse")])


@pytest.mark.parametrize(
    "value, ref",
    [
        ("lieferschein pruefstueck", 1), ("Pruefstueck-Lieferschein", 1), ("lieferscheinpruefstueck", 1), ("lieferscheinpruefsteuck", 1), ("lieferschein pruefsteuck", 1), ("lieferschein pruefstuecks", 1),
        ("lieferschein prüfstueck", 1), ("lieferschein pru\u0308fstu\u0308ck", 1), ("ueberfaellige ruecklaeufer", 2), ("überprüfte mängel", 3), ("uberfallige rucklaufer", 2), ("groesse", 4),
        ("lieferschein", None), ("pruefstueck", None), ("lieferschein pruefstuecke neu", None), ("lieferschein prooofstuck", None),
    ],
)
def test_umlauts_written_out(value, ref):
    found = UMLAUTS.match(value)
    assert (found[0] if found else None) == ref


def test_mentions_are_the_longest_that_do_not_overlap():
    run = "xcustomerorderwithdrawals"
    found = MATCHER.mentions(MATCHER.found(run), len(run))
    assert [(m[2], m[3]) for m in found] == [(None, 0), ("withdrawal", None)]
    assert found[1][1] - found[1][0] == len("withdrawals")


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=500, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_slip(a, b):
    assert K.one_slip(a, b) == (osa(a, b) <= 1)
    if K.one_slip(a, b):
        # the look-up by left-out letters finds every slip
        assert ({a} | K.shorter(a)) & ({b} | K.shorter(b))


def test_rows(rows, spark):
    reference = rows([(1, "customer order"), (2, "Customer Order"), (3, None), (None, "x"), (4, "refund")], "ref_id long, name string")
    data = [("customer order", "keep", 7)] * 50 + [(None, "n", 8), ("", "e", 9), ("refunds", "p", 10), ("x" * 100_000, "long", 11)]
    out = K.map_values(rows(data, "term string, how string, extra int"), "term", reference)
    assert out.columns == ["term", "extra", "ref_id", "similarity", "how"]
    assert got(out.where("ref_id IS NOT NULL").groupBy("ref_id").count()) == [(1, 50), (4, 1)]
    assert out.where("ref_id IS NULL").count() == 3
    assert K.map_values(rows([], "term string"), "term", reference).count() == 0
    assert got(K.map_values(rows([("a",)], "term string"), "term", reference.limit(0)), "ref_id") == [(None,)]


def test_a_long_list_is_matched_in_blocks(rows, monkeypatch):
    reference = rows(list(enumerate(NAMES)), "ref_id long, name string")
    values = ["customer orders", "CustomerOrder", "whse. withdrawal", "order, customer", "withdrawal window", "срочный отзыв", "nothing", None, "no parcle notification twice", "limit splitting envelope per"]
    data = rows([(i, v) for i, v in enumerate(values)], "id int, term string")
    at_once = got(K.map_values(data, "term", reference), "id", "ref_id")
    assert sum(r[1] is not None for r in at_once) == 8
    monkeypatch.setattr(K, "MAX_ENTRIES", 2)
    assert got(K.map_values(data, "term", reference), "id", "ref_id") == at_once


def test_the_automaton_decides(monkeypatch):
    """Names and words are found by the automaton only: without its mentions they are lost, but for values a slip away."""
    found = {v: MATCHER.match(v) for v in ("customer order", "order, customer", "customer orders", "CustomerOrder", "cutomer order", "超时自·动解冻")}
    assert {v: f[2] for v, f in found.items()} == {"customer order": "name", "order, customer": "words", "customer orders": "similar", "CustomerOrder": "name", "cutomer order": "similar", "超时自·动解冻": "name"}
    monkeypatch.setattr(MATCHER, "found", lambda run: [])
    assert MATCHER.match("order, customer") is None and MATCHER.match("order customers") is None and MATCHER.match("order cutomer") is None


def test_one_word_names_are_names_and_words():
    matcher = K.Matcher([(1, "refund"), (2, "refund order"), (3, "order")])
    assert matcher.match("refund") == (1, 1.0, "name") and matcher.match("order refund") == (2, 0.99, "words") and matcher.match("refunds order")[0] == 2


def test_many_ambiguous_words_take_no_time():
    vocabulary = [a + b + c for a in ("pre", "pro", "pra", "pri") for b in ("cess", "duct", "gram", "ject", "test") for c in ("or", "er", "al", "ing")]
    names = [(i, " ".join(random.Random(i).sample(vocabulary, 20))) for i in range(300)]
    matcher = K.Matcher(names)
    value = " ".join(w[:2] + w[3:6] for w in names[7][1].split())
    matcher.match(value)
    began = time.perf_counter()
    assert matcher.match(value) is None or matcher.match(value)[2] == "similar"
    assert time.perf_counter() - began < 0.5


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.sampled_from([0.0, 0.5, 0.75, 0.9, 1.0]), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_best_pairing(gains):
    sums = [sum(gains[r][c] for r, c in enumerate(p)) for p in itertools.permutations(range(len(gains))) if all(gains[r][c] > 0 for r, c in enumerate(p))]
    found = K.best_pairing(gains)
    assert (found is None) == (not sums) and (not sums or abs(found - max(sums)) < 1e-9)
