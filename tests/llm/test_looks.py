import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import got
from tracelake.llm import looks as L

ODD = "ａｂＣ\u3000\ufb01\ufb02e\u0301\u00e9 еоасο\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u00a0\u2007\u202fx y z 订单 \u0634\u0301 \u00bd\u00b2 \u2026\u2167\u2f00\u1100\u1161\u11a8각ДжЁ"


@pytest.mark.parametrize(
    "text, form",
    [
        ("ｐｒｅａｕｔｈ　ｌｅａｓｅ", "preauth lease"), ("region­al crate", "regional crate"), ("сpoчный отзыв", "срочный отзыв"), ("póliza dе envío", "póliza de envío"),
        ("oﬀline", "offline"), ("café", "café"), ("grο̈sse", "grösse"), ("api-ключ", "api-ключ"), ("订单order", "订单order"), ("a\tb\nc", "a\tb\nc"), ("½ x² …", "½ x² …"),
        ("e​́", "é"), ("", ""), ("סדר", "סדר"), ("⼀", "一"), ("non‑breaking", "non-breaking"),
    ],
)
def test_forms(text, form):
    assert L.consistent(text) == form


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("ｗａｌｌｅｔ", {"full_width"}), ("cafe\u0301", {"parted_accent"}), ("o\ufb00", {"ligature"}), ("a\u200bb", {"invisible"}), ("a\u00a0b", {"blank"}), ("b\u0430y", {"mixed_script"}),
        ("Gr\u00f6\u00dfe Ёлка 订单", set()), ("sms-код", set()), ("plain  text", set()), ("сор", set()), ("\u2167", {"other_form"}),
    ],
)
def test_kinds(text, kinds):
    assert {k for k, v in zip(L.KINDS, L.kinds(text), strict=True) if v} == kinds


@pytest.fixture
def confusables(spark):
    L.prepare(spark)


@pytest.mark.parametrize(
    "text, form",
    [
        ("ϲase", "case"), ("Ϲase", "Case"), ("λόγοϲ", "λόγος"), ("Ꭺpple", "Apple"), ("ꓐpple", "Bpple"), ("ⲟrder", "order"), ("paɡe", "page"), ("гoрод", "город"), ("ᏣᎳᎩ", "ᏣᎳᎩ"), ("ɡ", "ɡ"), ("订单order", "订单order"), ("µm", "μm"),
        ("Ilık şişe", "Ilık şişe"), ("naïve œuvre þing", "naïve œuvre þing"),
    ],
)
def test_look_alikes_of_every_script(confusables, text, form):
    assert L.consistent(text) == form and L.consistent(form) == form
    assert L.analysed(text)[0] == form


def test_mixed_scripts_are_cases_in_every_script(confusables, rows):
    data = [(i, t) for i, t in enumerate(["Ꭺpple", "ꓐpple", "ⲟrder", "ϲase", "订单order", "paɡe", "ᏣᎳᎩ", "µm", "жz"])]
    found = got(L.unusual_texts(rows(data, "id int, text string"), "id", "text"), "record_id", "form")
    assert found == [(0, "Apple"), (1, "Bpple"), (2, "order"), (3, "case"), (8, "жz")]


def test_cases_come_through_the_splice(confusables, rows, monkeypatch):
    assert [L.analysed(t)[1].index(True) for t in ("ｗ", "e\u0301", "o\ufb00", "a\u200bb", "a\u00a0b")] == [0, 1, 2, 3, 4]
    monkeypatch.setattr(L, "_splice", lambda segment: segment)
    assert not any(any(L.analysed(t)[1]) for t in ("ｗ", "e\u0301", "o\ufb00", "a\u200bb", "a\u00a0b"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ODD, max_size=24) | st.text(max_size=16))
def test_splicing_equals_the_whole_text(text):
    """Normalizing segments with their context gives what normalizing everything gives, and is idempotent."""
    table = L.table()
    assert L.spliced(text) == unicodedata.normalize("NFC", text.translate(table.table))
    once = L.consistent(text)
    assert L.consistent(once) == once and L.analysed(text)[0] == once


def test_column(rows):
    data = [(1, None), (2, ""), (3, "plain"), (4, "ｗｉｄｅ"), (5, "x" * 200_000 + "é"), (4, "ｗｉｄｅ")]
    df = rows(data, "kinds int, text string")
    forms = got(df.select("kinds", L.consistent_form("text").alias("f")))
    assert forms[0] == (1, None) and forms[2] == (3, "plain") and forms[3] == forms[4] == (4, "wide")
    assert len(forms[5][1]) == 200_001
    assert got(L.unusual_texts(df, "kinds", "text"), "record_id", "form")[:2] == [(4, "wide"), (4, "wide")]
    assert L.unusual_texts(rows([], "kinds int, text string"), "kinds", "text").count() == 0
