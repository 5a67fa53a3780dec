import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import got
from tracelake.functions import jsons as J
from tracelake.functions import text as X
from tracelake.functions import tiers as S


def one(rows, value, column, type_="string"):
    return rows([(value,)], f"x {type_}").select(column).first()[0]


@pytest.mark.parametrize(
    "text, stored, matched",
    [
        (" Customer  Order ", "customer order", "customer order"), ("Straße", "strasse", "strasse"), ("ｗａｌｌｅｔ　Ａ", "ｗａｌｌｅｔ ａ", "wallet a"),
        ("a b", "a b", "a b"), ("", "", ""), (None, None, None), ("ﬁle", "file", "file"),
    ],
)
def test_keys(rows, text, stored, matched):
    assert one(rows, text, X.stored_key("x")) == stored
    assert one(rows, text, X.match_key("x")) == matched


@pytest.mark.parametrize(
    "key, tokens",
    [
        ("order freeze 2", ["2", "freeze", "order"]), ("订单状态", ["单状", "状态", "订单", "订单状态"]), ("订", ["订"]), ("prüfung x", ["fung", "pr", "x"]),
        ("", []), ("сумма", []), ("api订单", ["api", "订单"]), ("a a", ["a"]),
    ],
)
def test_tokens(rows, key, tokens):
    assert sorted(one(rows, key, X.lexical_tokens("x"))) == tokens


@pytest.mark.parametrize(
    "a, b, score, kind",
    [
        ("order", "order", 1.0, "exact"), ("order", "order status", 0.9, "contains"), ("订单", "订单状态", 0.9, "contains"), ("a", "ab", 0.0, "none"), ("", "", 0.0, "none"),
        ("freeze order", "order refund", 0.375, "lexical"), ("支付许可", "订单许可", 0.1875, "lexical"), ("x", None, 0.0, "none"), ("сумма", "сумм", 0.9, "contains"),
    ],
)
def test_similarity(rows, a, b, score, kind):
    df = rows([(a, b), (b, a)], "a string, b string").select(X.similarity(F.col("a"), F.col("b"), X.lexical_tokens("a"), X.lexical_tokens("b")).alias("s"))
    assert {(round(r.s.score, 6), r.s.match_type) for r in df.collect()} == {(score, kind)}


@pytest.mark.parametrize(
    "path, version, extension, score",
    [
        ("/docs/order-freeze-v1.2.MD", "v1.2", ".md", 4), ("/x/plan 版本三.txt", "版本三", ".txt", 0), ("/x/a_2024-05.html", "2024-05", ".html", 0), ("/my-designs/a.pdf", None, ".pdf", 1),
        ("/x/v2", "v2", "", 0), ("/x/.env", None, "", 0),
    ],
)
def test_paths(rows, path, version, extension, score):
    assert one(rows, path, X.possible_version("x")) == version
    assert one(rows, path, X.extension("x")) == extension
    assert one(rows, path, X.design_score("x")) == score


def test_ids(rows):
    a = rows([("c1", " Order", "owns", "Payment"), ("c1", "order", "OWNS", "payment ")], "c string, s string, k string, t string")
    none = F.lit(None).cast("string")
    ids = [r[0] for r in a.select(X.relation_id(F.col("c"), F.col("s"), F.col("k"), F.col("t"), none, none)).collect()]
    assert ids[0] == ids[1] and ids[0].startswith("history-relation:") and len(ids[0]) == 17 + 24
    assert one(rows, "Order", X.term_id("x")) == one(rows, " order", X.term_id("x"))


def test_path_key_and_digest_shape(rows):
    assert one(rows, "D:\\Docs//A.md/", X.path_key("x")) == "d:/docs/a.md"
    assert [one(rows, v, X.is_digest("x")) for v in ("a" * 64, "g" * 64, None, "a" * 63)] == [True, False, False, False]


def test_tiers(rows):
    df = rows([("validated",), ("partial",), ("conflict",), ("rejected",), ("odd",), (None,)], "s string")
    assert [r[0] for r in df.select(S.tier_of_status(F.col("s"))).collect()] == ["trusted", "candidate", "conflict", "rejected", "candidate", "candidate"]
    groups = rows([(1, "candidate"), (1, "trusted"), (2, "trusted"), (2, "conflict"), (3, "rejected"), (4, None)], "g int, t string")
    assert got(groups.groupBy("g").agg(S.prevailing_tier(F.col("t")))) == [(1, "trusted"), (2, "conflict"), (3, "rejected"), (4, "rejected")]
    assert one(rows, "trusted", S.item_tier(F.col("x"), F.lit("inferred"))) == "candidate"
    assert one(rows, "trusted", S.item_tier(F.col("x"), F.lit(None))) == "trusted"


@pytest.mark.parametrize("tp, fp, fn, p, r, f1", [(0, 0, 0, 1, 1, 1), (0, 0, 2, 0, 0, 0), (0, 2, 0, 0, 1, 0), (2, 1, 1, 0.6667, 0.6667, 0.6667), (3, 0, 0, 1, 1, 1)])
def test_metrics(rows, tp, fp, fn, p, r, f1):
    df = rows([(tp, fp, fn)], "tp long, fp long, fn long").select(*S.metrics(F.col("tp"), F.col("fp"), F.col("fn")))
    assert tuple(df.first()) == (p, r, f1)


def test_exact_rounding(rows):
    df = rows([(2.00005,), (0.00015,), (None,)], "x double").select(S.exact_round4("x"))
    assert [r[0] for r in df.collect()] == [round(2.00005, 4), round(0.00015, 4), None]


def test_json(rows):
    text = json.dumps({"a": "x", "list": ["p", "q"], "bare": "one", "none": None, "zero": 0, "no": False, "empty": {}, "obj": {"k": 1}})
    v = J.parsed("x")
    at = lambda p: F.try_variant_get(v, p, "variant")
    assert [one(rows, text, J.kind(at(f"$.{k}"))) for k in ("a", "list", "none", "zero", "no", "obj", "absent")] == ["string", "array", "null", "number", "boolean", "object", "absent"]
    assert [one(rows, text, J.truthy(at(f"$.{k}"))) for k in ("a", "list", "none", "zero", "no", "empty", "obj", "absent")] == [True, True, False, False, False, False, True, False]
    assert [one(rows, text, J.one_or_many(v, f"$.{k}")) for k in ("list", "bare", "absent", "none")] == [["p", "q"], ["one"], [""], [""]]
    assert one(rows, "﻿" + text, J.text_at(v, "$.a")) == "x"
    assert one(rows, "{broken", v) is None
    assert one(rows, '{"b": "é", "a": 1}', J.canonical_json("x")) == '{"a": 1, "b": "é"}'
