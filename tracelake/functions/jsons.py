"""Loosely typed JSON, as columns over VARIANT or text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(text: Column | str) -> Column:
    """VARIANT of a JSON text without byte order mark; null where it is no JSON."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_parse_json(F.regexp_replace(text, "^﻿", ""))


def kind(value: Column) -> Column:
    """object, array, string, number, boolean, null (of JSON) or absent."""
    of = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "absent")
        .when(of.startswith("OBJECT"), "object")
        .when(of.startswith("ARRAY"), "array")
        .when(of == "STRING", "string")
        .when(of == "BOOLEAN", "boolean")
        .when(of == "VOID", "null")
        .otherwise("number")
    )


def text_at(value: Column, path: str) -> Column:
    """The string at path; other kinds as their JSON text, absent as null."""
    return F.try_variant_get(value, path, "string")


def items_at(value: Column, path: str) -> Column:
    """array<variant> at path; null, absent and anything that is no list give an empty array."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def one_or_many(value: Column, path: str) -> Column:
    """array<string>: a list, a bare string as a list of one, an empty or absent one as a list of ''."""
    many = F.try_variant_get(value, path, "array<string>")
    one = F.when(kind(F.try_variant_get(value, path, "variant")) == "string", F.array(text_at(value, path)))
    found = F.coalesce(many, one, F.array().cast("array<string>"))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def truthy(value: Column) -> Column:
    """False for absent, null, '', 0, false, [] and {}."""
    text = F.try_variant_get(value, "$", "string")
    return F.when(kind(value).isin("absent", "null"), False).otherwise(~F.coalesce(text.isin("", "0", "0.0", "false", "[]", "{}"), F.lit(False)))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no escapes for letters; null stays null. For byte-wise comparison only."""
    return texts.map(lambda t: json.dumps(json.loads(t), ensure_ascii=False, sort_keys=True), na_action="ignore")
