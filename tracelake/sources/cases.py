"""Loaders of case files, alias lists, specs, captures and datasets: loosely typed JSON, kept as text beside VARIANT."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.jsons import kind, parsed


def load_cases(spark: SparkSession, folder: str, mode: str = "strict") -> tuple[DataFrame, DataFrame]:
    """(cases, errors) of the .json and .jsonl files below folder.

    cases: origin, file_ord, case_ord, raw, v (VARIANT), kind. A .json file is one case or
    a list of them, a .jsonl file one per line; a byte order mark and blank lines do not
    count. mode strict: anything that is no object is an error of its file, which then
    gives no cases; tolerant: it is skipped; all: it is kept, to be found invalid. Text
    that is no JSON is an error in each mode. An empty or missing folder gives no rows.
    """
    schema = "origin string, body string, is_lines boolean"
    parts = []
    for suffix, whole in ((".json", True), (".jsonl", False)):
        if _any_file(folder, suffix):
            text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
            parts.append(text.select(F.col("_metadata.file_path").alias("origin"), F.col("value").alias("body"), F.lit(not whole).alias("is_lines")))
    files = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        files = files.unionByName(part)
    files = files.withColumn("body", F.regexp_replace("body", "^﻿", ""))
    lines = F.filter(F.split("body", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    single = parsed("body")
    listed = F.try_variant_get(single, "$", "array<variant>")
    pieces = F.when(F.col("is_lines"), lines).when(
        kind(single) == "array", F.transform(listed, lambda x: F.to_json(x))
    ).otherwise(F.array("body"))
    rows = files.select("origin", F.posexplode(pieces).alias("case_ord", "raw")).withColumn("v", parsed("raw"))
    rows = rows.withColumn("kind", F.when(F.col("v").isNull(), "broken").otherwise(kind(F.col("v"))))
    bad = "broken" if mode != "strict" else None
    wrong = (F.col("kind") == bad) if bad else (F.col("kind") != "object")
    errors = rows.where(wrong).select("origin", F.concat(F.lit("item "), F.col("case_ord") + 1, F.lit(" is "), F.when(F.col("kind") == "broken", "no JSON").otherwise("no object")).alias("message"))
    good = rows.join(errors.select("origin").distinct(), "origin", "left_anti") if mode == "strict" else rows.where(F.col("kind") != "broken")
    if mode == "tolerant":
        good = good.where("kind = 'object'")
    order = good.select("origin").distinct().withColumn("file_ord", F.dense_rank().over(_by_folded_origin()))
    return good.join(order, "origin").select("origin", "file_ord", "case_ord", "raw", "v", "kind"), errors


def _by_folded_origin():
    from pyspark.sql import Window

    # one row per file, as many as a folder lists
    return Window.orderBy(F.lower("origin"), "origin")


def _any_file(folder: str, suffix: str) -> bool:
    folder = folder.removeprefix("file://")
    return any(f.endswith(suffix) for _, _, files in os.walk(folder) for f in files)


def load_object(path: str) -> dict:
    """The JSON object of a file; anything else is an error."""
    with open(path, encoding="utf-8-sig") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def load_aliases(spark: SparkSession, path: str | None) -> DataFrame:
    """(alias, canonical) of an alias file, as they are written; entries that are no strings are an error. No path: no rows."""
    pairs = list(load_object(path).items()) if path else []
    if any(not isinstance(v, str) for _, v in pairs):
        raise ValueError(f"{path}: an alias is no text")
    return spark.createDataFrame(pairs, "alias string, canonical string")


def load_revisions(spark: SparkSession, path: str) -> DataFrame:
    """(name, branch, commit_sha, dirty) of repositories as they are now, from a JSON list that a probe outside has written."""
    return spark.read.schema("name string, branch string, commit_sha string, dirty boolean").json(path, multiLine=True)


def load_capture(path: str) -> dict:
    return load_object(path)


def load_replay(path: str) -> dict:
    """A replay dataset: an object with a list of cases that are objects with ids and is not empty."""
    value = load_object(path)
    cases = value.get("cases")
    if not isinstance(cases, list) or not cases:
        raise ValueError("a replay dataset needs cases")
    if not all(isinstance(c, dict) and isinstance(c.get("id"), str) and c["id"].strip() for c in cases):
        raise ValueError("a replay case is no object with an id")
    return value


def raw_responses(spark: SparkSession, capture_dir: str) -> DataFrame:
    """(response_path, actual_sha256) of the files below a capture's folder, relative to it."""
    root = os.path.realpath(capture_dir)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{root}")
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.substring(path, F.lit(len(root) + 2), F.length(path)).alias("response_path"), F.sha2("content", 256).alias("actual_sha256"))


def response_problems(calls: DataFrame, responses: DataFrame) -> DataFrame:
    """calls (call_id, response_path, response_sha256) whose raw response is outside, missing or another: call_id, message."""
    clean = F.regexp_replace(F.regexp_replace("response_path", r"\\", "/"), r"^(\./)+", "")
    depth = F.aggregate(
        F.split(clean, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(acc["low"], acc["at"] + F.when(p == "..", -1).otherwise(0)).alias("low"),
        ),
    )
    outside = clean.startswith("/") | (depth["low"] < 0)
    x = calls.withColumn("_path", clean).join(responses.withColumnRenamed("response_path", "_path"), "_path", "left")
    message = (
        F.when(outside, "response_path leads out of the capture's folder")
        .when(F.col("actual_sha256").isNull(), "there is no file at response_path")
        .when(F.lower("response_sha256") != F.col("actual_sha256"), "the raw response has another digest")
    )
    return x.select("call_id", message.alias("message")).where("message IS NOT NULL")
