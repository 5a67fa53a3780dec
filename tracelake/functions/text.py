"""Keys, tokens and similarity of terms, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks of any kind, as Python's str.split takes them.
BLANKS = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
# Ideographs that are tokenized by pairs.
IDEOGRAPHS = "㐀-鿿"
# Version marks in file names (v, version and their Chinese words before numerals; year-month dates).
VERSION_PATTERN = (
    r"(?i)(?:^|[\s._-])((?:v|version|版本|版)[\s._-]*(?:\d+(?:[._-]\d+)*|[一二三四五六七八九十]+)"
    r"|20\d{2}[._-]\d{1,2}(?:[._-]\d{1,2})?)"
)
# Words in a path that hint at design documents.
DESIGN_WORDS = (
    "design", "designs", "docs", "architecture", "architectures", "adr", "rfc", "spec", "specs",
    "设计", "方案", "架构", "改造", "需求", "技术文档",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(col: Column) -> Column:
    """Blanks at the ends dropped, others one space."""
    return F.trim(F.regexp_replace(col, BLANKS, " "))


def stored_key(col: Column | str) -> Column:
    """The key a store keeps: letter case and blanks do not count, compatibility forms do.

    Upper then lower case folds nearly as case folding does (ss for sharp s); null stays null.
    Blanks are collapsed in between, else the optimizer takes the upper case away.
    """
    return F.lower(collapse(F.upper(_col(col))))


@F.pandas_udf(T.StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", t).strip().casefold().split())
    return texts.map(fold, na_action="ignore")


def match_key(col: Column | str) -> Column:
    """The key terms are matched by: as stored_key, after compatibility composition.

    Only texts outside ASCII leave the JVM. Apply it to distinct terms.
    """
    col = _col(col)
    plain = col.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, collapse(F.lower(col))).otherwise(_compatible(F.when(~plain, col)))


def lexical_tokens(key: Column | str) -> Column:
    """array<string>: distinct runs of a-z and 0-9, runs of ideographs and all their pairs; other letters separate."""
    runs = F.regexp_extract_all(_col(key), F.lit(f"[a-z0-9]+|[{IDEOGRAPHS}]+"), F.lit(0))
    pairs = lambda run: F.when(
        run.rlike(f"^[{IDEOGRAPHS}]{{2,}}$"),
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs, F.flatten(F.transform(runs, pairs))))


def similarity(left: Column, right: Column, left_tokens: Column, right_tokens: Column) -> Column:
    """struct<score, match_type> of two keys with their tokens: exact, contains, lexical or none."""
    common = F.size(F.array_intersect(left_tokens, right_tokens))
    either = F.size(F.array_union(left_tokens, right_tokens))
    lexical = F.greatest(0.75 * common / F.least(F.size(left_tokens), F.size(right_tokens)), common / either)
    inside = (F.least(F.length(left), F.length(right)) >= 2) & (F.contains(left, right) | F.contains(right, left))
    empty = left.isNull() | right.isNull() | (left == "") | (right == "")
    pair = lambda score, kind: F.struct(score.cast("double").alias("score"), F.lit(kind).alias("match_type"))
    return (
        F.when(empty, pair(F.lit(0.0), "none"))
        .when(left == right, pair(F.lit(1.0), "exact"))
        .when(inside, pair(F.lit(0.9), "contains"))
        .when(common > 0, pair(lexical, "lexical"))
        .otherwise(pair(F.lit(0.0), "none"))
    )


def term_id(term: Column | str) -> Column:
    """A stable id of a business term."""
    return F.concat(F.lit("business-term:"), F.substring(F.sha2(stored_key(term), 256), 1, 20))


def relation_id(case_id: Column, source: Column, kind: Column, target: Column, direction: Column, propagation: Column) -> Column:
    """A stable id of a relation; an absent direction is forward, an absent propagation bidirectional."""
    parts = [case_id, stored_key(source), stored_key(kind), stored_key(target), F.coalesce(direction, F.lit("forward")), F.coalesce(propagation, F.lit("bidirectional"))]
    return F.concat(F.lit("history-relation:"), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256), 1, 24))


def path_key(path: Column | str) -> Column:
    """A path without letter case, with forward slashes and without repeated or closing ones."""
    p = F.regexp_replace(F.regexp_replace(_col(path), r"\\", "/"), "(?<=.)/{2,}", "/")
    return F.lower(F.regexp_replace(p, "(?<=.)/$", ""))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def extension(path: Column | str) -> Column:
    """The last suffix with its dot, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))


def possible_version(path: Column | str) -> Column:
    """The version a file's name hints at, or null."""
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    return F.nullif(F.regexp_extract(stem, VERSION_PATTERN, 1), F.lit(""))


def design_score(path: Column | str, words: tuple[str, ...] = DESIGN_WORDS) -> Column:
    """3 for each part of the path that is a design word, and 1 for each that holds one."""
    known = F.array(*[F.lit(w) for w in words])
    part_score = lambda p: F.when(F.array_contains(known, p), 3).otherwise(0) + F.when(F.exists(known, lambda w: F.contains(p, w)), 1).otherwise(0)
    return F.aggregate(F.split(F.lower(_col(path)), r"[/\\]"), F.lit(0), lambda acc, p: acc + part_score(p))


def is_digest(col: Column | str) -> Column:
    """64 hex digits; null is none."""
    return F.coalesce(_col(col).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
