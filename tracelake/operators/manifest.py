"""Document manifests: delta, moves, and what they mean for the cases extracted from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import path_key


def current_documents(rows: DataFrame, path: str = "path", received: str = "received_at") -> DataFrame:
    """One row per path without letter case: the one received last (ties: the greatest row). Null paths are left out."""
    rest = [c for c in rows.columns if c not in (path, received)]
    best = rows.where(F.col(path).isNotNull()).groupBy(path_key(path).alias("path_key")).agg(F.max(F.struct(received, path, *rest)).alias("x"))
    return best.select("path_key", *[F.col(f"x.{c}").alias(c) for c in rows.columns])


def manifest_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path_key, path, from_path, sha256, change_kind): added, removed, changed, unchanged and moved documents.

    Both sides: path_key (unique), path, sha256; contents are compared null-safe. An added
    and a removed path with the same content are one move if no other added or removed path
    has it; a null content never moves.
    """
    c = current.select("path_key", F.col("path").alias("c_path"), F.col("sha256").alias("c_sha"), F.lit(True).alias("here"))
    p = previous.select("path_key", F.col("path").alias("p_path"), F.col("sha256").alias("p_sha"), F.lit(True).alias("there"))
    both = c.join(p, "path_key", "full_outer")
    kind = (
        F.when(F.col("there").isNull(), "added")
        .when(F.col("here").isNull(), "removed")
        .when(F.col("c_sha").eqNullSafe(F.col("p_sha")), "unchanged")
        .otherwise("changed")
    )
    delta = both.select(
        "path_key", F.coalesce("c_path", "p_path").alias("path"),
        F.when(F.col("here"), F.col("c_sha")).otherwise(F.col("p_sha")).alias("sha256"), kind.alias("change_kind"),
    )
    moves = document_moves(delta)
    gone = moves.select(F.col("from_key").alias("path_key"), F.lit(True).alias("is_source"))
    came = moves.select(F.col("to_key").alias("path_key"), "from_path")
    return (
        delta.join(gone, "path_key", "left")
        .where("is_source IS NULL")
        .join(came, "path_key", "left")
        .select("path_key", "path", "from_path", "sha256", F.when(F.col("from_path").isNotNull(), "moved").otherwise(F.col("change_kind")).alias("change_kind"))
    )


def document_moves(delta: DataFrame) -> DataFrame:
    """(sha256, from_key, from_path, to_key, to_path): contents with exactly one added and one removed path."""
    def pick(kind: str, col: str) -> Column:
        return F.min(F.when(F.col("change_kind") == kind, F.col(col)))

    sides = delta.where(F.col("change_kind").isin("added", "removed") & F.col("sha256").isNotNull()).groupBy("sha256").agg(
        F.count_if(F.col("change_kind") == "added").alias("n_added"), F.count_if(F.col("change_kind") == "removed").alias("n_removed"),
        pick("removed", "path_key").alias("from_key"), pick("removed", "path").alias("from_path"),
        pick("added", "path_key").alias("to_key"), pick("added", "path").alias("to_path"),
    )
    return sides.where("n_added = 1 AND n_removed = 1").drop("n_added", "n_removed")


def case_lifecycle(cases: DataFrame, manifest: DataFrame) -> DataFrame:
    """cases plus status and new_path: active, moved, changed, removed or invalid.

    cases: doc_path and source_sha among any columns; manifest: path_key, path, sha256. A
    case without path or content is invalid. It has moved if its path is gone and its
    content is at exactly one path, which is then new_path. Columns of cases that have one
    of the two names are replaced.
    """
    by_path = manifest.select(F.col("path_key").alias("_key"), F.lower("sha256").alias("_sha"), F.lit(True).alias("_here"))
    by_content = manifest.where("sha256 IS NOT NULL").groupBy(F.lower("sha256").alias("_sha2")).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_to"))
    cases = cases.drop("status", "new_path")
    x = cases.withColumn("_key", path_key("doc_path")).withColumn("_sha2", F.lower("source_sha"))
    x = x.join(by_path, "_key", "left").join(by_content, "_sha2", "left")
    status = (
        F.when(F.col("doc_path").isNull() | F.col("source_sha").isNull(), "invalid")
        .when(F.col("_here") & (F.col("_sha") == F.col("_sha2")), "active")
        .when(F.col("_here").isNull() & (F.col("_n") == 1), "moved")
        .when(F.col("_here"), "changed")
        .otherwise("removed")
    )
    return x.withColumn("status", status).select(*cases.columns, "status", F.when(F.col("status") == "moved", F.col("_to")).alias("new_path"))


def active_cases(lifecycle: DataFrame) -> DataFrame:
    """The cases to keep, with the path they have now; the input is not rewritten."""
    return lifecycle.where("status IN ('active', 'moved')").withColumn("doc_path", F.coalesce("new_path", "doc_path")).drop("status", "new_path")


def lifecycle_counts(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.groupBy("status").agg(F.count(F.lit(1)).alias("n_cases"))


def pending_extraction(manifest: DataFrame, cases: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents that no case was extracted from in their present content and that are not decided to be no design.

    manifest: path_key, sha256, ...; cases: doc_path, source_sha; decisions: path, sha256, classification.
    """
    done = cases.select(path_key("doc_path").alias("path_key"), F.lower("source_sha").alias("_sha")).distinct()
    decided = decisions.where("classification = 'non-design'").select(path_key("path").alias("path_key"), F.lower("sha256").alias("_sha")).distinct()
    open_ = manifest.withColumn("_sha", F.lower("sha256"))
    return open_.join(done, ["path_key", "_sha"], "left_anti").join(decided, ["path_key", "_sha"], "left_anti").drop("_sha")


def pending_validation(manifest: DataFrame, cases: DataFrame) -> DataFrame:
    """Documents with a case in their present content that is unverified; an absent status counts as that."""
    status = F.coalesce("validation_status", F.lit("unverified"))
    todo = cases.where(status == "unverified").select(path_key("doc_path").alias("path_key"), F.lower("source_sha").alias("_sha")).distinct()
    return manifest.withColumn("_sha", F.lower("sha256")).join(todo, ["path_key", "_sha"], "left_semi").drop("_sha")


def document_index(cases: DataFrame) -> DataFrame:
    """(path_key, case_id): the cases of each document, as rows; a document may have any number."""
    return cases.where("doc_path IS NOT NULL").select(path_key("doc_path").alias("path_key"), "case_id").distinct()


def first_documents(cases: DataFrame, order: str) -> DataFrame:
    """(doc_path, title, version): the first case's of each document, in the order given."""
    first = cases.where("doc_path IS NOT NULL").groupBy("doc_path").agg(F.min_by(F.struct("title", "version"), order).alias("x"))
    return first.select("doc_path", "x.title", "x.version")


def needs_compile(store_time: Column, latest_case_time: Column, n_removed: Column) -> Column:
    """A store is out of date without a time, with a newer case file, or with a removed document."""
    return store_time.isNull() | (latest_case_time > store_time) | (n_removed > 0)
