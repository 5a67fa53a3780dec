"""The queries p1_ and p5_ over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.digests import digest_value, same_commit
from tracelake.operators import incremental, snapshots
from tracelake.runtime import scratch, table


def _same_content(kind, content, prev):
    """Digests byte by byte, commit ids by prefix."""
    commits = same_commit(content.cast("string"), prev.cast("string"))
    return F.when(kind == "repository", commits).otherwise(content.eqNullSafe(prev))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = incremental.run_starts(table(spark, folder, "index_runs"))
    documents = table(spark, folder, "manifest").select(
        F.lit("document").alias("kind"), F.col("path").alias("key"), F.col("snapshot_no").alias("version"),
        "received_at", digest_value("sha256").alias("content"),
    )
    repositories = table(spark, folder, "repositories").select(
        F.lit("repository").alias("kind"), F.col("name").alias("key"), F.col("capture_no").alias("version"),
        "received_at", F.encode(F.lower(F.trim("commit_sha")), "utf-8").alias("content"),
    )
    found = incremental.replay(
        spark, documents.unionByName(repositories), [s for _, s in runs], _same_content, scratch(spark, "p1")
    )
    ids = F.element_at(F.array(*[F.lit(r) for r, _ in runs]), F.col("run_no") + 1) if runs else F.lit(None).cast("int")
    return found.select(ids.alias("run_id"), F.col("kind").alias("record_kind"), F.col("key").alias("record_key"))


def _snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    manifest = table(spark, folder, "manifest").select(
        F.col("root").alias("grp"), "snapshot_no", F.col("path").alias("key"), digest_value("sha256").alias("content"), "received_at"
    )
    deliveries = table(spark, folder, "snapshot_deliveries").select(F.col("root").alias("grp"), "snapshot_no", "status", "delivered_at")
    return manifest, deliveries


def _changes(found: DataFrame) -> DataFrame:
    return found.select("snapshot_no", F.col("key").alias("path"), "change_kind")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(snapshots.snapshot_changes(*_snapshots(spark, folder))[0])


def p5_two_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The changes in two calls: of the first half of the snapshots, then of all over the dictionary of the first call.

    The second call's changes up to the middle are those of the first, which are listed.
    """
    manifest, deliveries = _snapshots(spark, folder)
    middle = manifest.agg(F.floor((F.min("snapshot_no") + F.max("snapshot_no")) / 2).alias("m")).first().m or 0
    early, dictionary = snapshots.snapshot_changes(manifest.where(F.col("snapshot_no") <= middle), deliveries.where(F.col("snapshot_no") <= middle))
    late, _ = snapshots.snapshot_changes(manifest, deliveries, dictionary)
    return _changes(early).unionByName(_changes(late.where(F.col("snapshot_no") > middle)))


#: A digest's 64 digits, whatever surrounds them.
_DIGITS = "regexp_extract(lower({0}), '([0-9a-f]{{64}})', 1)"

P5_SQL = f"""
WITH seqs AS (
  SELECT root, snapshot_no, lag(snapshot_no) OVER (PARTITION BY root ORDER BY snapshot_no) AS prev_no
  FROM (SELECT DISTINCT root, snapshot_no FROM snapshot_deliveries WHERE status = 'complete')),
latest AS (
  SELECT root, snapshot_no, path, CASE WHEN sha256 IS NULL THEN '-' ELSE {_DIGITS.format('sha256')} END AS digest
  FROM manifest QUALIFY row_number() OVER (PARTITION BY root, snapshot_no, path ORDER BY received_at DESC) = 1),
cur AS (SELECT l.*, s.prev_no FROM latest l JOIN seqs s USING (root, snapshot_no) WHERE s.prev_no IS NOT NULL),
prev AS (SELECT l.*, s.snapshot_no AS next_no FROM latest l JOIN seqs s ON s.root = l.root AND s.prev_no = l.snapshot_no)
SELECT coalesce(c.snapshot_no, p.next_no) AS snapshot_no, coalesce(c.path, p.path) AS path,
  CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN prev p ON p.root = c.root AND p.path = c.path AND p.next_no = c.snapshot_no
WHERE p.path IS NULL OR c.path IS NULL OR c.digest <> p.digest
"""

P1_SQL = f"""
WITH runs AS (
  SELECT run_id, started_at, row_number() OVER (ORDER BY started_at) AS n
  FROM (SELECT DISTINCT run_id, started_at FROM index_runs WHERE status = 'succeeded')),
arrivals AS (
  SELECT 'document' AS record_kind, path AS record_key, snapshot_no AS version, received_at,
    CASE WHEN sha256 IS NULL THEN '-' ELSE {_DIGITS.format('sha256')} END AS content FROM manifest
  UNION ALL
  SELECT 'repository', name, capture_no, received_at, lower(commit_sha) FROM repositories),
states AS (
  SELECT r.n, r.run_id, a.* FROM runs r JOIN arrivals a ON a.received_at < r.started_at
  QUALIFY row_number() OVER (PARTITION BY r.n, record_kind, record_key ORDER BY version DESC, received_at DESC) = 1)
SELECT c.run_id, c.record_kind, c.record_key
FROM states c LEFT JOIN states p ON p.n = c.n - 1 AND p.record_kind = c.record_kind AND p.record_key = c.record_key
WHERE c.n > 1 AND (p.record_key IS NULL OR NOT CASE WHEN c.record_kind = 'document' THEN c.content = p.content
  ELSE starts_with(c.content, p.content) OR starts_with(p.content, c.content) END)
"""

QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p5_two_calls": p5_two_calls}
SQL = {"p1_found": P1_SQL, "p5_found": P5_SQL, "p5_two_calls": P5_SQL}
