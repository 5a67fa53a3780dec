"""From case files to a published history store, and from a capture to a code store."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import rules, shred
from tracelake.operators.incremental import Store
from tracelake.runtime import cut
from tracelake.sources import cases as C
from tracelake.sources import inventory


class Rejected(Exception):
    """Input that breaks rules; nothing was published."""

    def __init__(self, errors: list[str]):
        super().__init__("\n".join(errors))
        self.errors = errors


def publish_tables(spark: SparkSession, folder: str, tables: dict[str, DataFrame], about: dict) -> int:
    """Write all tables as one new version and make it current at once."""
    store = Store(spark, folder)
    version = store.stage()
    for name, df in tables.items():
        store.write(version, name, df)
    store.publish(version, about | {"tables": sorted(tables), "published_at": time.time()})
    return version


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    store = Store(spark, folder)
    current = store.current()
    if current is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return {name: store.read([current["segment"]], name).drop("segment") for name in current["tables"]}


def compile_history(spark: SparkSession, cases_dir: str, folder: str, manifest_path: str | None = None) -> dict:
    """Check the case files below cases_dir, shred them and publish the store in folder. Returns the counts of the quality report.

    With a manifest, cases whose document has another content now are left out first. Any
    broken rule or unreadable file stops the compile, and so do case files without a case.
    """
    loaded, unreadable = C.load_cases(spark, cases_dir)
    loaded = cut(loaded.withColumn("v", F.to_json("v")), "history-loaded").withColumn("v", F.parse_json("v"))
    cases = shred.case_rows(loaded)
    n_stale = 0
    if manifest_path:
        active = inventory.active_map(inventory.load_manifest(spark, manifest_path, strict=True))
        cases, stale = shred.fresh_cases(cases, active)
        n_stale = stale.count()
        loaded = loaded.join(cases.select("file_ord", "case_ord"), ["file_ord", "case_ord"], "left_semi")
    errors = list(rules.in_words(rules.case_errors(loaded)))
    errors += [f"{r.origin}: {r.message}" for r in unreadable.toLocalIterator()]
    if not errors and cases.isEmpty():
        errors = [f"no case to compile in {cases_dir}"]
    if errors:
        raise Rejected(errors)
    tables = shred.history_tables(cases)
    version = publish_tables(spark, folder, tables, {"kind": "history"})
    stored = read_tables(spark, folder)
    counts = shred.quality_counts(stored["cases"], stored["scenarios"], stored["service_changes"], stored["conflicts"])
    return {"version": version, "skipped_stale": n_stale} | {r.metric: r.value for r in counts.collect()}


def compile_code(spark: SparkSession, capture_path: str, folder: str) -> dict:
    """Check a capture and publish its tables in folder. Returns counts and the snapshot's status."""
    capture = C.load_capture(capture_path)
    if capture.get("schema_version") != 2:
        raise Rejected(["schema_version is not 2"])
    lists = ("repositories", "mcp_calls", "query_seeds", "entities", "relations", "business_mappings")
    wrong = [f"{n} is no list" for n in lists if not isinstance(capture.get(n, []), list)]
    mcp = capture.get("mcp")
    if not isinstance(mcp, dict):
        wrong.append("mcp is no object")
    else:
        wrong += [f"mcp.{f} is not given" for f in ("server", "implementation", "transport") if not mcp.get(f)]
        wrong += ["mcp.transport is not mcp"] * (mcp.get("transport") != "mcp")
        wrong += ["mcp.tools_observed is no list"] * (not isinstance(mcp.get("tools_observed"), list))
    if not capture.get("mcp_calls"):
        wrong.append("no call was observed")
    if wrong:
        raise Rejected(wrong)
    raw = spark.createDataFrame([(json.dumps(capture, ensure_ascii=False),)], "raw string").withColumn("v", F.parse_json("raw"))
    tables = shred.code_tables(raw)
    home = os.path.dirname(os.path.abspath(capture_path))
    problems = C.response_problems(tables["mcp_calls"], C.raw_responses(spark, home)).select(
        F.col("call_id").alias("object_id"), F.lit("mcp_calls[].response_path").alias("path"), "message"
    )
    errors = wrong_repositories(capture) + list(rules.in_words(rules.capture_errors(tables).unionByName(problems)))
    if errors:
        raise Rejected(errors)
    status = shred.snapshot_status(tables["mcp_calls"]).first().status
    version = publish_tables(spark, folder, tables, {"kind": "code", "status": status})
    return {"version": version, "status": status} | {n: tables[n].count() for n in lists}


def wrong_repositories(capture: dict) -> list[str]:
    """What is wrong with the coverage of repositories and the arguments of calls, before they are kept as text."""
    out = []
    for n, repository in enumerate(capture.get("repositories", [])):
        if isinstance(repository, dict):
            coverage, left_out = repository.get("coverage"), repository.get("not_covered")
            out += [f"{n}: repositories[].coverage: has no entry"] * (not isinstance(coverage, list) or not coverage)
            out += [f"{n}: repositories[].not_covered: is no list"] * (not isinstance(left_out, list))
    for n, call in enumerate(capture.get("mcp_calls", [])):
        if isinstance(call, dict):
            out += [f"{n}: mcp_calls[].arguments: is no object"] * (not isinstance(call.get("arguments"), dict))
    return out


def snapshot_state(status: str | None, repositories: DataFrame, states: DataFrame | None) -> tuple[str, list[str]]:
    """(status, issues) of a code snapshot as it is now.

    status: what it was published with, None if there is none; states: (name, status) of
    repository_states, None where nothing was looked up. A repository without name, branch
    or commit makes the snapshot invalid.
    """
    if status is None:
        return "missing", ["no code snapshot is published"]
    if status not in ("fresh", "stale", "unknown"):
        return "invalid", [f"a status that is not known: {status}"]
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    counts = repositories.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank("name") | blank("branch") | blank("commit_sha")).alias("bad")).first()
    if counts.bad:
        return "invalid", [f"{counts.bad} repositories without name, branch or commit"]
    if not counts.n:
        return "unknown", ["the snapshot holds no repository"]
    found = {r.status: r["count"] for r in states.groupBy("status").count().collect()} if states is not None else {"unknown": counts.n}
    if status == "stale" or found.get("stale"):
        return "stale", [f"{found.get('stale', 0)} repositories have changed, or a call failed or was stale"]
    if status == "unknown" or found.get("unknown"):
        return "unknown", [f"{found.get('unknown', 0)} repositories could not be compared"]
    return "fresh", []


def workspace_status(spark: SparkSession, documents: DataFrame, previous: DataFrame | None, cases_dir: str, decisions: DataFrame, store: str, code: str, found: DataFrame | None = None, latest_case: float = 0.0) -> dict:
    """What there is to do in a workspace: delta, pending work, whether to compile, the state of the code snapshot, next actions.

    documents, previous: (path, sha256) of the present and the last scan; decisions:
    documents that are no design; store, code: folders of the published stores; found:
    (name, branch, commit_sha, dirty) of the repositories as they are now; latest_case: time
    of the newest case file.
    """
    from tracelake.operators import manifest as M

    stamped = lambda df: M.current_documents(df.select("path", "sha256", F.lit(0).alias("received_at")))
    now = cut(stamped(documents), "workspace-documents")
    delta = M.manifest_delta(now, stamped(previous) if previous is not None else now.limit(0))
    changes = {r.change_kind: r["count"] for r in delta.groupBy("change_kind").count().collect()}
    loaded, wrong = C.load_cases(spark, cases_dir, "tolerant")
    cases = shred.case_rows(loaded)
    pending = M.pending_extraction(now, cases, decisions).count()
    unverified = M.pending_validation(now, cases).count()
    published = Store(spark, store).current()
    compiled = published.get("published_at") if published else None
    lit = lambda x: F.lit(x).cast("double")
    stale = spark.range(1).select(M.needs_compile(lit(compiled), lit(latest_case), F.lit(changes.get("removed", 0))).alias("x")).first().x
    snapshot = Store(spark, code).current()
    repositories = read_tables(spark, code)["repositories"] if snapshot else None
    states = repository_states(repositories, found) if snapshot and found is not None else None
    status, issues = snapshot_state(snapshot.get("status", "unknown") if snapshot else None, repositories, states)
    open_work = pending or unverified
    actions = (
        ["extract_pending_documents"] * bool(pending) + ["verify_pending_cases"] * bool(unverified) + ["compile_history"] * bool(stale and not open_work)
        + ["initialize_code_snapshot"] * (status == "missing") + ["refresh_code_snapshot"] * (status in ("stale", "invalid")) + ["analyze_current_change"] * (not open_work)
    )
    return {
        "document_count": now.count(), "delta": changes, "pending_extraction": pending, "pending_validation": unverified, "case_errors": wrong.count(),
        "needs_compile": bool(stale), "code_snapshot_status": status, "code_snapshot_issues": issues, "next_actions": actions,
    }


def repository_states(repositories: DataFrame, found: DataFrame) -> DataFrame:
    """(name, status) of captured repositories (name, path, branch, commit_sha) against what is found (name, branch, commit_sha, dirty).

    Without recorded path, or not found, it is unknown; another commit or branch, or a
    working tree with changes, makes it stale.
    """
    from tracelake.functions.digests import same_commit

    x = repositories.join(found.select("name", F.col("branch").alias("b"), F.col("commit_sha").alias("c"), "dirty"), "name", "left")
    unknown = F.col("path").isNull() | (F.col("path") == "") | F.col("b").isNull() | F.col("c").isNull() | F.col("dirty").isNull()
    other = ~same_commit(F.col("commit_sha"), F.col("c")) | (~F.col("branch").isin("HEAD", "detached") & (F.col("branch") != F.col("b"))) | F.col("dirty")
    return x.select("name", F.when(unknown, "unknown").when(other, "stale").otherwise("fresh").alias("status"))
