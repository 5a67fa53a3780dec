"""The pipeline over hand-made case files, a capture and a spec, with results worked out by hand."""

import hashlib
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import got
from tracelake.operators import impact, manifest, rules, shred
from tracelake.plans import analyze as A
from tracelake.plans import history as H
from tracelake.sources import cases as C
from tracelake.sources import inventory
from tracelake.streaming import cases as SC

EVIDENCE = {"kind": "explicit", "section": "2.1"}
RELATION = {"source": "馆藏状态", "type": "controls", "target": "外借许可", "direction": "forward", "propagation": "bidirectional", "conditions": ["archived"], "version_scope": {"from": "v1"}, "evidence": EVIDENCE}
SPEC = {
    "title": "archive", "before_behaviors": ["馆藏可外借"], "after_behaviors": ["封存后不可外借"], "business_objects": ["馆藏"], "capabilities": [], "change_types": ["状态约束"], "actions": ["封存"],
    "states": ["封存"], "actors": [], "triggers": [], "changed_rules": [], "invariants": ["封存馆藏不可外借"],
}


def case(case_id, sha, **more):
    base = {
        "case_id": case_id, "title": "shelf archive", "domain": "trade", "source": {"path": "/docs/archive.md", "sha256": sha, "version": "v1"},
        "business_objects": ["馆藏"], "capabilities": [], "change_types": ["状态约束"], "actions": ["封存"], "states": ["封存"], "business_invariants": ["封存馆藏不可外借"],
        "scenarios": [{"name": "封存后外借", "expected_behavior": "拒绝", "evidence": EVIDENCE}],
        "service_changes": [
            {"service": "Catalog-Service", "responsibility": "state", "asset_types": ["api", "database"], "modifications": ["add status", "check status"], "evidence": EVIDENCE},
            {"service": "loan-service", "responsibility": "guard", "asset_types": ["api"], "modifications": "refuse", "evidence": {"kind": "inferred", "section": "3"}},
        ],
        "relations": [RELATION], "historical_omissions": ["audit forgotten"], "uncertain_fields": [], "conflicts": [],
        "extraction": {"run_id": "e1", "executor": "a", "completed_at": "t"},
        "validation": {"status": "validated", "confidence": "high", "method": "independent", "run_id": "v1", "reviewer": "b", "reviewed_at": "t", "source_sha256": sha, "independent_context": True, "verified_fields": ["all"], "issues": []},
    }
    return base | more


def conflict(sha):
    claims = [{"value": 1, "evidence": EVIDENCE}, {"value": 0, "evidence": EVIDENCE}]
    return case(
        "archive-conflict", sha, change_types=["流程扩展"], scenarios=[{"name": "重复封存", "expected_behavior": "忽略", "evidence": {"kind": "explicit", "line": 0}}],
        service_changes=[{"service": "reader-desk", "modifications": [], "evidence": EVIDENCE}], historical_omissions=[{"description": "", "evidence": EVIDENCE}],
        conflicts=[{"topic": "limit", "claims": claims, "resolution_status": "open"}], validation={"status": "conflict", "confidence": "low"},
    )


@pytest.fixture
def world(tmp_path):
    sha = hashlib.sha256("design".encode()).hexdigest()
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "archive.md").write_text("design")
    folder = tmp_path / "cases"
    folder.mkdir()
    (folder / "a.json").write_text("﻿" + json.dumps([case("archive-v1", sha)], ensure_ascii=False))
    (folder / "b.jsonl").write_text(json.dumps(conflict(sha), ensure_ascii=False) + "\n\n")
    return tmp_path, sha


def capture(tmp_path, **more):
    (tmp_path / "raw").mkdir(exist_ok=True)
    (tmp_path / "raw" / "r.txt").write_text("response")
    digest = hashlib.sha256(b"response").hexdigest()
    ev = {"kind": "codegraph-mcp", "mcp_call_id": "call1"}
    value = {
        "schema_version": 2, "generated_at": "t", "mcp": {"server": "s", "implementation": "i", "transport": "mcp", "tools_observed": ["x"]},
        "repositories": [{"name": "catalog", "branch": "main", "commit": "abc", "indexed_at": "t", "coverage": ["api"], "not_covered": []}],
        "mcp_calls": [{"id": "call1", "repository": "catalog", "tool": "x", "arguments": {"q": "1"}, "response_path": "raw/r.txt", "response_sha256": digest, "observed_at": "t", "status": "ok", "staleness": "fresh"}],
        "query_seeds": [{"repository": "catalog", "category": "business", "seed": "馆藏", "status": "matched", "mcp_call_ids": ["call1"]}],
        "entities": [
            {"id": "job", "type": "job", "name": "ArchiveJob", "service": "catalog-service", "repository": "catalog", "location": {"file": "a", "line": 1}, "evidence": ev},
            {"id": "field", "type": "field", "name": "status", "service": "catalog-service", "repository": "catalog", "location": {}, "evidence": ev},
        ],
        "relations": [{"source_id": "job", "type": "writes", "target_id": "field", "repository": "catalog", "evidence": ev}],
        "business_mappings": [{"business_object": "馆藏", "asset_id": "job", "confidence": "high", "evidence": ev}],
    } | more
    path = tmp_path / "capture.json"
    path.write_text(json.dumps(value, ensure_ascii=False))
    return str(path)


def write_manifest(tmp_path, documents):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"schema_version": 1, "documents": documents}))
    return str(path)


def test_whole_pipeline(spark, world):
    tmp_path, sha = world
    store = f"file://{tmp_path}/store"
    report = H.compile_history(spark, f"{tmp_path}/cases", store, write_manifest(tmp_path, [{"path": "/docs/Archive.md", "sha256": sha.upper()}]))
    assert {k: v for k, v in report.items() if k not in ("version", "skipped_stale")} == {
        "status:validated": 1, "status:conflict": 1, "tier:trusted": 1, "tier:conflict": 1, "cases": 2, "scenarios": 2, "services": 3, "conflicts": 1, "review_queue": 1,
    }
    tables = H.read_tables(spark, store)
    assert got(tables["service_changes"], "normalized_service", "modification", "knowledge_tier") == [
        ("catalog-service", "add status", "trusted"), ("catalog-service", "check status", "trusted"), ("loan-service", "refuse", "candidate"), ("reader-desk", "", "conflict"),
    ]
    assert got(tables["service_cochange"]) == [("catalog-service", "loan-service", 1)]
    assert got(tables["historical_omissions"], "description") == [("audit forgotten",)]
    assert got(tables["documents"]) == [("/docs/archive.md", "shelf archive", "v1")]
    code = f"file://{tmp_path}/code"
    assert H.compile_code(spark, capture(tmp_path), code)["status"] == "fresh"
    aliases = spark.createDataFrame([("入库", "封存")], "alias string, canonical string")
    found = A.analyze(spark, tables, {"archive": SPEC}, aliases, H.read_tables(spark, code))
    assert got(found.matched, "case_id", "propagated", "score") == [("archive-conflict", False, 6.3), ("archive-v1", False, 7.3)]
    assert found.history_paths.count() == 4
    assert got(found.code_impacts, "entity_id", "depth", "score") == [("field", 1, 0.7), ("job", 0, 2.0)]
    assert found.code_paths.count() == 2
    assert found.scenarios.count() == 2 and found.services.count() == 3 and found.conflicts.count() == 1
    assert got(found.services.where("service_key = 'catalog-service'"), "service", "knowledge_tier", "n_entities", "source") == [("Catalog-Service", "trusted", 2, "matched-history")]
    assert got(found.cochanges, "score", "frequency", "expanded") == [(0.8667, 0.3333, False)]
    assert found.issues == []
    per_case, overall = A.replay_metrics(found, [{
        "id": "archive", "expected_scenarios": ["封存后外借", {"scenario": "never seen"}], "expected_services": [{"service": "CATALOG-SERVICE"}],
        "expected_evidence": [{"scenario": "封存后外借", "case_ids": ["ARCHIVE-v1", "other"]}, {"scenario": "never seen", "case_ids": ["x"]}, "odd"],
    }])
    assert got(overall, "kind", "precision", "recall") == [("evidence", 1.0, 0.5), ("scenario", 0.5, 0.5), ("service", 0.3333, 1.0)]


def test_names_that_only_look_alike_change_together(spark, world):
    """Stored names in full-width letters meet their direct keys."""
    tmp_path, sha = world
    wide = [{"service": s, "responsibility": "r", "asset_types": [], "modifications": ["m"], "evidence": EVIDENCE} for s in ("Ａpi", "Ｂatch")]
    for n in range(2):
        (tmp_path / "cases" / f"w{n}.json").write_text(json.dumps(case(f"wide-{n}", sha, service_changes=wide)))
    store = f"file://{tmp_path}/store"
    H.compile_history(spark, f"{tmp_path}/cases", store)
    found = A.analyze(spark, H.read_tables(spark, store), {"archive": SPEC})
    assert ("ａpi", "ｂatch", 2) in got(found.cochanges, "service_a", "service_b", "case_count")


def test_stale_cases_are_left_out(spark, world):
    tmp_path, sha = world
    # one case is of the document's present content, the other is not; without any case nothing is published
    (tmp_path / "cases" / "c.json").write_text(json.dumps(case("fresh", "0" * 64)))
    listed = write_manifest(tmp_path, [{"path": "/docs/archive.md", "sha256": "0" * 64}])
    report = H.compile_history(spark, f"{tmp_path}/cases", f"file://{tmp_path}/s", listed)
    assert report["skipped_stale"] == 2 and report["cases"] == 1
    (tmp_path / "cases" / "c.json").unlink()
    with pytest.raises(H.Rejected, match="no case"):
        H.compile_history(spark, f"{tmp_path}/cases", f"file://{tmp_path}/t", listed)
    (tmp_path / "none").mkdir()
    with pytest.raises(H.Rejected, match="no case"):
        H.compile_history(spark, f"{tmp_path}/none", f"file://{tmp_path}/t")


def test_broken_cases_stop_the_compile(spark, world):
    tmp_path, sha = world
    bad = case("archive-v1", sha, business_objects=[], relations=[RELATION | {"propagation": "odd", "evidence": {"kind": "explicit"}}], validation={"status": "validated", "confidence": "sure"})
    (tmp_path / "cases" / "c.json").write_text(json.dumps(bad))
    (tmp_path / "cases" / "d.json").write_text("[1")
    store = f"file://{tmp_path}/store"
    with pytest.raises(H.Rejected) as e:
        H.compile_history(spark, f"{tmp_path}/cases", store)
    text = str(e.value)
    for part in ("business_objects has no entry", "propagation is none", "evidence needs", "validation.confidence", "case_id was used before", "run_id", "no JSON"):
        assert part in text
    with pytest.raises(FileNotFoundError):
        H.read_tables(spark, store)


def test_valid_cases_break_no_rule(spark, world):
    tmp_path, _ = world
    loaded, errors = C.load_cases(spark, f"{tmp_path}/cases")
    assert got(rules.case_errors(loaded)) == [] and errors.count() == 0


def test_loader_modes(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"case_id": "a"}, 3]')
    (tmp_path / "y.jsonl").write_text('{"case_id": "b"}\n"text"\n')
    counts = {m: C.load_cases(spark, str(tmp_path), m)[0].count() for m in ("strict", "tolerant", "all")}
    assert counts == {"strict": 0, "tolerant": 2, "all": 4}
    assert C.load_cases(spark, str(tmp_path))[1].count() == 2
    empty = tmp_path / "none"
    empty.mkdir()
    assert C.load_cases(spark, str(empty))[0].count() == 0


def test_broken_captures(spark, tmp_path):
    ev = {"kind": "codegraph-mcp", "mcp_call_id": "lost"}
    path = capture(
        tmp_path, relations=[{"source_id": "job", "type": "writes", "target_id": "ghost", "evidence": ev}, {"source_id": "job", "type": "calls", "target_id": "out", "target_external": True, "evidence": ev}],
        business_mappings=[{"business_object": "馆藏", "asset_id": "nothing", "confidence": "high", "evidence": ev}],
    )
    with pytest.raises(H.Rejected) as e:
        H.compile_code(spark, path, f"file://{tmp_path}/code")
    for part in ("no such entity, and not external: ghost", "no such entity: nothing", "no such call: lost", "high confidence without", "an external target without repository"):
        assert part in str(e.value)
    with pytest.raises(H.Rejected):
        H.compile_code(spark, capture(tmp_path, mcp_calls=[]), f"file://{tmp_path}/code")
    call = json.loads(open(capture(tmp_path)).read())["mcp_calls"][0]
    for response, message in (("../capture.json", "leads out"), ("raw/none.txt", "no file at"), ("capture.json", "another digest")):
        with pytest.raises(H.Rejected, match=message):
            H.compile_code(spark, capture(tmp_path, mcp_calls=[call | {"response_path": response}]), f"file://{tmp_path}/code")


def test_snapshot_status(rows):
    schema = "status string, staleness string"
    for calls, status in (([("ok", "fresh")], "fresh"), ([("ok", "fresh"), ("truncated", "fresh")], "stale"), ([("ok", "unknown")], "unknown"), ([], "unknown"), ([("ok", "stale")], "stale")):
        assert shred.snapshot_status(rows(calls, schema)).first().status == status


def test_repository_states(rows):
    repos = rows([("a", "/a", "main", "abc1"), ("b", None, "main", "abc"), ("c", "/c", "main", "abc"), ("d", "/d", "HEAD", "abc"), ("e", "/e", "main", "abc")], "name string, path string, branch string, commit_sha string")
    found = rows([("a", "main", "ABC1234", False), ("b", "main", "abc", False), ("c", "dev", "abc", False), ("d", "x", "abc", False), ("e", "main", "abc", True)], "name string, branch string, commit_sha string, dirty boolean")
    assert got(H.repository_states(repos, found)) == [("a", "fresh"), ("b", "unknown"), ("c", "stale"), ("d", "fresh"), ("e", "stale")]


def test_scan_move_and_change(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "node_modules").mkdir(parents=True)
    for name, text in (("a v1.md", "one"), ("b+%41.TXT", "two"), ("skip.bin", "x"), ("node_modules/c.md", "c")):
        (root / name).write_text(text)
    docs, errors = inventory.scan_root(spark, str(root), exclude=["*.html"])
    assert errors == [] and got(docs, "relative_path", "possible_version", "sha256") == sorted(
        [("a v1.md", "v1", hashlib.sha256(b"one").hexdigest()), ("b+%41.TXT", None, hashlib.sha256(b"two").hexdigest()), ("node_modules/c.md", None, hashlib.sha256(b"c").hexdigest())], key=repr
    )
    assert inventory.scan_root(spark, str(tmp_path / "no"))[1]
    kept = docs.where(inventory.in_workspace(F.col("relative_path"), False))
    before = manifest.current_documents(kept.select("path", "sha256", F.lit(1).alias("received_at"))).persist()
    before.count()
    (root / "a v1.md").rename(root / "renamed.md")
    after = manifest.current_documents(inventory.scan_root(spark, str(root))[0].where(inventory.in_workspace(F.col("relative_path"), False)).select("path", "sha256", F.lit(1).alias("received_at"))).persist()
    delta = manifest.manifest_delta(after, before)
    assert got(delta.groupBy("change_kind").count()) == [("moved", 1), ("unchanged", 1)]
    cases = spark.createDataFrame([("c", f"{root}/a v1.md", hashlib.sha256(b"one").hexdigest(), "mine"), ("d", None, "x", ""), ("e", f"{root}/b+%41.TXT", "old", "")], "case_id string, doc_path string, source_sha string, status string")
    life = manifest.case_lifecycle(cases, after)
    assert got(life, "case_id", "status", "new_path") == [("c", "moved", f"{root}/renamed.md"), ("d", "invalid", None), ("e", "changed", None)]
    assert got(manifest.active_cases(life), "case_id", "doc_path") == [("c", f"{root}/renamed.md")]


def test_union_of_roots(rows):
    scans = [rows([("/a/x", 1)], "path string, n int"), rows([("/a/x", 2), ("/A/X", 3)], "path string, n int")]
    assert got(inventory.union_roots(scans)) == [("/A/X", 3), ("/a/x", 1)]
    assert got(inventory.union_roots(scans, fold_case=True)) == [("/a/x", 1)]


def test_stream_of_cases(spark, world):
    tmp_path, sha = world
    (tmp_path / "in").mkdir()
    lines = [json.dumps(x) for x in (case("one", sha), case("two", sha, title=""), {"title": "t"}, case(" three ", sha, title=""), "text", case("four", sha))]
    (tmp_path / "in" / "1.jsonl").write_text("\n".join([*lines, "not json", lines[-1]]) + "\n")
    seen = []

    def run():
        query = SC.write_tables(SC.case_stream(spark, str(tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/cp", on_errors=lambda e: seen.extend(e.collect()))
        query.awaitTermination()
        return got(spark.read.parquet(f"{tmp_path}/out/cases"), "case_id")

    assert run() == [("four",), ("one",)]
    assert {r.object_id for r in seen} == {"two", " three ", "four", "<unknown>"}
    assert {r.message for r in seen if r.object_id == "<unknown>"} >= {"no JSON", "no object"} and len({r.row for r in seen}) == 6
    seen.clear()
    # ids of earlier batches are taken
    (tmp_path / "in" / "2.jsonl").write_text(json.dumps(case("one", sha)) + "\n" + json.dumps(case("five", sha)) + "\n")
    assert run() == [("five",), ("four",), ("one",)]
    assert [(r.object_id, r.path) for r in seen] == [("one", "case_id")]


def test_scan_reads_only_what_it_keeps(spark, tmp_path):
    root = tmp_path / "scan"
    (root / "x").mkdir(parents=True)
    (root / "a.md").write_text("one")
    (root / "x" / "gone.md").symlink_to(root / "a.md")
    (root / "big.bin").write_bytes(b"0")
    os.truncate(root / "big.bin", 3 << 30)
    files, errors = inventory.scan_files(spark, str(root), [".md"])
    assert errors == [] and got(files, "relative_path", "error") == [("a.md", None), ("x/gone.md", None)]
    uri = f"file:{root}/none.md"
    (batch,) = inventory._digests(iter([pd.DataFrame({"uri": [uri, f"file:{root}/a.md"]})]))
    assert batch["error"][0].startswith("cannot be read") and batch["sha256"].tolist()[1] == hashlib.sha256(b"one").hexdigest()


def test_workspace_status(spark, world, rows):
    tmp_path, sha = world
    decisions = rows([], "path string, sha256 string, classification string")
    documents = rows([("/docs/archive.md", sha), ("/docs/new.md", "1" * 64)], "path string, sha256 string")
    store, code = f"file://{tmp_path}/store", f"file://{tmp_path}/code"
    status = lambda previous=None, found=None, done=decisions: H.workspace_status(spark, documents, previous, f"{tmp_path}/cases", done, store, code, found)
    first = status()
    assert first["delta"] == {"added": 2} and first["pending_extraction"] == 1 and first["needs_compile"]
    assert first["next_actions"] == ["extract_pending_documents", "initialize_code_snapshot"]
    decided = rows([("/docs/new.md", "1" * 64, "non-design")], "path string, sha256 string, classification string")
    assert status(done=decided)["next_actions"] == ["compile_history", "initialize_code_snapshot", "analyze_current_change"]
    H.compile_history(spark, f"{tmp_path}/cases", store)
    H.compile_code(spark, capture(tmp_path, repositories=[{"name": "catalog", "path": "/r", "branch": "main", "commit": "abc", "indexed_at": "t", "coverage": ["api"], "not_covered": []}]), code)
    found = lambda commit: rows([("catalog", "main", commit, False)], "name string, branch string, commit_sha string, dirty boolean")
    same = status(documents, found("ABC123"), decided)
    assert same["delta"] == {"unchanged": 2} and not same["needs_compile"] and same["code_snapshot_status"] == "fresh" and same["next_actions"] == ["analyze_current_change"]
    assert status(documents, found("def"), decided)["next_actions"] == ["refresh_code_snapshot", "analyze_current_change"]
    assert status(documents, None, decided)["code_snapshot_status"] == "unknown"
    repos = rows([("a", "", "c")], "name string, branch string, commit_sha string")
    assert H.snapshot_state("fresh", repos, None)[0] == "invalid" and H.snapshot_state("odd", repos, None)[0] == "invalid" and H.snapshot_state(None, repos, None)[0] == "missing"
    assert H.snapshot_state("fresh", repos.limit(0), None)[0] == "unknown"


def test_rest_of_the_capture_rules(spark, tmp_path):
    call = json.loads(open(capture(tmp_path)).read())["mcp_calls"][0]
    path = capture(tmp_path, repositories=[{"name": "catalog", "branch": "main", "commit": "abc", "indexed_at": "t", "coverage": [], "not_covered": "x"}], mcp_calls=[call | {"arguments": "q"}])
    with pytest.raises(H.Rejected) as e:
        H.compile_code(spark, path, f"file://{tmp_path}/code")
    assert all(part in str(e.value) for part in ("coverage: has no entry", "not_covered: is no list", "arguments: is no object"))


def test_cochange_expansion(rows):
    scored = rows([("s", "a", "b", 0.7, True), ("s", "b", "c", 0.9, True), ("s", "c", "d", 0.9, False)], "spec_id string, service_a string, service_b string, score double, expanded boolean")
    services = rows([("s", "a")], "spec_id string, service_key string")
    assert got(impact.expand_services(scored, services)) == [("s", "b", "b", 0.7), ("s", "c", "c", 0.9)]
