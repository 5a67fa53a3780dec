"""Command line: inventory, workspace, compile, analyze, replay. Exit codes: 0 done, 1 a gate failed, 2 could not run."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import functions as F

from tracelake.operators import manifest as M
from tracelake.operators import replay as R
from tracelake.plans import analyze as A
from tracelake.plans import history as H
from tracelake.runtime import clear, cut, session
from tracelake.sources import cases as C
from tracelake.sources import inventory as I


def write_json(path: str, value: dict) -> None:
    """Write a file at once: a reader sees the old or the new one."""
    draft = f"{path}.{os.getpid()}.tmp"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(draft, path)


def write_manifest(docs, path: str, about: dict) -> int:
    """Write a manifest document by document in order of their paths; the driver never holds the list. The number of documents."""
    draft, n = f"{path}.{os.getpid()}.tmp", 0
    with open(draft, "w", encoding="utf-8") as f:
        head = json.dumps({"schema_version": 1, "generated_at": datetime.now(UTC).isoformat()} | about, ensure_ascii=False)
        f.write(head[:-1] + ', "documents": [')
        for r in docs.orderBy(F.lower("path"), "path").toLocalIterator():
            f.write(("," if n else "") + "\n" + json.dumps(r.asDict(), ensure_ascii=False))
            n += 1
        f.write("\n]}\n")
    os.replace(draft, path)
    return n


def _url(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


def inventory(spark, a) -> int:
    """Scan roots, compare with the previous manifest and write the new one."""
    scans, errors = [], []
    for root in a.root:
        docs, wrong = I.scan_files(spark, root, a.extension, a.exclude)
        errors += wrong
        if docs is not None:
            scans.append(docs)
    scanned = cut(I.union_roots(scans), "inventory-scan") if scans else None
    docs = scanned.where("error IS NULL").drop("error") if scans else None
    if scans:
        errors += [f"{r.path}: {r.error}" for r in scanned.where("error IS NOT NULL").toLocalIterator()]
    value = {"roots": a.root, "extensions": I.extensions(a.extension), "errors": errors}
    if docs is not None:
        now = docs.select("path", "sha256", F.lit(0).alias("received_at"))
        before = I.load_manifest(spark, a.previous, strict=True) if a.previous else now.limit(0)
        delta = M.manifest_delta(M.current_documents(now), M.current_documents(before.select("path", "sha256", F.lit(0).alias("received_at"))))
        changes: dict[str, list] = {k: [] for k in ("added", "changed", "unchanged", "removed", "moved")}
        for r in delta.orderBy("path").toLocalIterator():
            changes[r.change_kind].append({"from": r.from_path, "to": r.path, "sha256": r.sha256} if r.change_kind == "moved" else r.path)
        value["delta"] = changes
        n = write_manifest(docs, a.output, value)
    else:
        n = 0
        write_json(a.output, {"schema_version": 1, "documents": []} | value)
    print(json.dumps({"documents": n, "errors": len(errors)} | {k: len(v) for k, v in value.get("delta", {}).items()}))
    return 1 if errors else 0


def compile_history(spark, a) -> int:
    print(json.dumps(H.compile_history(spark, a.cases, _url(a.output), a.manifest)))
    return 0


def compile_code(spark, a) -> int:
    print(json.dumps(H.compile_code(spark, a.input, _url(a.output))))
    return 0


def reconcile(spark, a) -> int:
    """What became of the cases' documents; the cases to keep are written as a table, the case files stay as they are."""
    from tracelake.operators import shred

    loaded, _ = C.load_cases(spark, a.cases, "all")
    cases = shred.case_rows(loaded).drop("v")
    life = M.case_lifecycle(cases, M.current_documents(I.load_manifest(spark, a.manifest, strict=True).select("path", "sha256", F.lit(0).alias("received_at")))).persist()
    counts = {r.status: r.n_cases for r in M.lifecycle_counts(life).collect()}
    if not a.dry_run:
        active = M.active_cases(life)
        H.publish_tables(spark, _url(a.output), {"cases_active": active, "document_index": M.document_index(active)}, {"kind": "cases"})
    life.unpersist()
    print(json.dumps(counts))
    return 1 if counts.get("invalid") else 0


def _analyzed(spark, a, specs: dict) -> A.Impact:
    aliases = C.load_aliases(spark, a.aliases) if a.aliases else None
    code = H.read_tables(spark, _url(a.code_db)) if a.code_db else None
    return A.analyze(spark, H.read_tables(spark, _url(a.db)), specs, aliases, code, a.min_match_score, a.graph_depth)


def analyze(spark, a) -> int:
    """Match one spec and publish the result tables; the report on paper is one JSON per line and table."""
    found = _analyzed(spark, a, {"spec": C.load_object(a.change_spec)})
    tables = {n: df for n, df in vars(found).items() if n != "issues" and df is not None}
    H.publish_tables(spark, _url(a.output), tables, {"kind": "impact"})
    stored = H.read_tables(spark, _url(a.output))
    print(json.dumps({n: df.count() for n, df in stored.items()} | {"issues": [m for _, m in found.issues]}, ensure_ascii=False))
    return 0


def replay(spark, a) -> int:
    """Analyze all cases of a dataset in one go and rate the results."""
    dataset = C.load_replay(a.dataset)
    home, defaults, thresholds = os.path.dirname(os.path.abspath(a.dataset)), dataset.get("defaults", {}), dataset.get("thresholds", {})
    known = {f"{k}_{m}" for k in ("scenario", "service", "evidence") for m in ("precision", "recall", "f1")}
    if set(thresholds) - known:
        raise ValueError(f"no such metric: {', '.join(sorted(set(thresholds) - known))}")
    at = lambda p: os.path.join(home, p) if p else None
    # cases with the same stores and settings are analyzed together
    groups: dict[tuple, list[dict]] = {}
    for case in dataset["cases"]:
        setting = tuple(case.get(k, defaults.get(k)) for k in ("history_db", "code_db", "aliases", "min_match_score", "graph_depth"))
        groups.setdefault(setting, []).append(case)
    counts, differences = None, []
    for (db, code_db, aliases, score, depth), answers in groups.items():
        for needed, path in (("history_db", db), *[("change_spec", c.get("change_spec")) for c in answers]):
            if not path or not os.path.exists(at(path)):
                raise FileNotFoundError(f"{needed} is not given or not there: {path}")
        a.db, a.code_db, a.aliases = at(db), at(code_db), at(aliases)
        a.min_match_score, a.graph_depth = 1.0 if score is None else float(score), 2 if depth is None else int(depth)
        found = _analyzed(spark, a, {c["id"]: C.load_object(at(c["change_spec"])) for c in answers})
        part = cut(A.answer_counts(found, answers), "replay-counts")
        counts = part if counts is None else counts.unionByName(part)
    overall = R.overall(counts, ["kind"])
    failures = R.threshold_misses(overall, thresholds)
    lists = {n: [r.asDict() for r in df.collect()] for n, df in (("cases", R.with_metrics(counts).orderBy("spec_id", "kind")), ("overall", overall), ("failures", failures))}
    report = {"schema_version": 1, "passed": not lists["failures"], "case_count": len(dataset["cases"]), "thresholds": thresholds}
    write_json(a.output, report | lists)
    print(json.dumps(lists["overall"]))
    return 1 if lists["failures"] else 0


def workspace(spark, a) -> int:
    """Scan a workspace and say what there is to do: new documents, unverified cases, stores that are out of date."""
    state = a.state_dir or os.path.join(a.workspace, ".tracelake")
    os.makedirs(os.path.join(state, "cases"), exist_ok=True)
    at = lambda name: os.path.join(state, name)
    scans, errors = [], []
    for root in a.document_root or [a.workspace]:
        docs, wrong = I.scan_root(spark, root)
        errors += wrong
        if docs is not None:
            scans.append(docs.where(I.in_workspace(F.col("relative_path"), bool(a.document_root), (os.path.basename(state).lower(),))))
    if not scans:
        raise FileNotFoundError("; ".join(errors))
    docs = cut(I.union_roots(scans, fold_case=True), "workspace-scan")
    previous = I.load_manifest(spark, at("manifest.json"))
    cases = [os.path.join(d, f) for d, _, files in os.walk(at("cases")) for f in files if f.endswith((".json", ".jsonl"))]
    found = C.load_revisions(spark, a.revisions) if a.revisions else None
    session_ = H.workspace_status(
        spark, docs, cut(previous, "workspace-previous"), at("cases"), I.load_decisions(spark, at("document-decisions.json")), _url(at("history")), _url(at("code")), found,
        max(map(os.path.getmtime, cases), default=0.0),
    )
    write_manifest(docs, at("manifest.json"), {"workspace": os.path.abspath(a.workspace), "errors": errors})
    write_json(at("session.json"), {"schema_version": 1, "workspace": os.path.abspath(a.workspace), "errors": errors} | session_)
    print(json.dumps(session_ | {"errors": len(errors)}))
    return 2 if errors else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracelake", description=__doc__)
    sub = parser.add_subparsers(required=True)

    def command(name, run, *options):
        p = sub.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for flags, kw in options:
            p.add_argument(flags, **kw)

    need, many = {"required": True}, {"action": "append"}
    depth = [("--min-match-score", {"type": float, "default": 1.0}), ("--graph-depth", {"type": int, "default": 2})]
    command("inventory", inventory, ("--root", need | many), ("--output", need), ("--previous", {}), ("--extension", many), ("--exclude", many))
    command("reconcile", reconcile, ("--cases", need), ("--manifest", need), ("--output", need), ("--dry-run", {"action": "store_true"}))
    command("compile-history", compile_history, ("--cases", need), ("--output", need), ("--manifest", {}))
    command("compile-code", compile_code, ("--input", need), ("--output", need))
    command("analyze", analyze, ("--db", need), ("--change-spec", need), ("--output", need), ("--code-db", {}), ("--aliases", {}), *depth)
    command("replay", replay, ("--dataset", need), ("--output", need))
    command("workspace", workspace, ("--workspace", {"default": "."}), ("--state-dir", {}), ("--document-root", many), ("--revisions", {}))
    args = parser.parse_args(argv)
    try:
        spark = session("tracelake")
        try:
            return args.run(spark, args)
        finally:
            clear(spark)
    except H.Rejected as e:
        print(e, file=sys.stderr)
        return 1
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
