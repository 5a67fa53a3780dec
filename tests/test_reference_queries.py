"""Queries of the library's operators over hand-made tables."""

import pytest

from tests.conftest import got
from tracelake.plans import reference_queries as Q


@pytest.fixture
def folder(rows, tmp_path):
    """folder(name=(data, schema), ...) -> a folder with these tables"""

    def write(**tables):
        for name, (data, schema) in tables.items():
            rows(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_replay_evidence_compares_all_cases(spark, folder):
    cases = [(f"case-{i}", "trade") for i in range(10)]
    scenarios = [(f"case-{i}", "Frozen", "trusted" if i < 4 else "candidate") for i in range(9)] + [("case-9", "frozen", "rejected"), ("case-2", None, "trusted"), ("case-2", "Other", "candidate")]
    d = folder(cases=(cases * 2, "case_id string, domain string"), scenarios=(scenarios, "case_id string, name string, knowledge_tier string"))
    assert got(Q.r_replay_evidence(spark, d), "replay_id", "tp", "fp", "fn") == [("trade", 4, 0, 5)]


def test_code_is_walked_two_hops(spark, folder):
    pairs = [("Wallet-core", "order-core"), ("order-core", " wallet-core"), ("order-core", "ship-core"), ("tax-core", "ship-core"), ("order-core", "x-audit"), ("x-audit", "far-core")]
    d = folder(service_cochange=(pairs, "service_a string, service_b string"))
    hops = [(1, "wallet-core", "order-core"), (2, "order-core", "ship-core"), (2, "order-core", "wallet-core"), (2, "order-core", "x-audit")]
    assert got(Q.r_code_paths(spark, d), "spec_id", "depth", "source_id", "target_id") == [("code", *hop) for hop in hops]
    assert got(Q.r_code_services(spark, d)) == [("code", name, name, 1, 1) for name in ("order-core", "ship-core", "wallet-core")]
