import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import got
from tracelake.functions.digests import digest_value, same_commit
from tracelake.operators import snapshots

ROWS = "grp string, snapshot_no int, key string, content binary, received_at timestamp_ntz, stripe string"
DELIVERIES = "grp string, snapshot_no int, status string, delivered_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


def brute(data, deliveries):
    latest = {}
    for g, n, k, c, t, _ in data:
        if g is not None and k is not None and ((g, n, k) not in latest or (t, c or b"") > latest[g, n, k][:2]):
            latest[g, n, k] = (t, c or b"", c)
    state = {}
    for g, n, s, t in deliveries:
        if (g, n) not in state or (t, s) > state[g, n]:
            state[g, n] = (t, s)
    out = set()
    for g in {g for g, _ in state}:
        done = sorted(n for (x, n), (_, s) in state.items() if x == g and s == "complete")
        for a, b in zip(done, done[1:], strict=False):
            old = {k: c for (x, n, k), (_, _, c) in latest.items() if (x, n) == (g, a)}
            new = {k: c for (x, n, k), (_, _, c) in latest.items() if (x, n) == (g, b)}
            out |= {(g, b, k, "added") for k in new.keys() - old.keys()} | {(g, b, k, "removed") for k in old.keys() - new.keys()}
            out |= {(g, b, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return sorted(out, key=repr)


def test_against_brute_force(rows):
    rng = random.Random(5)
    groups, keys = ["a", "b", "hot"], [f"k{i}" for i in range(150)]
    data = []
    for g in groups:
        for n in range(1, 6):
            for k in keys:
                for _ in range(rng.choice([0, 1, 1, 1, 2])):
                    content = rng.choice([None, b"x", b"y", k.encode()])
                    data.append((g, n, k, content, T0 + timedelta(minutes=rng.randrange(10_000)), "clash"))
    data += [data[0], (None, 1, "k1", b"x", T0, ""), ("a", 1, None, b"x", T0, "")] + [("hot", 2, "k3", b"z", T0 + timedelta(days=90), "")] * 200
    deliveries = [(g, n, rng.choice(["complete", "complete", "complete", "incomplete", "missing"]), T0) for g in groups for n in range(1, 7)]
    deliveries += [deliveries[0], ("a", 7, "complete", T0)]
    # a complete delivery without rows removes all
    assert got(snapshots.snapshot_changes(rows(data, ROWS), rows(deliveries, DELIVERIES), stripe_keys=20)[0]) == brute(data, deliveries)
    assert got(snapshots.snapshot_changes(rows(data, ROWS), rows(deliveries, DELIVERIES))[0]) == brute(data, deliveries)


def test_empty(rows):
    none = rows([], ROWS)
    assert got(snapshots.snapshot_changes(none, rows([("a", 1, "complete", T0)], DELIVERIES))[0]) == []
    assert got(snapshots.snapshot_changes(none, rows([], DELIVERIES))[0]) == []


def test_ordinals_persist_when_a_group_grows(rows):
    schema = "grp string, key string"
    first = snapshots.extend_dictionary(rows([("a", f"k{i}") for i in range(8)] * 2 + [("a", None), (None, "x")], schema), None, 4)
    saved = got(first)
    assert len(saved) == 8 and {r[1] for r in saved} <= {0, 1}
    assert all(sorted(r[3] for r in saved if r[1] == stripe) == list(range(sum(r[1] == stripe for r in saved))) for stripe in (0, 1))
    later = snapshots.extend_dictionary(rows([("a", f"k{i}") for i in range(4, 40)] + [("b", "q")], schema), rows(saved, "grp string, stripe int, key string, ordinal int"), 4)
    kept = got(later)
    assert set(saved) < set(kept) and len(kept) == 41 and len({(r[0], r[2]) for r in kept}) == 41
    # no two keys share a place
    assert len({(r[0], r[1], r[3]) for r in kept}) == 41
    assert ("b", 0, "q", 0) in kept


def test_calls_over_a_saved_dictionary(rows):
    rng = random.Random(8)
    data = [("g", n, f"k{k}", rng.choice([b"x", b"y"]), T0, "") for n in range(1, 7) for k in range(60 * n) if rng.random() < 0.8]
    deliveries = [("g", n, "complete", T0) for n in range(1, 7)]
    early = [r for r in data if r[1] <= 2]
    _, saved = snapshots.snapshot_changes(rows(early, ROWS), rows(deliveries[:2], DELIVERIES), None, 16)
    changes, after = snapshots.snapshot_changes(rows(data, ROWS), rows(deliveries, DELIVERIES), saved, 16)
    assert got(changes) == brute(data, deliveries)
    assert set(got(saved)) < set(got(after))


def test_bitmaps_are_compressed_and_decide(rows, monkeypatch):
    """Full words are not stored, and rows come through the bitmaps."""
    schema = "grp string, stripe int, ordinal int, seq int, n_seq int, content binary"
    data = [("g", 0, o, 0, 1, b"x") for o in [*range(128), 200, 1500]]
    chunks = {r.chunk: r for r in snapshots.snapshot_chunks(rows(data, schema)).collect()}
    assert (chunks[0].present, chunks[0].full, chunks[0].words) == (0b1011, 0b11, [1 << 8])
    assert (chunks[1].present, chunks[1].full, len(chunks[1].vec)) == (1 << 7, 0, 1)
    data = [("a", n, f"k{k}", b"x", T0, "") for n in (1, 2) for k in range(100) if (n + k) % 3]
    tables = rows(data, ROWS), rows([("a", 1, "complete", T0), ("a", 2, "complete", T0)], DELIVERIES)
    monkeypatch.setattr(snapshots, "_word", lambda *_: "0L")
    assert got(snapshots.snapshot_changes(*tables)[0]) == []


def test_digests(rows):
    hexes = "0123456789abcdef" * 4
    spelled = [hexes, hexes.upper(), f"sha256:{hexes}", f"SHA-256={hexes.upper()}", f" {hexes}\n", ":".join(hexes[i : i + 2] for i in range(0, 64, 2))]
    df = rows([(s,) for s in [*spelled, None, "", "sha256", hexes[1:]]], "s string").select(digest_value("s").alias("v"))
    values = [None if r.v is None else bytes(r.v) for r in df.collect()]
    assert set(values[:6]) == {bytes.fromhex(hexes)}
    assert values[6] is None and values[7] == b"" and values[8] == b"sha256" and values[9] != values[0]


def test_same_commit(rows):
    pairs = [("abc1234", "ABC1234def", True), ("abc", "abd", False), (None, None, True), (None, "a", False), ("", "", True), ("", "a", False), (" abc", "abc ", True)]
    df = rows([p[:2] for p in pairs], "a string, b string").select(same_commit(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [p[2] for p in pairs]
