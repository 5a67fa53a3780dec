import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import got
from tracelake.operators import incremental as I
from tracelake.runtime import scratch

ARRIVALS = "kind string, key string, version int, received_at timestamp_ntz, content binary, node string"
RECORDS = "kind string, key string, content binary, level string"
T0 = datetime(2025, 1, 1)


def byte_wise(kind, content, prev):
    return content.eqNullSafe(prev)


def brute(data, starts):
    out, before = set(), None
    for n, start in enumerate(starts):
        state = {}
        for kind, key, version, at, content, _ in data:
            if key is not None and at is not None and at < start:
                rank = (version is not None, version, at, content is not None, content)
                if (kind, key) not in state or rank > state[kind, key][0]:
                    state[kind, key] = (rank, content)
        state = {k: c for k, (_, c) in state.items()}
        if before is not None:
            out |= {(n, *k) for k, c in state.items() if k not in before or before[k] != c}
        before = state
    return sorted(out, key=repr)


def arrivals(seed, n=900):
    rng = random.Random(seed)
    data = [
        (rng.choice(["document", "repository"]), f"k{rng.randrange(250)}", rng.randrange(6), T0 + timedelta(hours=rng.randrange(500)), rng.choice([None, b"a", b"b", b"c"]), "x") for _ in range(n)
    ]
    return data + data[:50] + [("document", None, 1, T0, b"a", ""), ("document", "late", 1, None, b"a", ""), ("document", "k1", 1, T0, None, "")]


@pytest.mark.parametrize("leaf_records", [1, 16, 10_000])
def test_replay_against_brute_force(spark, rows, leaf_records):
    data = arrivals(leaf_records)
    starts = [T0 + timedelta(hours=h) for h in (0, 90, 200, 201, 480, 900)]
    found = I.replay(spark, rows(data, ARRIVALS), starts, byte_wise, scratch(spark, "t"), leaf_records)
    assert got(found) == brute(data, starts)


def test_replay_of_nothing(spark, rows):
    assert got(I.replay(spark, rows([], ARRIVALS), [T0, T0 + timedelta(1)], byte_wise, scratch(spark, "t"))) == []
    assert got(I.replay(spark, rows(arrivals(1, 20), ARRIVALS), [], byte_wise, scratch(spark, "t"))) == []


def tree_of(df, levels, saved=None):
    """The tree over df beside the saved one, both as (level, node, h1, h2, n, segment)."""
    leaves = I.leaf_digests(df.withColumn("key_hash", I.key_hash()), levels)
    old = saved.where(F.col("level") == levels) if saved is not None else None
    return I.tree_above(I._beside(leaves, old, "full" if saved is not None else "left"), levels, saved).withColumn("segment", F.lit(1).cast("long"))


def test_descends_only_where_trees_differ(rows):
    data = [("d", f"k{i}", b"x", "") for i in range(500)]
    old = tree_of(rows(data, RECORDS), 3)
    new = rows([*data[:-1], ("d", "k499", b"y", "")], RECORDS)
    leaves = I.changed_leaves(tree_of(new, 3, old), 3).collect()
    assert len(leaves) == 1
    assert leaves[0].node == new.withColumn("key_hash", I.key_hash()).where("key = 'k499'").select(I.node_at(3)).first()[0]
    assert I.changed_leaves(tree_of(rows(data, RECORDS).orderBy(F.rand()), 3, old), 3).count() == 0


def test_updating_gives_the_tree_built_anew(rows):
    """A tree brought up to date from touched leaves only is the tree built over all records."""
    data = [("d", f"k{i}", b"x", "") for i in range(300)]
    old = tree_of(rows(data, RECORDS), 2)
    changed = data[5:] + [("d", "new", None, "")]
    columns = ["level", "node", "h1", "h2", "n"]
    anew, updated = tree_of(rows(changed, RECORDS), 2), tree_of(rows(changed, RECORDS), 2, old)
    assert got(updated.where("n > 0"), *columns) == got(anew, *columns)
    assert got(old.where("level = 0"), "n") == [(300,)]


def test_rows_come_through_the_tree(spark, rows, monkeypatch):
    """Records are found in the leaves that the comparison reaches, and nowhere else."""
    data = arrivals(3)
    starts = [T0 + timedelta(hours=h) for h in (0, 90, 200)]
    whole = I.changed_leaves
    monkeypatch.setattr(I, "changed_leaves", lambda tree, levels: whole(tree, levels).where("node % 2 = 0"))
    half = got(I.replay(spark, rows(data, ARRIVALS), starts, byte_wise, scratch(spark, "t"), 4))
    assert set(half) < set(brute(data, starts)) and half
    monkeypatch.setattr(I, "changed_leaves", lambda tree, levels: whole(tree, levels).limit(0))
    assert got(I.replay(spark, rows(data, ARRIVALS), starts, byte_wise, scratch(spark, "t"), 4)) == []


def test_late_rows_and_growth(spark, rows, monkeypatch):
    """Rows of an older version do not undo a newer one, whatever segments are merged and however the tree grows."""
    monkeypatch.setattr(I, "MAX_SEGMENTS", 2)
    folder = scratch(spark, "late")
    row = lambda k, v, h, c: ("d", k, v, T0 + timedelta(hours=h), c, "")
    run = lambda no, data: got(I.run_arrivals(spark, rows(data, ARRIVALS), folder, no, leaf_records=1), "key", "is_new")
    assert run(1, [row("a", 1, 0, b"1"), row("b", 1, 0, b"1")]) == [("a", True), ("b", True)]
    assert run(2, [row("a", 3, 5, b"3"), row("b", 2, 5, b"1")]) == [("a", False)]
    assert run(3, [row("a", 2, 9, b"2"), row("b", 1, 9, b"9")]) == []
    assert len(run(4, [row(f"n{i}", 1, 10, b"1") for i in range(700)])) == 700
    assert run(5, [row("n5", 1, 10, b"1"), row("a", 3, 11, b"4")]) == [("a", False)]
    assert run(6, []) == []
    about = I.Store(spark, folder).current()
    assert about["records"] == 702 and len(about["segments"]) <= 3 and about["levels"] > 1


def test_what_a_run_writes_is_in_proportion_to_the_change(spark, rows):
    folder = scratch(spark, "small")
    data = [("d", f"k{i}", b"1", "") for i in range(3000)]
    I.run_once(spark, rows(data, RECORDS), folder, 1)
    I.run_once(spark, rows([*data[1:], ("d", "k0", b"2", "")], RECORDS), folder, 2)
    store = I.Store(spark, folder)
    segment = store.current()["segment"]
    assert 0 < store.read([segment], "state").count() < 100 and store.read([segment], "tree").count() <= 5
    # records that are gone leave the state, and are new when they come back
    I.run_once(spark, rows(data[10:], RECORDS), folder, 3)
    assert I.run_once(spark, rows(data[5:], RECORDS), folder, 4).where("is_new").count() == 5


def test_old_versions_are_removed(spark, rows, monkeypatch):
    monkeypatch.setattr(I, "MAX_SEGMENTS", 2)
    folder = scratch(spark, "clean")
    for no in range(6):
        I.run_once(spark, rows([("d", "k", str(no).encode(), "")], RECORDS), folder, no)
    store = I.Store(spark, folder)
    kept = store._fs.listStatus(store._path(f"{folder}/state"))
    assert len(kept) <= 4
    assert [r.key for r in store.read([store.commits()[0][1]["segment"]], "output").collect()] == ["k"]


def test_runs_survive_failures(spark, rows):
    folder = scratch(spark, "runs")
    data = {f"k{i}": b"1" for i in range(60)}
    table = lambda: rows([("d", k, v, "") for k, v in data.items()] + [("d", None, b"", "")], RECORDS)
    assert I.run_once(spark, table(), folder, 1).count() == 60
    data["k5"] = b"2"
    data["new"] = None
    del data["k6"]

    def fails(changed):
        changed.count()
        raise OSError("disk full")

    with pytest.raises(OSError):
        I.run_once(spark, table(), folder, 2, fails)
    # nothing was published, so nothing is lost
    assert got(I.run_once(spark, table(), folder, 2), "key", "is_new") == [("k5", False), ("new", True)]
    # a run that was published is not done again, whatever the table has become
    data["k7"] = b"9"
    assert got(I.run_once(spark, table(), folder, 2), "key") == [("k5",), ("new",)]
    assert got(I.run_once(spark, table(), folder, 3), "key") == [("k7",)]
    assert got(I.run_once(spark, table(), folder, 4)) == []
    assert [about["run_id"] for _, about in I.Store(spark, folder).commits()] == [1, 2, 3, 4]


def test_tree_grows_with_the_table(spark, rows):
    folder = scratch(spark, "runs")
    small = [("d", f"k{i}", b"1", "") for i in range(20)]
    I.run_once(spark, rows(small, RECORDS), folder, "a", leaf_records=1)
    large = small + [("d", f"n{i}", b"1", "") for i in range(6000)]
    assert I.run_once(spark, rows(large, RECORDS), folder, "b", leaf_records=1).count() == 6000


def test_one_commit_number_has_one_writer(spark):
    store = I.Store(spark, scratch(spark, "s"))
    store.publish(store.stage(), {"run_id": 1})
    other = I.Store(spark, store.folder)
    other._files = lambda: []
    with pytest.raises(RuntimeError):
        other.publish(other.stage(), {"run_id": 2})


def test_run_log(rows):
    log = rows([(2, T0, "succeeded"), (2, T0, "succeeded"), (1, T0 - timedelta(1), "Succeeded "), (3, T0, "failed"), (4, None, "succeeded")], "run_id int, started_at timestamp_ntz, status string")
    assert [r for r, _ in I.run_starts(log)] == [1, 2]
