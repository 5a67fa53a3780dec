"""Processing only new or changed records, found with a Merkle tree over key ranges.

A record is (kind, key, content). Its key hash places it in a leaf, the range of hashes
that share the first 4 * levels bits, so leaves are even whatever the keys are. A leaf's
digest covers its records, an inner node's digest its children.

A run hashes the leaves it has new records for and carries their digests up to the root,
beside the digests that were saved. From the root down, only children of nodes that
differ are looked at; records are read from the saved state, and compared one by one, only
in the leaves that are reached.

State and tree are kept as segments: a run adds one with the leaves it has touched, whole, and
the nodes above them. The newest row of a node counts, and a leaf's records are in the segment
of its newest row. What a run writes is in proportion to what it touches; where segments are
many, or most of what they hold is outdated, the run takes in the whole state and its segment
replaces all others.

Output, state and tree are published together: they are written under a name of their own,
and a small commit file with the next number, which only one writer can create, makes them
current. A run that fails before that leaves the previous version current, so the next run
finds the same changes again; a run that was published is not done a second time.
"""

from __future__ import annotations

import json
import math
import os
import random
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.runtime import cut

FAN_BITS = 4
#: Records a leaf should hold on average.
LEAF_RECORDS = 4
#: Arrivals as a share of the saved records from which a run takes in the whole state: nearly every leaf is touched then.
MANY_ARRIVALS = 0.25
MAX_LEVELS = 12
#: Segments of state and tree, and rows in segments to one row that counts, before one segment replaces them.
MAX_SEGMENTS = 8
MAX_ROWS = 3
#: Age from which a segment that no commit names is taken for the rest of a failed run.
ORPHAN_HOURS = 24
#: A saved node: its digests and the records below it, the same before the run, the segment a leaf was in before, its own segment.
NODE = "level int, node bigint, h1 bigint, h2 bigint, n bigint, o1 bigint, o2 bigint, o_n bigint, o_segment bigint, segment bigint"


def levels_for(records: int, leaf_records: int = LEAF_RECORDS) -> int:
    """Depth of a tree over so many records: 16-way nodes, leaf_records to a leaf on average."""
    return min(MAX_LEVELS, max(1, math.ceil(math.log(max(records / leaf_records, 2), 2) / FAN_BITS)))


def key_hash() -> Column:
    return F.xxhash64("kind", "key")


def node_at(level: int, hash_col: str = "key_hash") -> Column:
    return F.shiftrightunsigned(F.col(hash_col), 64 - FAN_BITS * level) if level else F.lit(0).cast("long")


def leaf_digests(records: DataFrame, levels: int) -> DataFrame:
    """(node, h1, h2, n) of the leaves that have records (kind, key, content, key_hash).

    A digest is two 64-bit sums without carry over differently seeded record hashes, with
    the record count; it does not depend on order.
    """
    return records.groupBy(node_at(levels).alias("node")).agg(
        F.bit_xor(F.xxhash64("kind", "key", "content")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), "content", "key", "kind")).alias("h2"),
        F.count(F.lit(1)).alias("n"),
    )


def node_at_leaf(levels: int, level: int) -> Column:
    """The node of this level above the leaf node."""
    return F.shiftrightunsigned("node", FAN_BITS * (levels - level)) if level else F.lit(0).cast("long")


def _beside(now: DataFrame, saved: DataFrame | None, how: str = "left", on: list[str] | None = None) -> DataFrame:
    """(*on, h1, h2, n, o1, o2, o_n, o_segment): digests now and as saved; a node that is not there has n 0 and digests 0."""
    on = on or ["node"]
    if saved is None:
        old = [F.lit(0).cast("long").alias(c) for c in ("o1", "o2", "o_n")]
        return now.select(*on, "h1", "h2", "n", *old, F.lit(None).cast("long").alias("o_segment"))
    was = saved.select(*on, F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("n").alias("o_n"), F.col("segment").alias("o_segment"))
    return now.join(was, on, how).select(*on, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("h1", "h2", "n", "o1", "o2", "o_n")], "o_segment")


def differs() -> Column:
    return (F.col("h1") != F.col("o1")) | (F.col("h2") != F.col("o2")) | (F.col("n") != F.col("o_n"))


def tree_above(leaves: DataFrame, levels: int, saved: DataFrame | None) -> DataFrame:
    """(level, node, h1, h2, n, o1, o2, o_n, o_segment): leaves (see _beside) and all nodes above them.

    A node's digest is the sum without carry of its children's, where a leaf counts with
    the hash of its place and digest. So all levels come from one aggregation, and a node is
    brought up to date from the leaves that were touched; the others are not read.
    """
    there = lambda n, *parts: F.when(F.col(n) > 0, F.xxhash64(*parts)).otherwise(F.lit(0).cast("long"))
    second = F.lit("second")
    moved = leaves.select(
        there("n", "node", "h1", "h2", "n").bitwiseXOR(there("o_n", "node", "o1", "o2", "o_n")).alias("d1"),
        there("n", second, "n", "h2", "h1", "node").bitwiseXOR(there("o_n", second, "o_n", "o2", "o1", "node")).alias("d2"),
        (F.col("n") - F.col("o_n")).alias("d_n"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("level"), node_at_leaf(levels, k).alias("node")) for k in range(levels)])).alias("up"),
    )
    now = moved.groupBy("up.level", "up.node").agg(F.bit_xor("d1").alias("h1"), F.bit_xor("d2").alias("h2"), F.sum("d_n").alias("n"))
    both = _beside(now, saved.where(F.col("level") < levels) if saved is not None else None, on=["level", "node"])
    above = both.select(
        "level", "node", F.col("h1").bitwiseXOR(F.col("o1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("o2")).alias("h2"),
        (F.col("n") + F.col("o_n")).alias("n"), "o1", "o2", "o_n", F.lit(None).cast("long").alias("o_segment"),
    )
    return above.unionByName(leaves.withColumn("level", F.lit(levels)).select(above.columns))


def changed_leaves(tree: DataFrame, levels: int) -> DataFrame:
    """(node, o_segment): the leaves of tree (NODE) that differ from what was saved, found from the root down."""
    front = tree.where((F.col("level") == 0) & differs()).select("node")
    for level in range(1, levels + 1):
        below = tree.where((F.col("level") == level) & differs()).select("node", "o_segment", node_at_leaf(level, level - 1).alias("up"))
        front = below.join(front.select(F.col("node").alias("up")), "up", "left_semi").select("node", "o_segment")
    return front


class Store:
    """Segments of state, tree and output in a folder all executors share, and the commits that make them current."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def stage(self) -> int:
        """The name of a new segment: greater than those of published ones, and no other writer's."""
        return (max((n for n, _ in self._files()), default=0) + 1) << 40 | random.getrandbits(40)

    def _at(self, name: str, segment: int) -> str:
        return f"{self.folder}/{name}/segment={segment}"

    def write(self, segment: int, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self._at(name, segment))
        return self.read([segment], name, df.schema)

    def read(self, segments: list[int], name: str, schema: StructType | str | None = None) -> DataFrame:
        """The rows of segments, with the column `segment`; one scan, so its plan is the same however many there are."""
        reader = self.spark.read.option("basePath", f"{self.folder}/{name}")
        if isinstance(schema, StructType):
            # a copy, as add() changes the schema it is called on
            schema = StructType([f for f in schema.fields if f.name != "segment"]).add("segment", "long")
        return (reader.schema(schema) if schema else reader).parquet(*[self._at(name, s) for s in segments])

    def publish(self, segment: int, about: dict) -> None:
        """Make segment current: its commit file gets the next number, which only one writer can create."""
        number = max((n for n, _ in self._files()), default=0) + 1
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))
        if not self._create(f"{self.folder}/commits/{number:012d}.json", json.dumps(about | {"segment": segment})):
            raise RuntimeError(f"another run published commit {number} first")

    def _create(self, target: str, body: str) -> bool:
        """Create the file target, unless it is there; whether it was created.

        A local file is linked into place, which fails where the name is taken. Elsewhere the
        file is created exclusively: HDFS does that at once, object stores by a conditional put.
        """
        path = self._path(target)
        if self._fs.getUri().getScheme() == "file":
            local = path.toUri().getPath()
            draft = f"{local}.{uuid.uuid4().hex}.tmp"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(body)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, local)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        try:
            out = self._fs.createFile(path).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build()
            out.write(bytearray(body.encode()))
            out.close()
        except Py4JJavaError:
            if self._fs.exists(path):
                return False
            raise
        return True

    def _files(self) -> list[tuple[int, object]]:
        home = self._path(f"{self.folder}/commits")
        if not self._fs.exists(home):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in self._fs.listStatus(home)]
        return sorted(((int(n[:-5]), p) for n, p in names if n.endswith(".json") and n[:-5].isdigit()), key=lambda x: x[0])

    def commits(self) -> list[tuple[int, dict]]:
        """(number, what publish was told) of all published versions, oldest first. A file that is not whole is no commit."""
        out = []
        for number, path in self._files():
            stream = self._fs.open(path)
            body = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                out.append((number, json.loads(body)))
            except ValueError:
                continue
        return out

    def current(self) -> dict | None:
        commits = self.commits()
        return commits[-1][1] if commits else None

    def clean(self, keep: int = 2) -> None:
        """Delete state and tree that the last commits do not name, and what runs that failed long ago left. Outputs stay."""
        commits = [about for _, about in self.commits()]
        last = commits[-keep:]
        used = {"state": {s[0] for c in last for s in c.get("segments", [])}, "tree": {t for c in last for t in c.get("trees", [])}}
        known, now = {c["segment"] for c in commits}, time.time()
        for name in ("state", "tree", "output"):
            home = self._path(f"{self.folder}/{name}")
            for status in self._fs.listStatus(home) if self._fs.exists(home) else []:
                segment = int(status.getPath().getName().partition("=")[2])
                old = now - status.getModificationTime() / 1000 > ORPHAN_HOURS * 3600
                if old if segment not in known else name != "output" and segment not in used[name]:
                    self._fs.delete(status.getPath(), True)


class _Run:
    """One run over a store: the saved state and tree it starts from, and what it publishes."""

    def __init__(self, spark: SparkSession, folder: str, leaf_records: int):
        self.store, self.leaf_records = Store(spark, folder), leaf_records
        self.commits = self.store.commits()
        self.last = self.commits[-1][1] if self.commits else None
        self.segment = self.store.stage()
        self.levels = self.last["levels"] if self.last else 0
        #: [segment, rows it holds, rows of them that count], oldest first.
        self.segments = self.last["segments"] if self.last else []
        self.trees = self.last["trees"] if self.last else []
        live = sum(s[2] for s in self.segments)
        #: Whether the whole state is taken in.
        self.whole = len(self.trees) >= MAX_SEGMENTS or sum(s[1] for s in self.segments) > MAX_ROWS * max(live, 1)

    def done(self, run_id: int | str) -> DataFrame | None:
        for _, about in self.commits:
            if about["run_id"] == run_id:
                return self.store.read([about["segment"]], "output").drop("segment")
        return None

    def nodes(self) -> DataFrame | None:
        """The saved tree: of each node the newest row; nodes without records are not there."""
        if not self.trees:
            return None
        newest = self.store.read(self.trees, "tree", NODE).groupBy("level", "node").agg(F.max(F.struct("segment", "h1", "h2", "n")).alias("x"))
        return newest.where("x.n > 0").select("level", "node", "x.*")

    def records(self, schema: StructType, leaves: DataFrame | None = None) -> DataFrame:
        """The saved records, of leaves (node, segment) where that is given, with their node; each leaf is read from its segment."""
        rows = self.store.read([s[0] for s in self.segments], "state", schema).withColumn("node", node_at(self.levels))
        if leaves is None and any(s[1] > s[2] for s in self.segments):
            leaves = self.saved_leaves(self.nodes())
        if leaves is not None:
            rows = rows.join(leaves, ["node", "segment"], "left_semi")
        return rows.drop("segment")

    def saved_leaves(self, saved: DataFrame) -> DataFrame:
        return saved.where(F.col("level") == self.levels).select("node", "segment")

    def differing(self, tree: DataFrame) -> DataFrame:
        """The leaves that differ, written out: where they are few, Spark sends them to the records and moves none."""
        return cut(changed_leaves(tree, self.levels), "leaves")

    def grow(self, schema: StructType) -> None:
        """A deeper tree where the table has outgrown it: the saved state is written as one segment with a tree of its own."""
        fitting = levels_for(self.last["records"], self.leaf_records)
        if fitting <= self.levels + 1:
            return
        base = self.store.write(self.segment, "state", self.records(schema).drop("node")).drop("segment")
        self.levels = fitting
        self.add_tree(_beside(leaf_digests(base, self.levels), None), None)
        self.segments, self.trees, self.whole = [[self.segment, self.last["records"], self.last["records"]]], [self.segment], True
        self.segment += 1

    def add_tree(self, leaves: DataFrame, saved: DataFrame | None) -> DataFrame:
        return self.store.write(self.segment, "tree", tree_above(leaves, self.levels, saved))

    def changed(self, now: DataFrame, leaves: DataFrame, same: Callable[[Column, Column, Column], Column] | None) -> DataFrame:
        """(kind, key, content, is_new): the records of now in leaves that the saved state does not have or has otherwise."""
        now = now.withColumn("node", node_at(self.levels)).join(leaves, "node", "left_semi")
        if not self.segments:
            return now.select("kind", "key", "content", F.lit(True).alias("is_new"))
        old = self.records(now.drop("node").schema, leaves.select("node", F.col("o_segment").alias("segment")))
        old = old.select("key_hash", "kind", "key", F.col("content").alias("prev"), F.lit(True).alias("had"))
        both = now.join(old, ["key_hash", "kind", "key"], "left")
        equal = same(F.col("kind"), F.col("content"), F.col("prev")) if same else F.col("content").eqNullSafe(F.col("prev"))
        return both.where(F.col("had").isNull() | ~equal).select("kind", "key", "content", F.col("had").isNull().alias("is_new"))

    def publish(self, run_id: int | str, tree: DataFrame, output: DataFrame) -> DataFrame:
        output = self.store.write(self.segment, "output", output).drop("segment")
        # as many rows as there are segments
        counts = tree.where(F.col("level") == self.levels).groupBy("o_segment").agg(F.sum("n").alias("n"), F.sum("o_n").alias("o_n")).collect()
        own, outdated = sum(r.n for r in counts), {r.o_segment: r.o_n for r in counts}
        segments = [] if self.whole else [[s, rows, live - outdated.get(s, 0)] for s, rows, live in self.segments]
        segments = [s for s in segments if s[2] > 0] + [[self.segment, own, own]]
        about = {
            "run_id": run_id, "levels": self.levels, "records": sum(s[2] for s in segments),
            "segments": segments, "trees": [*([] if self.whole else self.trees), self.segment],
        }
        self.store.publish(self.segment, about)
        self.store.clean()
        return output


def run_arrivals(
    spark: SparkSession,
    arrivals: DataFrame,
    folder: str,
    run_id: int | str,
    process: Callable[[DataFrame], DataFrame] | None = None,
    same: Callable[[Column, Column, Column], Column] | None = None,
    leaf_records: int = LEAF_RECORDS,
) -> DataFrame:
    """Process the records whose state is new or changed by what arrived since the last published run.

    arrivals: kind, key, version, received_at, content; other columns are ignored. Of a
    record's rows, those of earlier runs too, the one with the greatest (version,
    received_at) is its state (ties: the greater content), so a late row does not undo a
    newer one. Returns the published output: process(changed), where changed has kind, key,
    content and is_new. same(kind, content, prev) tells whether two contents are the same;
    without it they are compared null-safe. Rows without key are left out; a record that
    does not arrive keeps its state. No arrivals publish an empty run. A run_id that is
    already published is not done again; its output is returned.
    """
    run = _Run(spark, folder, leaf_records)
    done = run.done(run_id)
    if done is not None:
        return done
    rank = ["version", "received_at", "content"]
    best = lambda df: df.groupBy("kind", "key", "key_hash").agg(F.max(F.struct(*rank)).alias("x")).select("kind", "key", "key_hash", "x.*")
    state = arrivals.where(F.col("key").isNotNull()).withColumn("key_hash", key_hash()).select("kind", "key", "key_hash", *rank)
    if run.last:
        run.grow(state.schema)
    saved = run.nodes()
    if run.last:
        run.whole = run.whole or state.count() >= MANY_ARRIVALS * run.last["records"]
        leaves = None
        if not run.whole:
            leaves = run.saved_leaves(saved).join(state.select(node_at(run.levels).alias("node")), "node", "left_semi")
        state = run.records(state.schema, leaves).drop("node").unionByName(state)
    state = run.store.write(run.segment, "state", best(state)).drop("segment")
    if not run.last:
        run.levels = levels_for(state.count(), leaf_records)
    old = saved.where(F.col("level") == run.levels) if saved is not None else None
    tree = run.add_tree(_beside(leaf_digests(state, run.levels), old), saved)
    changed = run.changed(state, run.differing(tree), same)
    return run.publish(run_id, tree, process(changed) if process else changed)


def run_once(
    spark: SparkSession,
    records: DataFrame,
    folder: str,
    run_id: int | str,
    process: Callable[[DataFrame], DataFrame] | None = None,
    same: Callable[[Column, Column, Column], Column] | None = None,
    leaf_records: int = LEAF_RECORDS,
) -> DataFrame:
    """Process the records (kind, key, content) of a whole table that are new or changed since the last published run.

    The table is read and hashed; of the saved state only leaves that differ are read, and
    written anew. Returns the published output, see run_arrivals. (kind, key) must be
    unique; records without key are left out. Records that are gone are no work, but leave
    the saved state. An empty table publishes an empty run.
    """
    run = _Run(spark, folder, leaf_records)
    done = run.done(run_id)
    if done is not None:
        return done
    records = records.where(F.col("key").isNotNull()).select("kind", "key", "content").withColumn("key_hash", key_hash())
    if run.last:
        run.grow(records.schema)
    else:
        run.levels = levels_for(records.count(), leaf_records)
    saved = run.nodes()
    old = saved.where(F.col("level") == run.levels) if saved is not None else None
    both = _beside(leaf_digests(records, run.levels), old, "full")
    tree = run.add_tree(both if run.whole else both.where(differs()), saved)
    leaves = run.differing(tree)
    if not run.whole:
        records = records.withColumn("node", node_at(run.levels)).join(leaves, "node", "left_semi").drop("node")
    state = run.store.write(run.segment, "state", records).drop("segment")
    changed = run.changed(state, leaves, same)
    return run.publish(run_id, tree, process(changed) if process else changed)


# ---- a log of runs, replayed ------------------------------------------------------------


def run_starts(runs: DataFrame) -> list[tuple[int, object]]:
    """(run_id, started_at) of the distinct succeeded runs, in order of their start.

    The run log is read to the driver; it has one line per run of the pipeline. Runs
    without a start are left out.
    """
    rows = (
        runs.where((F.lower(F.trim("status")) == "succeeded") & F.col("started_at").isNotNull())
        .select("run_id", "started_at").distinct().orderBy("started_at", "run_id").collect()
    )
    return [(r.run_id, r.started_at) for r in rows]


def replay(
    spark: SparkSession,
    arrivals: DataFrame,
    starts: list[object],
    same: Callable[[Column, Column, Column], Column],
    folder: str,
    leaf_records: int = LEAF_RECORDS,
) -> DataFrame:
    """(run_no, kind, key) to process in each run after the first: run_arrivals for one start after the other.

    A run sees the rows received before its start and takes those received since the start
    before it. Rows without key or received_at are left out. Arrivals are placed by run
    once, so a run reads its own only.
    """
    bounds = F.array(*[F.lit(s) for s in starts]) if starts else F.array().cast("array<timestamp_ntz>")
    seen = arrivals.where(F.col("key").isNotNull() & F.col("received_at").isNotNull()).select(
        "kind", "key", "version", "received_at", "content", F.size(F.filter(bounds, lambda s: s <= F.col("received_at"))).alias("run_no")
    )
    if not starts:
        return seen.limit(0).select("run_no", "kind", "key")
    placed = cut(seen.where(F.col("run_no") < len(starts)), "arrivals", ["run_no"])
    found = []
    for no in range(len(starts)):
        # the first run has no run before it: what it finds is taken as known
        process = lambda changed, no=no: (changed if no else changed.limit(0)).select(F.lit(no).alias("run_no"), "kind", "key")
        found.append(run_arrivals(spark, placed.where(F.col("run_no") == no), folder, no, process, same, leaf_records))
    return reduce(DataFrame.unionByName, found[1:], found[0])
