"""All pairs of set-valued records whose Jaccard similarity reaches a threshold.

Pigeonhole partitioning. Sets of similar length share a band; a band splits the token
universe into segments, frequent tokens into one and all others by hash into the rest.
Two sets that are similar enough differ in at most U tokens, so if a probe allots v_i + 1
to segment i and the allotments exceed U in sum, some segment differs in at most v_i
tokens. v_i is -1 (segment not used), 0 (segments are equal) or 1 (equal after deleting at
most one token from one side). Every set is indexed under all segments and all their
one-deletion variants; as a probe, it chooses the allotment that should meet the fewest
sets, judged by token frequencies, so signatures of frequent tokens or of empty segments
are avoided wherever rarer ones suffice.

A signature is the sum of its tokens' hashes, so one without a token costs one subtraction.
It travels with the set's number, size and a 64-bit sketch only: the bits in which two
sketches differ are no more than the tokens in which the sets do, so nearly all pairs that
meet by chance are dropped there. Sets are fetched for the pairs left, and compared exactly.

Equal sets are one class and take part once; hot signatures left over are split by the
adaptive skew join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.runtime import cut

#: A token in more than this share of the sets counts as frequent.
FREQUENT = 0.004
#: Segments beyond the fewest that suffice; they give probes a choice.
EXTRA_SEGMENTS = 5
#: Growth of the lengths within one band.
BAND = 1.08


def overlap_needed(a: int, b: int, threshold: float) -> int:
    """Common tokens that sets of a and b tokens need for the threshold."""
    return math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def most_different(a: int, b: int, threshold: float) -> int:
    """Greatest size of the symmetric difference of such sets."""
    return a + b - 2 * overlap_needed(a, b, threshold)


def band_of(size: int) -> int:
    """Number of the band; each of the short lengths is a band of its own."""
    return size if size < 1 / (BAND - 1) else math.floor(math.log(size * (BAND - 1), BAND)) + math.ceil(1 / (BAND - 1))


class Bands:
    """Lengths and segment numbers of bands, for one threshold."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self._known: dict[int, tuple[int, int, int]] = {}

    def lengths(self, band: int) -> tuple[int, int, int]:
        """(least length, greatest length, segments) of the band."""
        if band not in self._known:
            low = band
            if band >= 1 / (BAND - 1):
                low = max(1, math.floor(BAND ** (band - math.ceil(1 / (BAND - 1))) / (BAND - 1)) - 2)
            while band_of(low) < band:
                low += 1
            high = low
            while band_of(high + 1) == band:
                high += 1
            shortest = math.ceil(self.threshold * low - 1e-9)
            worst = max(most_different(high, s, self.threshold) for s in range(max(1, shortest), high + 1))
            worst = max(worst, most_different(low, max(1, shortest), self.threshold))
            self._known[band] = low, high, (worst + 2) // 2 + EXTRA_SEGMENTS
        return self._known[band]

    def partners(self, size: int) -> range:
        """Bands of the sets that are as long or longer and can be similar."""
        return range(band_of(size), band_of(math.floor(size / self.threshold + 1e-9)) + 1)


_MASK = (1 << 64) - 1


def _segments(tokens: list[int], frequent: list[bool], count: int) -> list[list[int]]:
    """Places of the tokens of each segment: the frequent ones in the first, the others by hash."""
    out: list[list[int]] = [[] for _ in range(count)]
    for i, (token, hot) in enumerate(zip(tokens, frequent, strict=True)):
        out[0 if hot else 1 + (token >> 17) % (count - 1)].append(i)
    return out


@lru_cache(1 << 16)
def _salt(band: int, segment: int, kind: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d %d %d" % (band, segment, kind))


def _key(band: int, segment: int, kind: int, total: int) -> int:
    """The signature of tokens with this sum, as a signed long."""
    return ((total + _salt(band, segment, kind)) & _MASK) - (1 << 63)


def index_keys(tokens: list[int], frequent: list[bool], bands: Bands) -> set[int]:
    """Keys under which a set is found: its segments and their one-deletion variants."""
    band = band_of(len(tokens))
    out = set()
    for s, inside in enumerate(_segments(tokens, frequent, bands.lengths(band)[2])):
        total = sum(tokens[i] for i in inside)
        out.add(_key(band, s, 0, total))
        out.update(_key(band, s, 1, total - tokens[i]) for i in inside)
    return out


def sketch(tokens: list[int]) -> int:
    """64 bits, of which every token sets one."""
    out = 0
    for token in tokens:
        out |= 1 << (token & 63)
    return out - (1 << 64) if out >> 63 else out


def allot(costs: list[tuple[float, float]], need: int) -> list[int]:
    """v + 1 of each segment, need in sum, for the least cost. costs: (of the first step, of the second, not less).

    As second steps cost no less than first ones, the cheapest steps of all are the best choice.
    """
    steps = sorted((cost, second, s) for s, pair in enumerate(costs) for second, cost in enumerate(pair))[:need]
    out = [0] * len(costs)
    for _, _, s in steps:
        out[s] += 1
    return out


def probe_keys(tokens: list[int], odds: list[float], frequent: list[bool], bands: Bands) -> set[int]:
    """Keys that meet every set as long or longer that is similar enough. odds: the share of sets that have each token."""
    size, out = len(tokens), set()
    for band in bands.partners(size):
        low, high, count = bands.lengths(band)
        high = min(high, math.floor(size / bands.threshold + 1e-9))
        need = 1 + max(most_different(n, size, bands.threshold) for n in range(max(low, size), high + 1))
        inside = _segments(tokens, frequent, count)
        costs = []
        for part in inside:
            # the share of sets expected to be equal in the segment, and to be so but for one token
            equal, near = (1.0, 0.0) if part else (0.5, 0.0)
            for i in part:
                equal *= odds[i]
                near += 1 / odds[i]
            costs.append((equal, equal + equal * near))
        for s, take in enumerate(allot(costs, need)):
            if not take:
                continue
            total = sum(tokens[i] for i in inside[s])
            out.add(_key(band, s, 0, total))
            if take == 2:
                out.add(_key(band, s, 1, total))
                out.update(_key(band, s, 0, total - tokens[i]) for i in inside[s])
    return out


def record_sets(rows: DataFrame, record: str, items: list[str], min_size: int) -> DataFrame:
    """(record, items): the distinct items of each record, sorted, where there are min_size or more.

    items names the columns that make an item; one that is null is told from any text.
    Rows without record are left out.
    """
    item = F.to_json(F.array(*[F.col(c).cast("string") for c in items]))
    distinct = rows.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), item.alias("item")).distinct()
    return distinct.groupBy("record").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") >= min_size)


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes: rep, items), (members: record, rep): records with equal sets share the least record as rep."""
    keyed = sets.withColumn("digest", F.sha2(F.to_json("items"), 256))
    reps = keyed.groupBy("digest").agg(F.min("record").alias("rep"))
    members = keyed.select("record", "digest").join(reps, "digest").select("record", "rep")
    classes = keyed.join(reps.select(F.col("rep").alias("record")), "record", "left_semi").select(F.col("record").alias("rep"), "items")
    return classes, members


def _with_shares(classes: DataFrame, total: int) -> DataFrame:
    """(no, tokens, shares): 64-bit hashes of the items with the share of sets that have each."""
    flat = classes.select("no", F.explode("items").alias("item")).select("no", F.xxhash64("item").alias("token"))
    counts = flat.groupBy("token").agg((F.count(F.lit(1)) / F.lit(float(max(total, 1)))).alias("share"))
    pairs = flat.join(counts, "token").groupBy("no").agg(F.collect_list(F.struct("token", "share")).alias("x"))
    return pairs.select("no", F.col("x.token").alias("tokens"), F.col("x.share").alias("shares"))


def _signatures(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(threshold)
        for batch in batches:
            numbers, roles, keys, sizes, sketches = [], [], [], [], []
            for no, tokens, shares in zip(batch["no"].tolist(), batch["tokens"], batch["shares"], strict=True):
                tokens, shares = tokens.view(np.uint64).tolist(), shares.tolist()
                frequent = [x > FREQUENT for x in shares]
                bits = sketch(tokens)
                for role, found in ((0, index_keys(tokens, frequent, bands)), (1, probe_keys(tokens, shares, frequent, bands))):
                    keys.extend(found)
                    numbers.append((no, role, len(tokens), bits, len(found)))
            if keys:
                no, roles, sizes, sketches, times = (np.array(x, dtype=np.int64) for x in zip(*numbers, strict=True))
                yield pd.DataFrame({
                    "no": np.repeat(no, times), "role": np.repeat(roles, times).astype(np.int32), "sig": np.array(keys, dtype=np.int64),
                    "size": np.repeat(sizes, times).astype(np.int32), "sketch": np.repeat(sketches, times),
                })

    return run


def _tasks(df: DataFrame, rows: int, each: int = 2000) -> int:
    """Tasks for work that the rows' bytes do not show: each rows to a task, and all cores in use."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / each))


def _enough(a: Column, b: Column, threshold: float) -> Column:
    """Exact test of the threshold on two arrays of distinct values."""
    common = F.size(F.array_intersect(a, b))
    return common >= F.lit(threshold) * (F.size(a) + F.size(b) - common) - F.lit(1e-9)


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(rep_a, rep_b), rep_a < rep_b: the pairs of classes (rep, items) with similarity >= threshold.

    A pair of classes is listed once. Sets must not be empty. No classes give no pairs.
    """
    classes = cut(classes.withColumn("no", F.monotonically_increasing_id()), "setjoin-classes")
    count = classes.count()
    weighted = _with_shares(classes, count).repartition(_tasks(classes, count), "no")
    signatures = cut(weighted.mapInPandas(_signatures(threshold), "no long, role int, sig long, size int, sketch long"), "setjoin-signatures", ["role"])
    side = lambda role, x: signatures.where(F.col("role") == role).select("sig", *[F.col(c).alias(f"{c}_{x}") for c in ("no", "size", "sketch")])
    longer = F.col("size_i") > F.col("size_p")
    once = longer | ((F.col("size_i") == F.col("size_p")) & (F.col("no_i") > F.col("no_p")))
    sizes = F.col("size_i") + F.col("size_p")
    # no more tokens may differ than leave enough in common, and the sketches differ in no more bits than that
    may_differ = sizes - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * sizes - F.lit(1e-9))
    near = F.bit_count(F.col("sketch_i").bitwiseXOR(F.col("sketch_p"))) <= may_differ
    met = side(1, "p").join(side(0, "i"), "sig").where(once & (F.col("size_i") * F.lit(threshold) <= F.col("size_p") + F.lit(1e-9)) & near)
    pairs = cut(met.select("no_i", "no_p").distinct(), "setjoin-pairs")
    i = classes.select(F.col("no").alias("no_i"), F.col("rep").alias("rep_i"), F.col("items").alias("items_i"))
    p = classes.select(F.col("no").alias("no_p"), F.col("rep").alias("rep_p"), F.col("items").alias("items_p"))
    exact = pairs.join(i, "no_i").join(p, "no_p").where(_enough(F.col("items_i"), F.col("items_p"), threshold))
    return exact.select(F.least("rep_i", "rep_p").alias("rep_a"), F.greatest("rep_i", "rep_p").alias("rep_b"))


def similar_records(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives, members) over record sets (record, items); see similar_classes."""
    classes, members = set_classes(sets)
    return similar_classes(classes, threshold), members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(record_a, record_b), record_a < record_b: all pairs of records, those within a class too."""
    a = members.select(F.col("record").alias("x"), F.col("rep").alias("rep_a"))
    b = members.select(F.col("record").alias("y"), F.col("rep").alias("rep_b"))
    across = pairs.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    within = a.join(b, F.col("rep_a") == F.col("rep_b")).where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))
