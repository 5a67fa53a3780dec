"""Items that appear together: stripes of neighbour counts and how far they exceed chance.

A stripe is an item with the associative array of its neighbours and their counts; of a
pair, the smaller item has the stripe. Every task adds up the stripes it makes, in memory and
up to a fixed number of entries, before anything is shuffled. Then the arrays are merged by
key: the parts of a stripe come to one task in order and are added into one array. An item
found in a third of all baskets has a long stripe in many parts; such a stripe is split into
ranges of its neighbours' hashes, each merged by itself, so no array and no task grows with
the data beyond STRIPE_ENTRIES.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries a task holds before it passes its stripes on.
HELD_ENTRIES = 200_000
#: Entries the parts of one stripe may have together before it is split by neighbour.
STRIPE_ENTRIES = 50_000
#: Items of a basket that one task pairs with one another; longer baskets are paired block by block.
BLOCK = 1_000
#: Least log-likelihood ratio of a pair that is not taken for chance: chi-square, one degree of freedom, 95 %.
SIGNIFICANT = 3.841
STRIPE = "item string, neighbours array<string>, counts array<bigint>"


def _emit(stripes: dict[str, Counter]) -> pd.DataFrame:
    return pd.DataFrame({
        "item": list(stripes), "neighbours": [list(s) for s in stripes.values()], "counts": [list(s.values()) for s in stripes.values()],
    })


def _pairs_of(left: list[str], right: list[str] | None) -> Iterator[tuple[str, list[str]]]:
    """(item, neighbours that sort behind it) of the pairs within left, or of those between left and right."""
    if right is None:
        for i, item in enumerate(left[:-1]):
            yield item, left[i + 1 :]
        return
    for a, b in ((left, right), (right, left)):
        for item in a:
            yield item, [x for x in b if x > item]


def _stripe_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stripes: dict[str, Counter] = defaultdict(Counter)
    held = 0
    for batch in batches:
        for left, right in zip(batch["left_items"], batch["right_items"], strict=True):
            for item, near in _pairs_of(list(left), None if right is None else list(right)):
                if near:
                    stripe = stripes[item]
                    before = len(stripe)
                    stripe.update(near)
                    held += len(stripe) - before
                    if held > HELD_ENTRIES:
                        yield _emit(stripes)
                        stripes, held = defaultdict(Counter), 0
    if stripes:
        yield _emit(stripes)


def _added_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Single counts (item, other, n) added up to stripes."""
    stripes: dict[str, Counter] = defaultdict(Counter)
    held = 0
    for batch in batches:
        for item, other, n in zip(batch["item"], batch["other"], batch["n"], strict=True):
            stripe = stripes[item]
            held += other not in stripe
            stripe[other] += int(n)
            if held > HELD_ENTRIES:
                yield _emit(stripes)
                stripes, held = defaultdict(Counter), 0
    if stripes:
        yield _emit(stripes)


def baskets(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, item), distinct; rows with null or blank item or null basket are left out."""
    name = F.lower(F.trim(F.col(item).cast("string")))
    return rows.select(F.col(basket).alias("basket"), name.alias("item")).where(F.col("basket").isNotNull() & (F.col("item") != "")).distinct()


def basket_stripes(distinct: DataFrame, block: int | None = None) -> DataFrame:
    """(item, neighbours, counts): partial stripes of the baskets (basket, item). Baskets of one item give none.

    A basket of more than block items is cut into blocks by item hash, and every two of its
    blocks are a row of their own, so no row has more than about twice block items.
    """
    sizes = distinct.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / F.lit(block or BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    placed = distinct.join(sizes, "basket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = placed.groupBy("basket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(
        F.array_sort(F.expr("collect_list(item) FILTER (WHERE own <= other)")).alias("a"),
        F.array_sort(F.expr("collect_list(item) FILTER (WHERE own > other)")).alias("b"),
    )
    pairs = rows.where((F.col("lo") < F.col("hi")) | (F.size("a") > 1)).select(
        F.col("a").alias("left_items"), F.when(F.col("lo") < F.col("hi"), F.col("b")).alias("right_items")
    )
    return pairs.mapInPandas(_stripe_batches, STRIPE)


def partial_count_stripes(rows: DataFrame) -> DataFrame:
    """(item, neighbours, counts) from partial pair counts: batch_no, item_a, item_b, n, ids.

    A batch counts once for an unordered pair; of lines that differ the greatest count
    holds. A null n is the number of distinct ids (none if that is null too). Names are
    compared trimmed and in lower case; pairs with a null or blank side, and an item with
    itself, are left out.
    """
    a, b = F.lower(F.trim("item_a")), F.lower(F.trim("item_b"))
    lines = rows.select(
        "batch_no", F.least(a, b).alias("item"), F.greatest(a, b).alias("other"), F.coalesce("n", F.size(F.array_distinct("ids")).cast("long"), F.lit(0)).alias("n")
    ).where((a != "") & (b != "") & (a != b))
    once = lines.groupBy("batch_no", "item", "other").agg(F.max("n").alias("n")).where("n > 0")
    return once.select("item", "other", "n").mapInPandas(_added_up, STRIPE)


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stripes cut by their neighbours' hashes into parts ranges."""
    for batch in batches:
        out: list[tuple[str, list, list, int]] = []
        for item, parts, near, counts in zip(batch["item"], batch["parts"], batch["neighbours"], batch["counts"], strict=True):
            if parts == 1:
                out.append((item, near, counts, 0))
                continue
            ranges: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for name, n in zip(near, counts, strict=True):
                names, ns = ranges[xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) % parts]
                names.append(name)
                ns.append(n)
            out.extend((item, names, ns, part) for part, (names, ns) in ranges.items())
        if out:
            yield pd.DataFrame(out, columns=["item", "neighbours", "counts", "part"])


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts of each (item, part), which come one after the other, added into one array."""
    key, total = None, Counter()
    done: dict[str, list] = {"item": [], "part": [], "neighbours": [], "counts": []}

    def close() -> None:
        for name, value in zip(done, (key[0], key[1], list(total), list(total.values())), strict=True):
            done[name].append(value)

    for batch in batches:
        for item, part, near, counts in zip(batch["item"], batch["part"], batch["neighbours"], batch["counts"], strict=True):
            if (item, part) != key:
                if key is not None:
                    close()
                key, total = (item, part), Counter()
            for name, n in zip(near, counts, strict=True):
                total[name] += int(n)
        if done["item"]:
            yield pd.DataFrame(done)
            done = {name: [] for name in done}
    if key is not None:
        close()
        yield pd.DataFrame(done)


def merged_stripes(stripes: DataFrame, entries: int | None = None) -> DataFrame:
    """(item, part, neighbours, counts): partial stripes added up, one row per item, or per range of its neighbours.

    A stripe whose parts have more than entries together is split by neighbour hash, the
    same way in all its parts, before they move.
    """
    sizes = stripes.groupBy("item").agg(F.ceil(F.sum(F.size("neighbours")) / F.lit(entries or STRIPE_ENTRIES)).cast("int").alias("parts"))
    whole = stripes.join(sizes.where("parts > 1"), "item", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = whole.select("item", "parts", "neighbours", "counts").mapInPandas(_ranges, f"{STRIPE}, part int")
    placed = split.repartition("item", "part").sortWithinPartitions("item", "part")
    return placed.mapInPandas(_merge, "item string, part int, neighbours array<string>, counts array<bigint>")


def entries_of(merged: DataFrame) -> DataFrame:
    """(item_a, item_b, c): the entries of merged stripes, each pair once."""
    entries = merged.select("item", F.explode(F.arrays_zip("neighbours", "counts")).alias("x"))
    return entries.select(F.col("item").alias("item_a"), F.col("x.neighbours").alias("item_b"), F.col("x.counts").alias("c"))


def _x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log_likelihood_ratio(c: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Dunning's ratio of the two-by-two table with c baskets of both items."""
    rest = n - n_a - n_b + c
    cells = _x_log_x(c) + _x_log_x(n_a - c) + _x_log_x(n_b - c) + _x_log_x(rest)
    margins = _x_log_x(n_a) + _x_log_x(n - n_a) + _x_log_x(n_b) + _x_log_x(n - n_b)
    return 2 * (cells + _x_log_x(n) - margins)


def significance(entries: DataFrame, distinct: DataFrame) -> DataFrame:
    """(item_a, item_b, c, n_a, n_b, n, lift, llr): entries (item_a, item_b, c) against the baskets they count.

    lift is c * n / (n_a * n_b), llr the log-likelihood ratio, negative where the pair is
    rarer than chance. Pairs with an item that no basket has are left out.
    """
    n = distinct.select("basket").distinct().count()
    single = distinct.groupBy("item").agg(F.count(F.lit(1)).alias("k"))
    x = (
        entries.join(single.select(F.col("item").alias("item_a"), F.col("k").alias("n_a")), "item_a")
        .join(single.select(F.col("item").alias("item_b"), F.col("k").alias("n_b")), "item_b")
        .withColumn("n", F.lit(n).cast("long"))
        .withColumn("lift", F.col("c") * F.col("n") / (F.col("n_a") * F.col("n_b")).cast("double"))
    )
    parts = [F.col(k).cast("double") for k in ("c", "n_a", "n_b", "n")]
    llr = F.greatest(log_likelihood_ratio(*parts), F.lit(0.0))
    return x.withColumn("llr", F.when(F.col("lift") < 1, -llr).otherwise(llr)).select(
        "item_a", "item_b", "c", "n_a", "n_b", "n", "lift", "llr"
    )
