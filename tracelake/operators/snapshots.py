"""What changed between full snapshots: key ordinals, bitmaps and aligned content vectors.

Every key of a group (for instance a document root) gets an ordinal in one of the group's
hash stripes, and keeps both for good: a saved dictionary has them, and keys that are new to
it go to stripes of a generation of their own, so a group that grows changes no key's place.

A snapshot is a bitmap over the ordinals of a stripe, in chunks of CHUNK. A chunk is
compressed: one word says which of its 64-bit words have a bit at all, another which of them
are full, and only the words that are neither are stored. Beside it is a vector of contents,
aligned to the set bits. Additions and removals between neighbouring snapshots are AND-NOT of
the words of two chunks, and only chunks whose vectors differ are searched for changes among
the common keys. The keys come back from the dictionary, for the ordinals that changed.

Rows are shuffled three times: by key, after map-side aggregation, to keep the latest row per
key and snapshot and to meet the dictionary; by (group, stripe), for chunks and the comparison
of neighbours; and what changed, to get its keys. A hot group is spread over its stripes and
a hot key is collapsed before the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.runtime import cut

WORD = 64
#: Ordinals of a chunk, WORD words of them at most.
CHUNK = 1024
#: Keys per stripe aimed at; it bounds the work of one task, not the result.
STRIPE_KEYS = 1 << 16
DICTIONARY = ("grp", "stripe", "key", "ordinal")


def snapshot_sequence(deliveries: DataFrame) -> DataFrame:
    """(grp, snapshot_no, seq, n_seq): the complete snapshots of each group, numbered from 0.

    deliveries: grp, snapshot_no, status, delivered_at. Of several lines for one delivery
    the latest counts (ties: the greater status text). Lines without group or number are
    left out. No complete line gives no row.
    """
    latest = (
        deliveries.where(F.col("grp").isNotNull() & F.col("snapshot_no").isNotNull())
        .groupBy("grp", "snapshot_no")
        .agg(F.max(F.struct("delivered_at", F.lower(F.trim("status")).alias("status"))).alias("x"))
        .where(F.col("x.status") == "complete")
    )
    by = Window.partitionBy("grp")
    return latest.select(
        "grp",
        "snapshot_no",
        (F.row_number().over(by.orderBy("snapshot_no")) - 1).alias("seq"),
        F.count(F.lit(1)).over(by).alias("n_seq"),
    )


def extend_dictionary(keys: DataFrame, dictionary: DataFrame | None = None, stripe_keys: int = STRIPE_KEYS) -> DataFrame:
    """(grp, stripe, key, ordinal): dictionary and, behind it, the keys (grp, key) that it lacks.

    Known keys keep stripe and ordinal. The new keys of a group are spread by hash over
    stripes of their own, numbered after those the group has, as many as stripe_keys asks
    for; within a stripe ordinals follow key order. Rows with null group or key are left out.
    """
    fresh = keys.where(F.col("grp").isNotNull() & F.col("key").isNotNull()).select("grp", "key").distinct()
    if dictionary is not None:
        fresh = fresh.join(dictionary.select("grp", "key"), ["grp", "key"], "left_anti")
    per = fresh.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(stripe_keys)).cast("int").alias("stripes"))
    if dictionary is not None:
        per = per.join(dictionary.groupBy("grp").agg((F.max("stripe") + 1).alias("first")), "grp", "left")
    first = F.coalesce(F.col("first"), F.lit(0)) if dictionary is not None else F.lit(0)
    placed = fresh.join(per, "grp").select("grp", (first + F.pmod(F.xxhash64("key"), F.col("stripes"))).cast("int").alias("stripe"), "key")
    by = Window.partitionBy("grp", "stripe").orderBy("key")
    numbered = placed.withColumn("ordinal", (F.row_number().over(by) - 1).cast("int"))
    return numbered if dictionary is None else dictionary.select(*DICTIONARY).unionByName(numbered)


def latest_rows(rows: DataFrame, sequence: DataFrame) -> DataFrame:
    """One row per (grp, key, complete snapshot): the one received last (ties: the greater content)."""
    return (
        rows.where(F.col("key").isNotNull())
        .join(sequence, ["grp", "snapshot_no"])
        .groupBy("grp", "key", "seq", "n_seq")
        .agg(F.max(F.struct("received_at", "content")).alias("x"))
        .select("grp", "key", "seq", "n_seq", F.col("x.content").alias("content"))
    )


def snapshot_chunks(numbered: DataFrame) -> DataFrame:
    """(grp, stripe, chunk, seq, n_seq, present, full, words, vec): compressed bitmaps with aligned vectors.

    present and full have a bit for each word of the chunk; words are those that are present
    and not full, in order. vec has (pos, content) of the set bits, in order of pos.
    """
    place = ["grp", "stripe", "chunk", "seq", "n_seq"]
    words = (
        numbered.withColumn("chunk", F.floor(F.col("ordinal") / CHUNK).cast("int"))
        .withColumn("pos", (F.col("ordinal") % CHUNK).cast("int"))
        .groupBy(*place, F.floor(F.col("pos") / WORD).cast("int").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, pos % {WORD}))").alias("bits"), F.collect_list(F.struct("pos", "content")).alias("part"))
    )
    chunks = words.groupBy(*place).agg(
        F.expr("bit_or(shiftleft(1L, word))").alias("present"),
        F.coalesce(F.expr("bit_or(shiftleft(1L, word)) FILTER (WHERE bits = -1L)"), F.lit(0).cast("long")).alias("full"),
        F.expr("array_sort(collect_list(struct(word, bits)) FILTER (WHERE bits <> -1L)).bits").alias("words"),
        F.array_sort(F.flatten(F.collect_list("part"))).alias("vec"),
    )
    return chunks


def _word(present: str, full: str, words: str) -> str:
    """SQL of word w of a compressed chunk."""
    stored = f"{words}[bit_count({present} & ~{full} & (shiftleft(1L, w) - 1))]"
    return f"CASE WHEN getbit({present}, w) = 0 THEN 0L WHEN getbit({full}, w) = 1 THEN -1L ELSE {stored} END"


def chunk_changes(chunks: DataFrame) -> DataFrame:
    """(grp, stripe, ordinal, seq, change_kind) from each chunk and the one before it."""
    by = Window.partitionBy("grp", "stripe", "chunk").orderBy("seq")
    near = chunks.select(
        "*",
        *[F.lag(c).over(by).alias(f"lag_{c}") for c in ("seq", "present", "full", "words", "vec")],
        F.lead("seq").over(by).alias("next_seq"),
    )
    near = near.withColumn("joined", F.coalesce(F.col("lag_seq") == F.col("seq") - 1, F.lit(False)))
    # a chunk whose bitmap and vector are those of the snapshot before holds no change
    ends = (F.coalesce(F.col("next_seq"), F.col("n_seq")) > F.col("seq") + 1) & (F.col("seq") + 1 < F.col("n_seq"))
    near = near.withColumn("ends", ends).where(F.col("ends") | ((F.col("seq") > 0) & ~(F.col("joined") & F.expr("vec <=> lag_vec"))))
    now, was = _word("present", "full", "words"), _word("lag_present", "lag_full", "lag_words")
    all_words = f"sequence(0, {CHUNK // WORD - 1})"
    near = near.select(
        "grp", "stripe", "chunk", "seq", "vec", "lag_vec", "joined", "ends",
        F.when(F.col("seq") == 0, F.array().cast("array<bigint>"))
        .when(~F.col("joined"), F.expr(f"transform({all_words}, w -> {now})"))
        .otherwise(F.expr(f"transform({all_words}, w -> ({now}) & ~({was}))")).alias("new_bits"),
        F.when(F.col("joined"), F.expr(f"transform({all_words}, w -> ({was}) & ~({now}))")).alias("old_bits"),
        F.when(F.col("joined"), F.expr(f"transform({all_words}, w -> ({now}) & ({was}))")).alias("both"),
    )

    def ordinals(bits: str, kind: str, seq: str = "seq") -> Column:
        """The ordinals of the set bits, word by word; words without a bit are skipped."""
        one = f"transform(filter(sequence(0, {WORD - 1}), b -> getbit({bits}[w], b) = 1), b -> named_struct('seq', {seq}, 'ordinal', chunk * {CHUNK} + w * {WORD} + b, 'kind', '{kind}'))"
        return F.coalesce(F.expr(f"flatten(transform(filter(sequence(0, size({bits}) - 1, 1), w -> {bits}[w] <> 0L), w -> {one}))"), F.expr("array()"))

    changed = (
        # equal members drop out, what is left of the common keys has changed
        f"transform(filter(array_except(vec, lag_vec), m -> getbit(both[m.pos div {WORD}], m.pos % {WORD}) = 1),"
        f" m -> named_struct('seq', seq, 'ordinal', chunk * {CHUNK} + m.pos, 'kind', 'changed'))"
    )
    gone = f"transform(vec, m -> named_struct('seq', seq + 1, 'ordinal', chunk * {CHUNK} + m.pos, 'kind', 'removed'))"
    hits = near.select(
        "grp", "stripe",
        F.explode(F.concat(
            F.when(F.size("new_bits") > 0, ordinals("new_bits", "added")).otherwise(F.expr("array()")),
            F.when(F.col("joined"), ordinals("old_bits", "removed")).otherwise(F.expr("array()")),
            F.when(F.col("joined"), F.expr(changed)).otherwise(F.expr("array()")),
            # the next snapshot has no bit in this chunk: all of it goes
            F.when(F.col("ends"), F.expr(gone)).otherwise(F.expr("array()")),
        )).alias("x"),
    )
    return hits.select("grp", "stripe", F.col("x.ordinal").alias("ordinal"), F.col("x.seq").alias("seq"), F.col("x.kind").alias("change_kind"))


def snapshot_changes(
    rows: DataFrame, deliveries: DataFrame, dictionary: DataFrame | None = None, stripe_keys: int = STRIPE_KEYS
) -> tuple[DataFrame, DataFrame]:
    """(changes, dictionary). changes: (grp, snapshot_no, key, change_kind) between each complete snapshot of a group and the complete one before.

    rows: grp, snapshot_no, key, content (compared with null-safe equality), received_at;
    other columns are ignored. Rows of snapshots that are not complete, and rows without
    group or key, are left out. A complete snapshot without rows removes all keys of the
    one before it. Empty input gives an empty result. dictionary (grp, stripe, key,
    ordinal) is the one an earlier call returned; the one returned has the new keys too,
    written in the shared folder, to be saved for the next call.
    """
    sequence = snapshot_sequence(deliveries)
    latest = cut(latest_rows(rows.select("grp", "snapshot_no", "key", "content", "received_at"), sequence), "snapshots-latest")
    known = cut(extend_dictionary(latest, dictionary, stripe_keys), "snapshots-dictionary")
    numbered = latest.join(known, ["grp", "key"]).drop("key").repartition("grp", "stripe")
    changes = chunk_changes(snapshot_chunks(numbered)).join(sequence.select("grp", "seq", "snapshot_no"), ["grp", "seq"])
    return changes.join(known, ["grp", "stripe", "ordinal"]).select("grp", "snapshot_no", "key", "change_kind"), known
