"""Weighted matching of change specs against the terms of cases.

Many specs are matched at once. Keys of case terms are reduced to distinct ones first, so a
term that nearly every case has is compared once per spec term. Spec terms are the small
side: they are broadcast after their number is checked, and beyond that candidates come
from equi-joins on the rarest pieces that any two similar keys must share.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import lexical_tokens, match_key, similarity
from tracelake.runtime import cut

# Weight of each field of a spec, in the order scores are added up.
WEIGHTS = {
    "business_objects": 2.0, "capabilities": 1.8, "change_types": 1.0, "actions": 1.5, "states": 1.5, "actors": 0.7,
    "triggers": 0.7, "invariants": 1.3, "changed_rules": 1.3, "before_behaviors": 1.0, "after_behaviors": 1.0,
}
# The stored term type each field of a spec is matched with.
TERM_TYPES = {
    "business_objects": "business_object", "capabilities": "capability", "change_types": "change_type", "actions": "action",
    "states": "state", "actors": "actor", "triggers": "trigger", "invariants": "invariant", "changed_rules": "changed_rule",
    "before_behaviors": "before_behavior", "after_behaviors": "after_behavior",
}
#: Least similarity of a matched term.
MATCH = 0.5
#: Wanted keys up to this number are broadcast, and met with every key, where that makes no more than MAX_PAIRS.
MAX_BROADCAST = 20_000
MAX_PAIRS = 20_000_000


def weight_of(field: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.element_at(pairs, field), F.lit(1.0))


def close_aliases(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """alias -> the end of its chain; a key in a cycle keeps itself, one that leads into a cycle ends where it enters."""
    step = dict(pairs)
    out = {}
    for start in step:
        seen, at = {start}, start
        while at in step and step[at] not in seen:
            at = step[at]
            seen.add(at)
        out[start] = start if step.get(at) == start else at if at not in step else step[at]
    return out


def canonical(key: Column, aliases: DataFrame | None, spark: SparkSession | None = None) -> Column:
    """key with aliases (alias, canonical: keys already) resolved. The alias list comes to the driver: it is written by hand."""
    closed = close_aliases([(r.alias, r.canonical) for r in aliases.collect()]) if aliases is not None else {}
    if not closed:
        return key
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in closed.items() for x in pair]), key), key)


def alias_keys(aliases: DataFrame) -> DataFrame:
    """The alias list by match keys."""
    return aliases.select(match_key("alias").alias("alias"), match_key("canonical").alias("canonical")).where("alias <> ''")


def spec_terms(spark: SparkSession, specs: dict[str, dict[str, list]], aliases: DataFrame | None = None) -> DataFrame:
    """(spec_id, field, pos, key, display) of specs {id: {field: [terms]}}.

    Terms that are no strings or blank are left out; of terms with one key the first counts.
    """
    rows = [(s, f, i, t.strip()) for s, spec in specs.items() for f in WEIGHTS for i, t in enumerate(spec.get(f) or []) if isinstance(t, str) and t.strip()]
    listed = spark.createDataFrame(rows, "spec_id string, field string, pos int, display string")
    keyed = listed.withColumn("key", canonical(match_key("display"), aliases))
    return first_by(keyed.where("key <> ''"), ["spec_id", "field", "key"], ["pos"])


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; order must tell the rows of a key apart.

    An aggregate with map-side combination, so a frequent key is never in one place.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in rows.columns])


def case_keys(terms: DataFrame, key: Column, pos: str) -> DataFrame:
    """(case_id, field, key, pos, display) of stored terms (case_id, term_type, term, pos); of terms with one key the first counts."""
    fields = F.create_map(*[F.lit(x) for f, t in TERM_TYPES.items() for x in (t, f)])
    rows = terms.select("case_id", F.element_at(fields, F.col("term_type")).alias("field"), key.alias("key"), F.col(pos).alias("pos"), F.trim("term").alias("display"))
    rows = rows.where("case_id IS NOT NULL AND field IS NOT NULL AND key <> ''")
    best = rows.groupBy("case_id", "field", "key").agg(F.min(F.struct("pos", "display")).alias("x"))
    return best.select("case_id", "field", "key", F.col("x.pos").alias("pos"), F.col("x.display").alias("display"))


def pieces(key: Column, tokens: Column) -> Column:
    """array<struct<kind, piece>>: the tokens of a key, its pairs of letters, and itself."""
    tagged = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("piece")))
    pairs = F.when(F.length(key) > 1, F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(key, i, F.lit(2))))
    none = F.array().cast("array<string>")
    return F.concat(tagged("token", tokens), tagged("pair", F.array_distinct(F.coalesce(pairs, none))), tagged("whole", F.array(key)))


def _rare_pieces(flat: DataFrame, counts: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """(*on, key, kind, piece): of each key the pieces one of which a similar key that is no smaller must have.

    A key inside another has its rarest pair there; keys of a lexical similarity share
    threshold times the tokens of the smaller one, so one of its rarest tokens.
    """
    x = flat.join(counts, [*on, "kind", "piece"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lists = x.groupBy(*on, "key", "kind").agg(F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("l"))
    size = F.size("l")
    keep = F.when(F.col("kind") == "token", size - F.ceil(size * threshold - 1e-9) + 1).otherwise(1).cast("int")
    return lists.select(*on, "key", "kind", F.explode(F.slice("l", F.lit(1), keep)).alias("p")).select(*on, "key", "kind", "p.piece")


@dataclass
class PieceIndex:
    """Keys (*on, key, tokens) prepared to be met by their pieces: all pieces, how many keys have each, and each key's rare ones."""

    on: list[str]
    threshold: float
    keys: DataFrame
    pieces: DataFrame
    counts: DataFrame
    rare: DataFrame


def _flat(keys: DataFrame, on: list[str]) -> DataFrame:
    return keys.select(*on, "key", F.explode(pieces(F.col("key"), F.col("tokens"))).alias("p")).select(*on, "key", "p.*")


def piece_index(actual: DataFrame, on: list[str], threshold: float = MATCH, keep: bool = False) -> PieceIndex:
    """The index over the distinct keys of actual (*on, key); keep writes it out, to be met more than once."""
    kept = (lambda df, name: cut(df, f"pieces-{name}")) if keep else (lambda df, name: df)
    keys = kept(actual.select(*on, "key").distinct().withColumn("tokens", lexical_tokens("key")), "keys")
    flat = kept(_flat(keys, on), "all")
    counts = kept(flat.groupBy(*on, "kind", "piece").agg(F.count(F.lit(1)).alias("n")), "counts")
    return PieceIndex(on, threshold, keys, flat, counts, kept(_rare_pieces(flat, counts, on, threshold), "rare"))


def similar_keys(
    wanted: DataFrame, actual: DataFrame | PieceIndex, on: list[str], threshold: float = MATCH, max_broadcast: int = MAX_BROADCAST, max_pairs: int = MAX_PAIRS
) -> DataFrame:
    """(*on, wanted_key, key, score, match_type) of distinct keys that reach the threshold.

    wanted and actual: *on, key. The join is a hash join on `on` with the broadcast wanted
    keys where they are few and make few pairs with the others, else, and with an index in
    place of actual, an equi-join on (on, piece).
    """
    left = wanted.select(*on, F.col("key").alias("wanted_key")).distinct().withColumn("wanted_tokens", lexical_tokens("wanted_key"))
    index, few = actual if isinstance(actual, PieceIndex) else None, 0
    if index is None:
        right = actual.select(*on, "key").distinct().withColumn("tokens", lexical_tokens("key"))
        few = left.limit(max_broadcast + 1).count() if max_broadcast else 1
    if index is None and few <= max_broadcast and few * right.limit(max_pairs // max(few, 1) + 1).count() <= max_pairs:
        pairs = right.join(F.broadcast(left), on)
    else:
        index = index or piece_index(actual, on, threshold)
        w, right = _flat(left.withColumnsRenamed({"wanted_key": "key", "wanted_tokens": "tokens"}), on), index.keys
        by = [*on, "kind", "piece"]
        met = _rare_pieces(w, index.counts, on, threshold).withColumnRenamed("key", "wanted_key").join(index.pieces, by).select(*on, "wanted_key", "key")
        met = met.unionByName(w.withColumnRenamed("key", "wanted_key").join(index.rare, by).select(*on, "wanted_key", "key"))
        pairs = met.distinct().join(left, [*on, "wanted_key"]).join(right, [*on, "key"])
    scored = pairs.withColumn("s", similarity(F.col("wanted_key"), F.col("key"), F.col("wanted_tokens"), F.col("tokens")))
    return scored.where(F.col("s.score") >= threshold).select(*on, "wanted_key", "key", F.col("s.score").alias("score"), F.col("s.match_type").alias("match_type"))


def term_matches(specs: DataFrame, keys: DataFrame) -> DataFrame:
    """(spec_id, case_id, field, pos, wanted, actual, score, match_type): the best term of a case for each spec term.

    Of equally good terms the first of the case counts. score is rounded after the threshold.
    """
    similar = similar_keys(specs, keys, ["field"])
    hits = (
        keys.select("case_id", "field", "key", F.col("pos").alias("actual_pos"), F.col("display").alias("actual"))
        .join(similar, ["field", "key"])
        .join(specs.select("spec_id", "field", "pos", F.col("key").alias("wanted_key"), F.col("display").alias("wanted")), ["field", "wanted_key"])
    )
    best = hits.groupBy("spec_id", "case_id", "field", "pos", "wanted").agg(
        F.min(F.struct((-F.col("score")).alias("low"), "actual_pos", "actual", "match_type")).alias("x")
    )
    return best.select(
        "spec_id", "case_id", "field", "pos", "wanted", F.col("x.actual").alias("actual"),
        F.round(-F.col("x.low"), 4).alias("score"), F.col("x.match_type").alias("match_type"),
    )


def field_scores(matches: DataFrame) -> DataFrame:
    """(spec_id, case_id, field, best, contribution): the best rounded match of each field and its weighted part of the score."""
    best = matches.groupBy("spec_id", "case_id", "field").agg(F.max("score").alias("best"))
    return best.withColumn("contribution", weight_of(F.col("field")) * F.col("best"))


def case_scores(fields: DataFrame) -> DataFrame:
    """(spec_id, case_id, score); parts are added in the order of the weight table, so sums are the same everywhere."""
    order = F.array(*[F.lit(f) for f in WEIGHTS])
    parts = F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("field")).alias("o"), "contribution")))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["contribution"])
    # the inner rounding takes off what binary fractions leave behind, so halves round up everywhere
    return fields.groupBy("spec_id", "case_id").agg(F.round(F.round(total, 8), 4).alias("score"))


def direct_matches(scores: DataFrame, cases: DataFrame, min_score: float = 1.0) -> DataFrame:
    """Scores of cases that are not rejected and reach min_score."""
    usable = cases.where("knowledge_tier <> 'rejected'").select("case_id").distinct()
    return scores.where(F.col("score") >= min_score).join(usable, "case_id", "left_semi")


def spec_issues(specs: dict[str, dict]) -> list[tuple[str, str]]:
    """(spec_id, message) of required fields that are empty."""
    needed = ("before_behaviors", "after_behaviors", "business_objects", "change_types")
    return [(s, f"{f} is empty") for s, spec in specs.items() for f in needed if not spec.get(f)]
