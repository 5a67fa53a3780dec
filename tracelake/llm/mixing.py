"""Mixing sources to target shares of the total size, with a cap on repeats.

Entropy balancing: of all document rates r that give each source its tokens, those nearest
to the documents as they are, in relative entropy, have the form exp(lambda_s * tokens),
cut at the source's cap. The multipliers lambda_s solve the convex dual; each Newton step
is one distributed sum over a histogram (source, tokens) -> documents, which is exact as
documents of one size in one source have one rate. Rates become whole copies by systematic
rounding along the order of sizes (random among equals), in blocks, so that copies add up
to rates within one at every size, and tokens within the greatest size of a block.
"""

from __future__ import annotations

import os
import warnings
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.runtime import cut, spread

#: A tokenizer file of the `tokenizers` library; every function takes another path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Sources a target list may have; their sums come to the driver.
MAX_SOURCES = 10_000
#: Documents of a rounding block, on average.
BLOCK = 5_000
ROUNDS = 60
TOLERANCE = 1e-9


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def token_count(text: Column | str, path: str = TOKENIZER) -> Column:
    """Tokens of a whole text; 0 for null and empty ones."""

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoded = _tokenizer(path).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(e) for e in encoded], dtype="int64")

    return count(text)


def sized(documents: DataFrame, key: str, source: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(doc, source, tokens): the source trimmed and in lower case, null as ''."""
    name = F.coalesce(F.lower(F.trim(source)), F.lit(""))
    return spread(documents.select(key, source, text)).select(F.col(key).alias("doc"), name.alias("source"), token_count(text, path).alias("tokens"))


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, cap). Names that agree when trimmed and in lower case are added up, with the smaller cap."""
    rows = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where(
        "source IS NOT NULL AND target_share > 0 AND max_repeats > 0"
    )
    rows = rows.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources have a target")
    return {r.source: (float(r.share), int(r.cap)) for r in rows}


def _per_source(values: dict[str, float], source: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), source), F.lit(default))


def solve(histogram: DataFrame, wanted: dict[str, tuple[float, int]], total: float | None = None) -> tuple[dict[str, float], dict[str, int], float]:
    """(lambda, cap, total tokens) of the sources that have both a target and tokens.

    histogram: source, tokens, documents. total defaults to the greatest size at which
    every such source can reach its share; a greater one leaves sources that run out of
    documents at their cap. A source at its cap has an infinite lambda.
    """
    sums = {r.source: (float(r.t), float(r.mean)) for r in histogram.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("documents")).alias("t"), (F.sum(F.col("tokens") * F.col("documents")) / F.sum("documents")).alias("mean")
    ).where(F.col("source").isin(list(wanted))).collect()}
    live = {s: wanted[s] for s in sorted(wanted) if sums.get(s, (0.0, 0.0))[0] > 0}
    if not live:
        return {}, {}, 0.0
    whole = sum(share for share, _ in live.values())
    if total is None:
        total = min(cap * sums[s][0] * whole / share for s, (share, cap) in live.items())
    caps = {s: cap for s, (_, cap) in live.items()}
    goal = {s: share / whole * total for s, (share, _) in live.items()}
    full = {s for s in live if goal[s] >= caps[s] * sums[s][0] * (1 - TOLERANCE)}
    x = {s: 0.0 for s in live if s not in full}
    low, high = dict.fromkeys(x, float("-inf")), dict.fromkeys(x, float("inf"))
    open_ = set(x)
    scale = {s: sums[s][1] for s in live}
    for _ in range(ROUNDS):
        if not open_:
            break
        step = histogram.where(F.col("source").isin(sorted(open_)))
        relative = F.col("tokens") / _per_source(scale, F.col("source"), 1.0)
        # the exponent is bounded: beyond it the rate is at its cap anyway
        tilt = F.exp(F.least(_per_source(x, F.col("source"), 0.0) * relative, F.lit(700.0)))
        cap = _per_source({s: float(c) for s, c in caps.items()}, F.col("source"), 0.0)
        weight = F.col("documents") * F.col("tokens")
        rows = step.groupBy("source").agg(
            F.sum(weight * F.least(tilt, cap)).alias("f"),
            F.sum(F.when(tilt < cap, weight * tilt * relative).otherwise(0.0)).alias("slope"),
        ).collect()
        for r in rows:
            s, gap = r.source, r.f - goal[r.source]
            if abs(gap) <= TOLERANCE * goal[s]:
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = x[s]
            else:
                low[s] = x[s]
            new = x[s] - gap / r.slope if r.slope > 0 else float("nan")
            if not low[s] < new < high[s]:
                # outside the bracket: halve it, or widen it where one side is open
                if low[s] == float("-inf"):
                    new = min(x[s] * 2, x[s] - 1)
                elif high[s] == float("inf"):
                    new = max(x[s] * 2, x[s] + 1)
                else:
                    new = (low[s] + high[s]) / 2
            x[s] = new
    if open_:
        warnings.warn(f"the rates of {', '.join(sorted(open_))} are not within {TOLERANCE} of their share after {ROUNDS} rounds", stacklevel=2)
    multipliers = {s: x[s] / scale[s] for s in x} | dict.fromkeys(full, float("inf"))
    return multipliers, caps, total


def mix(sized_documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """(doc, source, tokens, rate, copies) of every document.

    sized_documents: doc, source, tokens; targets: source, target_share, max_repeats.
    Documents without tokens, or of a source without target, get no copies. No document
    gets more copies than its source's max_repeats.
    """
    histogram = cut(sized_documents.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("documents")), "mixing-histogram")
    multipliers, caps, _ = solve(histogram, _targets(targets), total)
    cap = _per_source({s: float(c) for s, c in caps.items()}, F.col("source"), 0.0)
    finite = {s: v for s, v in multipliers.items() if v != float("inf")}
    tilt = F.exp(F.least(_per_source(finite, F.col("source"), 0.0) * F.col("tokens"), F.lit(700.0)))
    rate = F.when(F.col("source").isin(sorted(set(multipliers) - set(finite))), cap).otherwise(F.least(tilt, cap))
    rated = sized_documents.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(0.0))
    sizes = {r.source: max(1.0, -(-r.n // BLOCK)) for r in histogram.where(F.col("source").isin(sorted(caps))).groupBy("source").agg(F.sum("documents").alias("n")).collect()}
    draw = F.xxhash64(F.lit(seed), "doc")
    blocks = rated.withColumn("draw", draw).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc"), _per_source(sizes, F.col("source"), float(BLOCK)).cast("long"))
    )
    by = Window.partitionBy("source", "block").orderBy("tokens", "draw", "doc").rowsBetween(Window.unboundedPreceding, 0)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "block"), F.lit(1_000_000)) / 1_000_000.0
    reached = F.sum("rate").over(by) + start
    before = reached - F.col("rate")
    # the sum is the same up to rounding, so copies come from rounded values
    copies = F.floor(F.round(reached, 6)) - F.floor(F.round(before, 6))
    return blocks.withColumn("copies", F.least(copies, F.ceil(F.round("rate", 6))).cast("int")).select("doc", "source", "tokens", "rate", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, used, tokens_mixed, actual_share) per source of either table."""
    own = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("copies") > 0, 1)).alias("used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_mixed")
    )
    whole = own.select(F.sum("tokens_mixed").alias("whole"))
    named = targets.select(F.lower(F.trim("source")).alias("source"), "target_share").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    total = whole.first()[0] or 0
    both = own.join(named, "source", "full_outer").na.fill(0, ["documents", "used", "tokens_mixed"]).na.fill(0.0, ["target_share"])
    actual = F.col("tokens_mixed") / F.lit(float(total)) if total else F.lit(0.0)
    return both.select("source", "target_share", "documents", "used", "tokens_mixed", actual.alias("actual_share"))
