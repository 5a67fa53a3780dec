"""Free-entered values mapped to the entries of a reference list.

The reference list goes to every task, in blocks of a checked size; the values stay where
they are. A value is folded (consistent characters, no letter case, no accents; umlauts
may be written ae, oe and ue on either side), then

1. a multi-pattern automaton over the names and their aliases, and over the words of the
   names with their plural forms, finds the mentions in the value written without blanks;
   the longest mentions that do not overlap win, and they must cover the value: they are
   one whole name, or the words of one name in any order;
2. what is left goes to token-set similarity: every word of the value must pair with a
   word of the entry, of its own. A word that the automaton found stands for what it found;
   any other must equal the entry's word but for one slip, or abbreviate it. The entry of
   the greatest similarity wins, with the best pairing of the words. A value whose blanks
   are lost or misplaced is compared with the names as a whole.

A word more, fewer or replaced leaves something uncovered or unpaired, so no entry is named.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm import looks
from tracelake.llm.looks import consistent
from tracelake.runtime import cut

#: Names sent to all tasks at once; a longer list is matched block by block.
MAX_ENTRIES = 200_000
#: Values whose result a task remembers.
REMEMBERED = 1 << 17
RESULT = T.StructType([T.StructField("ref_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("how", T.StringType())])
_WORDS = re.compile(r"[^\W_]+")
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue"})


def fold(text: str) -> str:
    """Consistent characters without letter case and accents."""
    text = consistent(text).casefold()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def spelled(text: str) -> str:
    """text folded with its umlauts written ae, oe and ue; fold() writes ß as ss."""
    return fold(unicodedata.normalize("NFC", consistent(text).casefold()).translate(_UMLAUTS))


def words(folded: str) -> list[str]:
    return _WORDS.findall(folded)


def plurals(word: str) -> list[str]:
    """Plural forms of a word, as they are entered: regular ones and a bare s."""
    out = [word + "s", word + "es"]
    if word.endswith("y"):
        out.append(word[:-1] + "ies")
    return out


def shorter(word: str) -> set[str]:
    """word with one letter left out."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_slip(a: str, b: str) -> bool:
    """At most one letter is added, left out, replaced, or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if len(a) == len(b):
        return x[1:] == y[1:] or (len(x) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])
    return x[1:] == y if len(a) > len(b) else x == y[1:]


def abbreviates(short: str, word: str) -> bool:
    """short has three of the word's letters or more, in their order, from the first on, and leaves out two or more and a fifth."""
    if not 3 <= len(short) <= min(len(word) - 2, len(word) * 0.8) or short[0] != word[0]:
        return False
    at = iter(word)
    return all(c in at for c in short)


def best_pairing(gains: list[list[float]]) -> float | None:
    """The greatest sum of gains with one column for each row and no column twice (0 is no pair); None where there is no such choice.

    Shortest augmenting paths with potentials, so the work grows with the cube of the rows.
    """
    n, never = len(gains), 1e9
    cost = [[1 - g if g > 0 else never for g in row] for row in gains]
    of_row, of_column, taken = [0.0] * n, [0.0] * (n + 1), [-1] * (n + 1)
    for row in range(n):
        # column n is where the search for the new row starts
        least, before, seen, at = [math.inf] * n, [n] * n, [False] * (n + 1), n
        taken[n] = row
        while taken[at] >= 0:
            seen[at], r, step, then = True, taken[at], math.inf, -1
            for c in range(n):
                if not seen[c]:
                    slack = cost[r][c] - of_row[r] - of_column[c]
                    if slack < least[c]:
                        least[c], before[c] = slack, at
                    if least[c] < step:
                        step, then = least[c], c
            for c in range(n + 1):
                if seen[c]:
                    of_row[taken[c]] += step
                    of_column[c] -= step
                elif c < n:
                    least[c] -= step
            at = then
        while at != n:
            taken[at] = taken[before[at]]
            at = before[at]
    total = [gains[taken[c]][c] for c in range(n)]
    return sum(total) if all(g > 0 for g in total) else None


class Matcher:
    """The reference list prepared for look-up. entries: (ref_id, name); aliases: (ref_id, other name)."""

    def __init__(self, entries: list[tuple[int, str]], aliases: list[tuple[int, str]] = ()):
        whole: dict[str, int] = {}
        self.by_words: dict[tuple[str, ...], int] = {}
        self.near_whole: dict[str, set[str]] = defaultdict(set)
        forms: dict[str, str] = {}
        spellings: dict[str, set[str]] = defaultdict(set)
        names: list[tuple[str, int]] = []
        for ref, name in sorted(entries) + sorted(aliases):
            parts = words(fold(name))
            if parts:
                whole.setdefault("".join(parts), ref)
                self.by_words.setdefault(tuple(sorted(parts)), ref)
                other = words(spelled(name))
                if other != parts:
                    names.append(("".join(other), ref))
                    for word, spelling in zip(parts, other, strict=True):
                        if spelling != word:
                            spellings[word].add(spelling)
        for name, ref in names:
            whole.setdefault(name, ref)
        vocabulary = {w for key in self.by_words for w in key}
        for word, other_forms in sorted(spellings.items()):
            for form in sorted(other_forms - vocabulary):
                forms.setdefault(form, word)
        for word in sorted(vocabulary):
            for form in [p for w in [word, *sorted(spellings.get(word, ()))] for p in plurals(w)]:
                if form not in vocabulary:
                    forms.setdefault(form, word)
        forms |= {w: w for w in vocabulary}
        self.near_forms: dict[str, set[str]] = defaultdict(set)
        for form in forms:
            for key in shorter(form) | {form}:
                self.near_forms[key].add(form)
        self.forms = forms
        self.by_initial: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for word in vocabulary:
            for form in {word} | spellings.get(word, set()):
                self.by_initial[form[0]].append((form, word))
        #: (word, number of words) -> the entries of so many words that have the word.
        self.having: dict[tuple[str, int], set[tuple[str, ...]]] = defaultdict(set)
        for key in self.by_words:
            for word in key:
                self.having[word, len(key)].add(key)
        self.names = whole
        for name in whole:
            for key in shorter(name) | {name}:
                self.near_whole[key].add(name)
        self.automaton = ahocorasick.Automaton()
        # a pattern may be a whole name, a word, or both
        for pattern in forms.keys() | whole.keys():
            self.automaton.add_word(pattern, (len(pattern), forms.get(pattern), whole.get(pattern)))
        if whole:
            self.automaton.make_automaton()
        self.known = lru_cache(1 << 16)(self._word_choices)

    def found(self, run: str) -> list[tuple[int, int, str | None, int | None]]:
        """(start, end, word, ref) of all mentions in run."""
        return [(end - n + 1, end + 1, word, ref) for end, (n, word, ref) in self.automaton.iter(run)] if self.names else []

    @staticmethod
    def mentions(found: list[tuple[int, int, str | None, int | None]], length: int) -> list[tuple[int, int, str | None, int | None]]:
        """Of the mentions in a run of this length the longest that do not overlap; the longer, then the earlier, first."""
        taken, out = bytearray(length), []
        for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
            if not any(taken[m[0] : m[1]]):
                taken[m[0] : m[1]] = b"\1" * (m[1] - m[0])
                out.append(m)
        return sorted(out, key=lambda m: m[0])

    def _word_choices(self, word: str) -> dict[str, float]:
        """The words of the list that word stands for by a slip or as an abbreviation, with their similarity."""
        out: dict[str, float] = {}
        for key in shorter(word) | {word}:
            for form in self.near_forms.get(key, ()):
                base = self.forms[form]
                # a form of the word itself is for the automaton to find
                if base != self.forms.get(word) and one_slip(word, form):
                    out[base] = max(out.get(base, 0.0), 1 - 1 / max(len(word), len(form)))
        for form, base in self.by_initial.get(word[:1], ()):
            if abbreviates(word, form):
                out[base] = max(out.get(base, 0.0), 0.5 + 0.3 * len(word) / len(form))
        return out

    def match(self, value: str) -> tuple[int, float, str] | None:
        """(ref_id, similarity, how) of the entry that value names, or None."""
        parts = words(fold(value))
        found = self._match(parts)
        if found is not None or value.isascii():
            return found
        other = words(spelled(value))
        return self._match(other) if other != parts else None

    def _match(self, parts: list[str]) -> tuple[int, float, str] | None:
        if not parts:
            return None
        run = "".join(parts)
        found = self.found(run)
        covered = self.mentions(found, len(run))
        if sum(e - s for s, e, _, _ in covered) == len(run):
            if len(covered) == 1 and covered[0][3] is not None:
                return covered[0][3], 1.0, "name"
            if all(w for _, _, w, _ in covered):
                ref = self.by_words.get(tuple(sorted(w for _, _, w, _ in covered)))
                if ref is not None:
                    return ref, 0.99, "words"
        best = self._similar(parts, {(s, e): w for s, e, w, _ in found if w})
        if best is None:
            for key in shorter(run) | {run}:
                for name in self.near_whole.get(key, ()):
                    if len(run) > 3 and one_slip(run, name):
                        score, ref = 1 - 1 / len(name), self.names[name]
                        if best is None or (score, -ref) > (best[0], -best[1]):
                            best = score, ref
        return (best[1], best[0], "similar") if best else None

    def _similar(self, parts: list[str], words_at: dict[tuple[int, int], str]) -> tuple[float, int] | None:
        """(similarity, ref) of the entry whose words pair best with parts; words_at: the words found at (start, end)."""
        choices: list[dict[str, float]] = []
        at = 0
        for part in parts:
            options = self.known(part)
            word = words_at.get((at, at + len(part)))
            if word is not None:
                options = options | {word: 1.0 if word == part else max(0.95, options.get(word, 0.0))}
            if not options:
                return None
            choices.append(options)
            at += len(part)
        # only entries that have a word for the part with the fewest candidates can win
        reach = [{key for word in options for key in self.having.get((word, len(parts)), ())} for options in choices]
        best: tuple[float, int] | None = None
        for key in min(reach, key=len):
            if all(key in r for r in reach):
                total = best_pairing([[options.get(word, 0.0) for word in key] for options in choices])
                if total is not None:
                    score, ref = total / len(parts), self.by_words[key]
                    if best is None or (score, -ref) > (best[0], -best[1]):
                        best = score, ref
        return best


#: Which kind of match comes before which.
_RANK = {"name": 2, "words": 1, "similar": 0}


def map_values(rows: DataFrame, value: str, reference: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """rows plus ref_id, similarity and how; all three are null where value names no entry.

    reference and aliases: ref_id, name. The list is read to the driver and sent to the
    tasks in blocks of MAX_ENTRIES names; of what the blocks yield the best kind of match
    counts (whole name, words, similarity), then the greatest similarity, then the least
    ref_id. Null, empty and blank values name nothing; of entries that fold to the same name
    the least ref_id counts. Rows are neither moved nor dropped, so a frequent value costs no
    more than a rare one. Columns of rows that have one of the three names are replaced. An
    empty list maps nothing.
    """
    kept = [c for c in rows.columns if c not in RESULT.names]
    listed = reference.where("ref_id IS NOT NULL AND name IS NOT NULL").select("ref_id", "name", F.lit(False).alias("alias"))
    if aliases is not None:
        listed = listed.unionByName(aliases.where("ref_id IS NOT NULL AND name IS NOT NULL").select("ref_id", "name", F.lit(True).alias("alias")))
    blocks = max(1, math.ceil(listed.count() / MAX_ENTRIES))
    mapped = rows.select(*kept, F.lit(None).cast(RESULT).alias("_match"))
    for block in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect() if blocks > 1 else listed.collect()
        udf = _block_udf(rows.sparkSession, [(r.ref_id, r.name) for r in part if not r.alias], [(r.ref_id, r.name) for r in part if r.alias])
        if blocks == 1:
            return rows.select(*kept, udf(F.col(value)).alias("_match")).select(*kept, "_match.*")
        # one block at a time in a task's memory
        both = mapped.withColumn("_next", udf(F.col(value)))
        better = F.col("_match").isNull() | F.col("_match.ref_id").isNull() | (_order("_next") > _order("_match"))
        mapped = cut(both.withColumn("_match", F.when(better, F.col("_next")).otherwise(F.col("_match"))).drop("_next"), f"mapped-{block}")
    return mapped.select(*kept, "_match.*")


def _order(match: str) -> Column:
    rank = F.coalesce(*[F.when(F.col(f"{match}.how") == how, F.lit(n)) for how, n in _RANK.items()], F.lit(-1))
    return F.struct(rank.alias("rank"), F.coalesce(f"{match}.similarity", F.lit(0.0)).alias("similarity"), F.coalesce(-F.col(f"{match}.ref_id"), F.lit(0)).alias("ref"))


def _block_udf(spark: SparkSession, entries: list[tuple[int, str]], aliases: list[tuple[int, str]]):
    shared, name, more = spark.sparkContext.broadcast((entries, aliases)), uuid.uuid4().hex, looks.prepare(spark)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        looks.install(more)
        match = lru_cache(REMEMBERED)(_matcher(name, shared).match)
        for batch in batches:
            found = [match(v) if isinstance(v, str) else None for v in batch]
            yield pd.DataFrame({
                "ref_id": pd.array([f[0] if f else None for f in found], dtype="Int64"),
                "similarity": pd.array([f[1] if f else None for f in found], dtype="Float64"),
                "how": pd.array([f[2] if f else None for f in found], dtype="string"),
            })

    return run


_prepared: dict[str, Matcher] = {}


def _matcher(key: str, shared) -> Matcher:
    """One matcher per Python worker and list."""
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = Matcher(*shared.value)
    return _prepared[key]
