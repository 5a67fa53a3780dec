"""Evaluation texts that leaked into training text.

Both sides are words in consistent form without case.

Verbatim passages: of the word n-grams of the items, those that occur in the corpus are
counted over all documents; in every window of MIN_RUN words of an item that can occur the
rarest n-gram becomes a seed, so no run of that length can be without one.

Edited copies: seeds are three words within four, in order, on either side. They survive a word
replaced, added or left out among any two that stay, and items of fewer words are seeds as
a whole.

Documents with a seed are aligned to the seed's item by Smith-Waterman, in the parts of the
document that an alignment through the seed can reach, unless the words there are too few
for the score that is asked for. The score rates edited and paraphrased copies; verbatim
ones must have a run of equal words in the alignment.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import looks
from tracelake.llm.looks import consistent
from tracelake.runtime import cut, spread

#: Words of an n-gram.
GRAM = 5
#: Words in a row that make a verbatim copy.
MIN_RUN = 13
#: Share of the greatest score an item can reach that makes an edited copy.
COPY_SHARE = 1 / 3
#: Words of the items sent to all tasks at once; more items are searched for block by block.
MAX_ITEM_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_WORD = re.compile(r"[^\W_]+")
#: A hyphen at a line end, inside a word.
_SPLIT = re.compile(r"(?<=[^\W_])[-‐‑­][ \t]*(?:\r\n|\r|\n)[ \t]*(?=[^\W_])")


#: ASCII letters without case, digits as they are, anything else a blank.
_PLAIN = str.maketrans({chr(c): chr(c).lower() if chr(c).isalnum() else " " for c in range(128)})


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits in consistent form, without case."""
    if not text:
        return []
    text = consistent(text)
    if "\n" in text or "\r" in text:
        joined = _SPLIT.sub("", text)
        if len(joined) < len(text):
            text = consistent(joined)
    return text.translate(_PLAIN).split() if text.isascii() else _WORD.findall(text.casefold())


def grams(tokens: list[str]) -> list[str]:
    return [" ".join(tokens[i : i + GRAM]) for i in range(len(tokens) - GRAM + 1)]


def triples(tokens: list) -> Iterator[tuple[int, tuple]]:
    """(position, words) of every three words within four, the first of them at position; of fewer than three words all of them."""
    n = len(tokens)
    if 0 < n < 3:
        yield 0, tuple(tokens)
    for i in range(n - 2):
        a, b, c = tokens[i : i + 3]
        yield i, (a, b, c)
        if i + 3 < n:
            d = tokens[i + 3]
            yield i, (a, b, d)
            yield i, (a, c, d)


class Items:
    """The words of the items' texts, by row, as an item may have several texts, and the numbers of their n-grams."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.item = [item for item, _ in rows]
        self.words = {row: words(text) for row, (_, text) in enumerate(rows)}
        self.number: dict[str, int] = {}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for row, tokens in self.words.items():
            for at, gram in enumerate(grams(tokens)):
                n = self.number.setdefault(gram, len(self.number))
                self.places[n].append((row, at))

    def seeds(self, counts: dict[int, int]) -> set[int]:
        """Numbers of the n-grams to join by, from the documents that have each (none: not in the corpus).

        Of each window of MIN_RUN words that the corpus can have, the rarest: a document with
        the window has all its n-grams.
        """
        out = set()
        for tokens in self.words.values():
            numbers = [self.number[g] for g in grams(tokens)]
            width = MIN_RUN - GRAM + 1
            for i in range(len(numbers) - width + 1):
                window = numbers[i : i + width]
                if all(n in counts for n in window):
                    out.add(min(window, key=lambda n: (counts[n], n)))
        return out

    def triple_places(self) -> dict[tuple, list[tuple[int, int]]]:
        """(row, position) of every triple of the items."""
        out: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for row, tokens in self.words.items():
            for at, triple in triples(tokens):
                out[triple].append((row, at))
        return dict(out)


def align_many(document: np.ndarray, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman scores, longest runs of equal words) of a document against items, all arrays of word numbers."""
    width = max(map(len, items))
    grid = np.full((len(items), width), -2, dtype=np.int32)
    for i, item in enumerate(items):
        grid[i, : len(item)] = item
    steps = np.arange(width, dtype=np.int32) * -GAP
    above = np.zeros((len(items), width + 1), dtype=np.int32)
    runs = np.zeros((len(items), width + 1), dtype=np.int32)
    best, longest = np.zeros((len(items), width), dtype=np.int32), np.zeros((len(items), width), dtype=np.int32)
    for word in document.tolist():
        if word < 0:
            # the word is in no item: nothing matches, and what was reached loses a gap or a mismatch
            new = np.maximum(above[:, :-1] + MISMATCH, above[:, 1:] + GAP)
            runs[:, 1:] = 0
        else:
            same = grid == word
            new = np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP)
            runs[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
            np.maximum(longest, runs[:, 1:], out=longest)
        new = np.maximum.accumulate(np.maximum(new, 0) + steps, axis=1) - steps
        above[:, 1:] = new
        np.maximum(best, new, out=best)
    return best.max(axis=1, initial=0), longest.max(axis=1, initial=0)


def align(document: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """align_many for one item."""
    scores, runs = align_many(document, [item])
    return int(scores[0]), int(runs[0])


def _reach(places: list[tuple[int, int]], item_length: int, document_length: int) -> list[tuple[int, int]]:
    """Parts of the document an alignment through one of the (position in document, position in item) can cover.

    i words of the item score MATCH each at most, and every other word of the document costs
    a gap, so an alignment that pays takes no more than i and MATCH times i words before the seed.
    """
    wide = 1 + MATCH // -GAP
    spans = sorted((max(0, d - wide * i - GRAM), min(document_length, d + wide * (item_length - i) + GRAM)) for d, i in places)
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def _score(tokens: list[str], met: dict[int, list[tuple[int, int]]], item_of: list, row_words: dict[int, list[str]], edited: bool) -> list[tuple]:
    """(item, score, run) of the items whose rows are met in the document at (position in document, position in item)."""
    ids: dict[str, int] = {}
    for row in met:
        for word in row_words[row]:
            ids.setdefault(word, len(ids))
    # words that no item has are -1
    numbers = np.fromiter((ids.get(w, -1) for w in tokens), dtype=np.int32, count=len(tokens))
    wanted = {row: np.array([ids[w] for w in row_words[row]], dtype=np.int32) for row in met}
    least = {row: COPY_SHARE * MATCH * len(wanted[row]) if edited else MATCH * MIN_RUN for row in met}
    spans: dict[tuple[int, int], list[int]] = {}
    for row, pairs in met.items():
        for span in _reach(pairs, len(wanted[row]), len(tokens)):
            spans.setdefault(span, []).append(row)
    best: dict[int, tuple[int, int]] = {}
    low, high, rows = 0, -1, set()
    for (start, end), here in [*sorted(spans.items()), ((len(tokens) + 1, len(tokens) + 1), [])]:
        if start <= high:
            high = max(high, end)
            rows.update(here)
            continue
        if rows:
            part = numbers[low:high]
            present = np.zeros(len(ids), dtype=bool)
            present[part[part >= 0]] = True
            # no alignment scores more than the words it can match
            able = [row for row in rows if MATCH * int(present[wanted[row]].sum()) >= least[row]]
            if able:
                for row, score, run in zip(able, *align_many(part, [wanted[row] for row in able]), strict=True):
                    known = best.get(row, (0, 0))
                    best[row] = max(known[0], int(score)), max(known[1], int(run))
        low, high, rows = start, end, set(here)
    of_item: dict = {}
    for row, (score, longest) in best.items():
        if score >= least[row] and (edited or longest >= MIN_RUN):
            share, run = of_item.get(item_of[row], (0.0, 0))
            of_item[item_of[row]] = max(share, score / (MATCH * len(wanted[row]))), max(run, longest)
    return [(item, share, run) for item, (share, run) in of_item.items()]


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", edited: bool = False) -> DataFrame:
    """(key, item_id, score, run) of the documents with MIN_RUN words in a row of an item, or, if edited, with a copy of COPY_SHARE.

    items: item_id, text; an item with several texts is found by any of them, with the
    greatest score and run. score is the alignment's score as a share of the greatest one
    the item can reach, run the longest run of equal words in it. Items are read to the
    driver, in blocks of MAX_ITEM_WORDS. Rows with null key or text, and blank texts, hold
    nothing. Repeated rows are listed once. No items or documents: no rows.
    """
    listed = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    size = listed.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // MAX_ITEM_WORDS))
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    kinds = {"id": dict(documents.dtypes)[key], "item_id": dict(items.dtypes)["item_id"]}
    search = _edited if edited else _verbatim
    found = None
    for block in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else listed
        one = search(rows, Items(sorted((r.item_id, r.text) for r in part.collect())), kinds)
        found = one if found is None else found.unionByName(one)
    return found.distinct().withColumnRenamed("id", key)


def _verbatim(rows: DataFrame, known: Items, kinds: dict[str, str]) -> DataFrame:
    spark, more = rows.sparkSession, looks.prepare(rows.sparkSession)
    number = spark.sparkContext.broadcast(known.number)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks.install(more)
        automaton = ahocorasick.Automaton()
        for gram, n in number.value.items():
            automaton.add_word(f" {gram} ", n)
        if number.value:
            automaton.make_automaton()
        for batch in batches:
            keys, texts, found = [], [], []
            for k, body in zip(batch["id"], batch["text"], strict=True):
                line = f" {' '.join(words(body))} "
                hits = {n for _, n in automaton.iter(line)} if number.value else None
                if hits:
                    keys.append(k)
                    texts.append(line[1:-1])
                    found.append(sorted(hits))
            if keys:
                yield pd.DataFrame({"id": keys, "words": texts, "grams": found})

    with_grams = cut(spread(rows).mapInPandas(find, f"id {kinds['id']}, words string, grams array<int>"), "leaks")
    # as many rows as the items have n-grams
    counts = {r.g: r.n for r in with_grams.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    seeds = known.seeds(counts)
    seeded = with_grams.where(F.arrays_overlap("grams", F.array(*[F.lit(n) for n in sorted(seeds)]))) if 0 < len(seeds) <= 1000 else with_grams
    shared = spark.sparkContext.broadcast((known.item, known.words, {g: n for g, n in known.number.items() if n in seeds}, {n: known.places[n] for n in seeds}))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item_of, row_words, seed, places = shared.value
        for batch in batches:
            out: list[tuple] = []
            for k, body in zip(batch["id"], batch["words"], strict=True):
                tokens = body.split(" ")
                met: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for at, gram in enumerate(grams(tokens)):
                    n = seed.get(gram)
                    if n is not None:
                        for row, where in places[n]:
                            met[row].append((at, where))
                if met:
                    out.extend((k, *found) for found in _score(tokens, met, item_of, row_words, False))
            if out:
                yield pd.DataFrame(out, columns=["id", "item_id", "score", "run"])

    return spread(seeded.select("id", "words")).mapInPandas(score, f"id {kinds['id']}, item_id {kinds['item_id']}, score double, run int")


def _edited(rows: DataFrame, known: Items, kinds: dict[str, str]) -> DataFrame:
    spark, more = rows.sparkSession, looks.prepare(rows.sparkSession)
    shared = spark.sparkContext.broadcast((known.item, known.words, known.triple_places()))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks.install(more)
        item_of, row_words, places = shared.value
        vocabulary = {w for tokens in row_words.values() for w in tokens}
        short = {len(t) for t in places if len(t) < 3}
        least = {row: COPY_SHARE * len(tokens) for row, tokens in row_words.items()}
        bags = {row: Counter(tokens) for row, tokens in row_words.items()}
        for batch in batches:
            out: list[tuple] = []
            for k, body in zip(batch["id"], batch["text"], strict=True):
                tokens = words(body)
                met: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for at, triple in triples([w if w in vocabulary else None for w in tokens]):
                    for row, where in places.get(triple, ()):
                        met[row].append((at, where))
                for n in short:
                    for at in range(len(tokens) - n + 1):
                        for row, where in places.get(tuple(tokens[at : at + n]), ()):
                            met[row].append((at, where))
                present = set(tokens)
                # rows of which the whole document has too few words need no closer look
                met = {row: at for row, at in met.items() if sum(n for w, n in bags[row].items() if w in present) >= least[row]}
                if met:
                    out.extend((k, *found) for found in _score(tokens, met, item_of, row_words, True))
            if out:
                yield pd.DataFrame(out, columns=["id", "item_id", "score", "run"])

    return spread(rows).mapInPandas(score, f"id {kinds['id']}, item_id {kinds['item_id']}, score double, run int")
