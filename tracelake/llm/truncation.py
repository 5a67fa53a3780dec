"""Texts that were cut off by a field limit or in transfer.

A text is a row of units: its lines, and the sentences within them. The last unit is in
question where no closing punctuation ends it (marks and blanks that were put behind a cut
do not count). It is a prefix to be looked up among all units of all texts: if it stops
where other units go on, inside a word or before the next one, the rest was lost; if other
units stop there too, it is complete, as headings, list items, table rows, code,
signatures and references are.

The look-up is a self-join by hashed prefixes of a fixed number of tokens. The longest
prefix counts that a few other units share: up to 16 tokens back, to the start of the
unit, and where they do not, the last few tokens only. Numbers count as equal. Units
are reduced to distinct ones with their counts; the prefixes of all units are hashed at once in
arrays, and those that nothing asks for are left out where they are made, so only what can
decide a question is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.runtime import cut, spread, tasks

#: Lengths of prefixes in tokens, the longest first; only the first may begin at the start of a unit.
LENGTHS = (16, 6, 4, 3, 2)
#: A context this short shows a cut only inside a word that is never whole there.
SHORT = 2
#: Other units a prefix should be met in; where no prefix is, the longest one met at all counts.
WITNESSES = 3
#: Contexts in question that are sent to all tasks (8 bytes each); more of them are met by a shuffle.
SENT_CONTEXTS = 1_000_000
#: Letters up to which every beginning of a word is looked up by itself; longer pieces are compared with the words they may begin.
LONG_PIECE = 64
#: Units a task counts before it passes them on.
HELD_UNITS = 100_000
START = "\u0002"

# Words that mark a cut within brackets.
CUT_WORDS = "cut|cut off|more|read more|trunc|truncated|snip|snipped|continued|cont|abridged|clipped|rest|omitted|gekürzt|cortado|截断|省略"
#: What is put behind a cut.
MARKS = re.compile(
    rf"(?:\s|�|…|\.{{2,}}|[-–—>»~]{{2,}}|[\[(<{{]\s*(?:(?:{CUT_WORDS})\b[^\])>}}]*|…|\.{{2,}})[\])>}}])+$", re.IGNORECASE
)
#: The last mark of a cut within brackets, and what else may stand behind a cut.
_BRACKETED = re.compile(rf"[\[(<{{]\s*(?:(?:{CUT_WORDS})\b[^\])>}}]*|…|\.{{2,}})[\])>}}]\Z", re.IGNORECASE)
_TRAILING = " \t\r\n\f\v…�"
_UNITS = re.compile(r"(?<=[.!?])\s+|(?<=[。？！])|[\r\n]+")
_TOKENS = re.compile(r"[⺀-鿿]|[^\W\d_⺀-鿿]+|\d+|[^\w\s]|_+")
#: A line that opens or closes a block of code.
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.MULTILINE)
_CLOSED = tuple(".!?。？！")


def tokens(unit: str) -> str:
    """The unit's tokens, one blank between; numbers are 0, ideographs tokens of their own."""
    return " ".join("0" if t.isdigit() else t for t in _TOKENS.findall(unit))


def stripped(text: str) -> str:
    """text without the marks of a cut and blanks behind it: what MARKS.sub("", text) leaves, looking at the end only."""
    end = len(text)
    while end:
        last = text[end - 1]
        if last.isspace() or last in _TRAILING:
            end -= 1
        elif last in ".-–—>»~" and (n := _repeated(text, end, last)):
            # the first of the arrows may close a bracket, with no or several marks behind it
            arrow = text.find(">", end - n, end)
            start = _opened(text, arrow + 1) if arrow >= 0 and end - arrow - 1 != 1 else -1
            end = start if start >= 0 else end - n
        elif last in "])>}":
            start = _opened(text, end)
            if start < 0:
                break
            end = start
        else:
            break
    return text[:end]


def _opened(text: str, end: int) -> int:
    """Where the bracketed mark of a cut begins that ends at end; -1 if none does."""
    start = max(text.rfind(c, 0, end) for c in "[(<{")
    return start if start >= 0 and _BRACKETED.match(text, start, end) else -1


def _repeated(text: str, end: int, last: str) -> int:
    """How many characters of the mark that ends at end there are: dots, or dashes and arrows; 0 if it is but one."""
    run = "." if last == "." else "-–—>»~"
    at = end
    while at and text[at - 1] in run:
        at -= 1
    return end - at if end - at > 1 else 0


def units(text: str) -> tuple[list[str], str | None, bool, bool]:
    """(units before the last, the last one, whether it is in question, whether a mark of a cut was behind it)."""
    return _body_units(text, stripped(text))


def _body_units(text: str, body: str) -> tuple[list[str], str | None, bool, bool]:
    marked = bool(text[len(body) :].strip())
    parts = [p for p in map(tokens, _UNITS.split(body)) if p]
    if not parts:
        return [], None, False, False
    fenced = set(parts[-1]) <= set("`~ ") and len(_FENCE.findall(body)) % 2 == 0
    return parts[:-1], parts[-1], not fenced and not parts[-1].endswith(_CLOSED), marked


def _split():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def passed() -> pd.DataFrame:
            return pd.DataFrame({"id": pd.array([None] * len(held), dtype="Int64"), "unit": list(held), "n": list(held.values()), "marked": False, "body": pd.array([None] * len(held), dtype="Int64")})

        for batch in batches:
            keys, last, marks, bodies = [], [], [], []
            for k, text, counts in zip(batch["id"], batch["text"], batch["counts"], strict=True):
                body = stripped(text)
                before, end, open_, mark = _body_units(text, body)
                if counts:
                    held.update(before)
                    if end and not open_:
                        held[end] += 1
                if end and open_:
                    keys.append(k)
                    last.append(end)
                    marks.append(mark)
                    bodies.append(int.from_bytes(hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True))
            if keys:
                yield pd.DataFrame({"id": pd.array(keys, dtype="Int64"), "unit": last, "n": 0, "marked": marks, "body": pd.array(bodies, dtype="Int64")})
            if len(held) > HELD_UNITS:
                yield passed()
                held.clear()
        if held:
            yield passed()

    return run


#: What can begin a unit of its own.
_OPENS = regex.compile(r"[\p{Lu}#*•=|\[`(>-]")
_STOP, _ON, _START = 0, 1, 2


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with every bit depending on every other."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def contexts(rows: list[str], last_only: bool = False) -> pd.DataFrame:
    """(row, token, next, k, ctx): every token of the units, or their last ones, with the hash of what comes before it, for each length.

    next is _STOP at the end of the unit, _START where what follows could begin a unit of
    its own that was put on the same line, else _ON. Letter case does not count.
    """
    raw = [unit.split(" ") for unit in rows]
    lengths = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    flat = [t for r in raw for t in (START, *r)]
    codes, names = pd.factorize(np.array(flat, dtype=object))
    lower = np.array([n.lower() for n in names], dtype=object)
    hashes = np.array([xxhash.xxh3_64_intdigest(n.encode("utf-8", "surrogatepass")) for n in lower], dtype=np.uint64)[codes]
    opens = np.array([bool(_OPENS.match(n)) for n in names])[codes]
    row = np.repeat(np.arange(len(rows)), lengths)
    at = np.arange(len(flat)) - first[row]
    ends = at == lengths[row] - 1
    follows = np.where(ends, _STOP, np.where(np.roll(opens, -1), _START, _ON)).astype(np.int8)
    wanted = ends & (at > 0) if last_only else at > 0
    out = []
    acc = np.zeros(len(flat), dtype=np.uint64)
    for m in range(1, LENGTHS[0] + 1):
        before = np.zeros(len(flat), dtype=np.uint64)
        before[m:] = hashes[:-m]
        before[at < m] = 0
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + before
        if m in LENGTHS:
            here = np.flatnonzero(wanted if m == LENGTHS[0] else wanted & (at >= m))
            out.append(pd.DataFrame({"row": row[here], "token": lower[codes[here]], "next": follows[here], "k": np.int32(m), "ctx": _mixed(acc[here] + np.uint64(m)).view(np.int64)}))
    return pd.concat(out, ignore_index=True)


_SEEN = "k int, ctx bigint, token string, stops bigint, goes_on bigint, maybe bigint"


def _seen(asked: np.ndarray | None):
    """Counts (unit, n_before, n_last) to what follows each context of asked (sorted), or each context at all, added up within a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = contexts(batch["unit"].tolist())
            if asked is not None:
                place = np.minimum(np.searchsorted(asked, x["ctx"].to_numpy()), max(len(asked) - 1, 0))
                x = x[asked[place] == x["ctx"].to_numpy()] if len(asked) else x[:0]
            if x.empty:
                continue
            before, last = batch["n_before"].to_numpy()[x["row"]], batch["n_last"].to_numpy()[x["row"]]
            follows = x["next"].to_numpy()
            counts = {"stops": np.where(follows == _STOP, before + last, 0), "goes_on": np.where(follows == _ON, before, 0), "maybe": np.where(follows == _START, before, 0)}
            yield x[["k", "ctx", "token"]].assign(**counts).groupby(["k", "ctx", "token"], as_index=False, sort=False).sum()

    return run


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not batch.empty:
            x = contexts(batch["unit"].tolist(), last_only=True)
            yield pd.DataFrame({"unit": batch["unit"].to_numpy()[x["row"]], "own": batch["own"].to_numpy()[x["row"]], "k": x["k"], "ctx": x["ctx"], "piece": x["token"]})


def cut_units(counted: DataFrame, questions: DataFrame) -> DataFrame:
    """(unit, verdict, k): cut or complete, for the units of questions (unit, own) that other units tell something about.

    counted: unit, n_before (times it is followed or closed) and n_last (distinct texts it
    ends unclosed). One of the texts that end with the unit is not a witness: it is the one in
    question. own is how often the unit is found in all. k is the length of the prefix that decided.
    """
    spark = counted.sparkSession
    asked = cut(spread(questions).mapInPandas(_asked, "unit string, own bigint, k int, ctx bigint, piece string"), "truncation-asked")
    keys = asked.select("ctx").distinct()
    if keys.count() <= SENT_CONTEXTS:
        sent = np.sort(keys.toPandas()["ctx"].to_numpy(dtype=np.int64))
        seen = spread(counted).mapInPandas(_seen(sent), _SEEN)
    else:
        seen = spread(counted).mapInPandas(_seen(None), _SEEN).join(keys, "ctx", "left_semi")
    # read three times below
    seen = cut(seen.groupBy("k", "ctx", "token").agg(*[F.sum(c).alias(c) for c in ("stops", "goes_on", "maybe")]), "truncation-seen")
    # a token is met as a whole, and by each of its beginnings
    none = F.lit(0).cast("long")
    met = F.col("stops") + F.col("goes_on") + F.col("maybe")
    whole = seen.select("k", "ctx", F.col("token").alias("piece"), "stops", "goes_on", "maybe", met.alias("whole"))
    words = seen.where(F.col("token").rlike(r"^\p{L}{2,}$")).select("k", "ctx", "token", met.alias("n"))
    lengths = F.sequence(F.lit(1), F.least(F.length("token") - 1, F.lit(LONG_PIECE)))
    begun = words.select("k", "ctx", F.explode(F.transform(lengths, lambda n: F.substring("token", F.lit(1), n))).alias("piece"), "n")
    # a piece longer than that meets the words that share so many letters, and is compared with them
    long = words.where(F.length("token") > LONG_PIECE + 1).withColumn("start", F.substring("token", 1, LONG_PIECE))
    pieces = asked.where(F.length("piece") > LONG_PIECE).select("k", "ctx", "piece", F.substring("piece", 1, LONG_PIECE).alias("start")).distinct()
    longer = pieces.join(long, ["k", "ctx", "start"]).where(F.startswith("token", "piece") & (F.length("token") > F.length("piece")))
    begun = begun.unionByName(longer.select("k", "ctx", "piece", "n")).select("k", "ctx", "piece", none.alias("stops"), F.col("n").alias("goes_on"), none.alias("maybe"), none.alias("whole"))
    pieces = whole.unionByName(begun).groupBy("k", "ctx", "piece").agg(*[F.sum(c).alias(c) for c in ("stops", "goes_on", "maybe", "whole")])
    judged = asked.join(pieces, ["k", "ctx", "piece"])
    judged = judged.withColumn("stops", F.greatest(F.col("stops") - 1, none)).withColumn("whole", F.col("whole") - F.col("own"))
    unsure = (F.col("k") <= SHORT) & (F.col("whole") > 0)
    for c in ("goes_on", "maybe"):
        judged = judged.withColumn(c, F.when(unsure, none).otherwise(F.col(c)))
    judged = judged.withColumn("met", met).where("met > 0")
    first = judged.groupBy("unit").agg(F.max_by(F.struct("stops", "goes_on", "maybe", "met", "k"), F.struct(F.col("met") >= WITNESSES, "k")).alias("x")).select("unit", "x.*")
    verdict = F.when(F.expr(f"goes_on > stops OR (stops = 0 AND met >= {WITNESSES})"), "cut").when(F.expr("stops > goes_on + maybe"), "complete")
    return first.select("unit", verdict.alias("verdict"), "k").where("verdict IS NOT NULL")


def judged_texts(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k) of the rows whose text was cut, each key once, with the length in tokens of the prefix that shows it, null for a mark alone.

    Null and blank texts, and null keys, are no cases. Copies of a text count as one
    witness, whatever mark of a cut is behind each. key must be a whole number.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(text).rlike(r"\S")).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    digest = F.xxhash64("text")
    first = rows.groupBy(digest.alias("digest")).agg(F.min("id").alias("id"), F.lit(True).alias("counts"))
    placed = rows.withColumn("digest", digest).repartition(tasks(rows), "digest", "id")
    marked = placed.join(first, ["digest", "id"], "left").select("id", "text", F.coalesce("counts", F.lit(False)).alias("counts"))
    split = cut(marked.mapInPandas(_split(), "id bigint, unit string, n bigint, marked boolean, body bigint"), "truncation-units")
    counted = cut(split.groupBy("unit").agg(F.sum("n").alias("n_before"), F.count_distinct("body").alias("n_last")), "truncation-counts")
    verdicts = cut_units(counted, counted.where("n_last > 0").select("unit", (F.col("n_before") + F.col("n_last")).alias("own")))
    last = split.where("id IS NOT NULL").join(verdicts, "unit", "left")
    # behind a mark, only what others show to be complete is no cut
    found = last.where("verdict = 'cut' OR (marked AND verdict IS NULL)")
    return found.groupBy(F.col("id").alias(key)).agg(F.max("k").alias("k"))


def cut_texts(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the rows whose text was cut, each key once; see judged_texts."""
    return judged_texts(rows, key, text).select(key)


def cut_shares(rows: DataFrame, found: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(source, n_texts, n_cut, cut_share) per source, compared trimmed and in lower case; null is a source of its own."""
    named = rows.select(F.col(key).cast("long").alias("id"), F.lower(F.trim(source)).alias("source")).join(found.select(F.col(key).alias("id"), F.lit(1).alias("hit")), "id", "left")
    return named.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count("hit").alias("n_cut"), (F.count("hit") / F.count(F.lit(1))).alias("cut_share")
    )
