"""Text that looks the same in one consistent form of characters.

Characters that are stable under composition and have no look-alike form are the rule.
A quick-check table, derived from the Unicode character data of the running Python, names
all others: wide, narrow, font and presentation forms, combining marks and other
characters that may join the one before them, invisible characters, and blanks other than
the ordinary one. A segment is a run of such characters with the one character before it,
its boundary context; only segments are normalized and spliced back. Runs of letters that
mix scripts are then brought to one script by a table of look-alikes.

The look-alikes of Cyrillic, Greek and Armenian are listed here, as a word of these scripts
may be meant; those of all other scripts, and of Latin letters outside the usual alphabets,
are read from Unicode's confusables data, which the JVM's ICU library has.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјӏорсухһԁԛԝѵ", "ABESIJKMHOPCTYXaesijlopcyxhdqwv", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹαινορυχϲϳ", "ABEZHIKMNOPTYXCaivopuxcj", strict=True))
ARMENIAN = dict(zip("օսհցՕՍ", "ouhgOU", strict=True))
# Compatibility kinds whose characters look like what they decompose to.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Ignorable characters that are not of category Cf.
IGNORABLE = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
# Format characters that are seen (number and verse signs of Arabic, Syriac and Kaithi).
SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
LISTED = {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN}
#: Scripts whose words stand beside Latin ones without a blank, by the first word of their characters' names.
UNSPACED = {"CJK", "HANGUL", "HIRAGANA", "KATAKANA", "BOPOMOFO", "YI", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN"}
#: Latin letters that may be look-alikes: phonetic ones and others outside national alphabets.
RARE_LATIN = [(0x180, 0x2B0), (0x1D00, 0x1DC0), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xAB30, 0xAB70)]

#: What a text can have that calls for another form, in the order of the flags of kinds().
KINDS = ("full_width", "parted_accent", "ligature", "invisible", "blank", "mixed_script", "other_form")
#: Texts of these characters are in the consistent form already.
STABLE = r"^[\x20-\x7e\t\r\n]*$"

#: A run of letters; accents that stand apart belong to it.
_LETTERS = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")


class Table:
    """The quick-check table: what to replace, and the pattern of segments."""

    def __init__(self) -> None:
        self.to: dict[str, str] = {}
        self.kind: dict[str, int] = {}
        unstable: list[int] = []
        for code in range(0x80, sys.maxunicode + 1):
            char = chr(code)
            category = unicodedata.category(char)
            if category in ("Cn", "Co", "Cs"):
                continue
            parts = unicodedata.decomposition(char)
            if (category == "Cf" and code not in SEEN_FORMAT) or char in IGNORABLE:
                self.to[char], self.kind[char] = "", 3
            elif category == "Zs":
                self.to[char], self.kind[char] = " ", 4
            elif parts.startswith("<"):
                tag = parts.split(" ", 1)[0]
                if tag in SAME_LOOK or (tag == "<compat>" and (category[0] == "L" or category == "Nl" or 0x2F00 <= code < 0x2FE0)):
                    self.to[char] = unicodedata.normalize("NFKC", char)
                    ligature = 0xFB00 <= code < 0xFE00 or 0xFE70 <= code < 0xFF00
                    self.kind[char] = 0 if tag in ("<wide>", "<narrow>") else 2 if ligature else 6
                elif unicodedata.normalize("NFC", char) == char:
                    continue
            elif unicodedata.combining(char) or category in ("Mn", "Mc"):
                self.kind[char] = 1
            elif unicodedata.normalize("NFC", char) != char:
                self.kind[char] = 6
            elif 0x1161 <= code < 0x1200:
                self.kind[char] = 1  # joins the Hangul letter before it
            else:
                continue
            unstable.append(code)
        self.to["‐"] = self.to["‑"] = "-"
        self.kind["‐"] = self.kind["‑"] = 6
        unstable.append(0x2010)
        spans: list[list[int]] = []
        for code in sorted(unstable):
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
        marks = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in spans)
        self.marks = re.compile(f"[{marks}]+")
        self.table = str.maketrans(self.to)


@lru_cache(1)
def table() -> Table:
    return Table()


def _splice(segment: str) -> str:
    return unicodedata.normalize("NFC", segment.translate(table().table))


def spliced(text: str, splice: Callable[[str], str] | None = None) -> str:
    """text with its segments, each a run of unstable characters and the character before it, normalized in place."""
    splice, out, done = splice or _splice, [], 0
    for match in table().marks.finditer(text):
        start = max(match.start() - 1, done)
        out += text[done:start], splice(text[start : match.end()])
        done = match.end()
    return "".join((*out, text[done:])) if out else text


class Scripts:
    """Look-alikes by script, and the pattern of letters that call for a look at their run."""

    def __init__(self, more: dict[str, str]):
        #: What Unicode's data added; it goes to the workers.
        self.more = more
        self.to_latin: dict[str, dict[str, str]] = {name: dict(pairs) for name, pairs in LISTED.items()}
        self.rare: dict[str, str] = {}
        for char, latin in more.items():
            name = unicodedata.name(char, "").split(" ", 1)[0]
            if name == "LATIN":
                self.rare[char] = latin
            elif name not in LISTED:
                self.to_latin.setdefault(name, {})[char] = latin
        self.script = lru_cache(1 << 16)(self._script)
        letters = "".join(map(re.escape, sorted(self.rare)))
        self.rare_pattern = re.compile(f"[{letters}]") if letters else None

    def _script(self, char: str) -> str:
        """LATIN, or a script that has look-alikes of Latin letters, for its letters; else ''."""
        if not unicodedata.category(char).startswith("L"):
            return ""
        name = unicodedata.name(char, "").split(" ", 1)[0]
        return name if name == "LATIN" or name in self.to_latin else ""


_scripts = Scripts({})


def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Letters that look like one ASCII letter by Unicode's confusables data: of scripts not listed here, and rare Latin ones.

    Capital letters keep their case where the data name the small l for both.
    """
    letters = [
        c for c in map(chr, range(0x180, 0x20000))
        if unicodedata.category(c).startswith("L") and not unicodedata.decomposition(c)
        and unicodedata.name(c, "").split(" ", 1)[0] not in UNSPACED | LISTED.keys()
        and (not unicodedata.name(c, "").startswith("LATIN ") or any(a <= ord(c) < b for a, b in RARE_LATIN))
    ]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    same = checker.getSkeleton("\n".join(letters)).split("\n")
    found = {c: s for c, s in zip(letters, same, strict=True) if len(s) == 1 and s.isascii() and s.isalpha()}
    return {c: "I" if s == "l" and unicodedata.category(c) == "Lu" else s for c, s in found.items()}


def install(more: dict[str, str]) -> None:
    """Use these look-alikes in this process, a worker; the driver's come from prepare()."""
    global _scripts
    if more != _scripts.more:
        _scripts = Scripts(more)


def prepare(spark: SparkSession | None = None) -> dict[str, str]:
    """The look-alikes to install in workers; read once in a driver process. Without a session only the listed ones are known."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and not _scripts.more:
        install(lookalikes(spark))
    return _scripts.more


def script(char: str) -> str:
    return _scripts.script(char)


def _base(char: str) -> tuple[str, str]:
    parts = unicodedata.normalize("NFD", char)
    return parts[0], parts[1:]


def _one_script(match: re.Match) -> str:
    """The run in one script: the one with letters that have no look-alike, else that of most letters, else Latin."""
    run, before = match.group(), ""
    if run.isascii():
        return run
    if _scripts.rare_pattern and any("a" <= c.lower() <= "z" for c in run):
        run = _scripts.rare_pattern.sub(lambda m: _scripts.rare[m.group()], run)
    while run != before and not run.isascii():
        run, before = _nearer_one_script(run), run
    return run


def _nearer_one_script(run: str) -> str:
    own = [script(c) for c in run]
    present = {s for s in own if s}
    if len(present) < 2:
        return run
    others = present - {"LATIN"}
    if len(others) > 1 or "LATIN" not in present:
        goal = "LATIN"
    else:
        (other,) = others
        there = _scripts.to_latin[other]
        back = {b: a for a, b in there.items()}
        only_other = any(s == other and _base(c)[0] not in there for c, s in zip(run, own, strict=True))
        only_latin = any(s == "LATIN" and _base(c)[0] not in back for c, s in zip(run, own, strict=True))
        if only_other and only_latin:
            return run
        n_other, n_latin = own.count(other), own.count("LATIN")
        goal = other if only_other or (not only_latin and n_other > n_latin) else "LATIN"
        if goal == other:
            turn = {"LATIN": back}
    if goal == "LATIN":
        turn = _scripts.to_latin
    out = []
    for char, s in zip(run, own, strict=True):
        base, marks = _base(char)
        swap = turn.get(s, {}).get(base)
        out.append(swap + marks if swap else char)
    return unicodedata.normalize("NFC", "".join(out))


#: Letters beyond U+024F other than ideographs, syllables and kana: without one no run mixes scripts.
_OTHER_LETTERS = re.compile("[\u0250-\u2fff\ua000-\uabff\ufb00-\ufeff\U00010000-\U0001ffff]|[\u0180-\u024f]")
#: Letters to turn before compatibility folding would make them another letter.
_EARLY = re.compile("[\u03f2\u03f9]")


def _turned(text: str) -> str:
    return _LETTERS.sub(_one_script, text) if _OTHER_LETTERS.search(text) else text


def consistent(text: str) -> str:
    """text in the consistent form. Idempotent; ASCII text, letter case and ordinary blanks stay as they are."""
    if text.isascii():
        return text
    if _EARLY.search(text):
        text = _turned(text)
    return _turned(spliced(text))


def analysed(text: str) -> tuple[str, list[bool]]:
    """(consistent form, which of KINDS made it another). A kind counts where splicing changed a segment with it.

    Scripts mixed in one run of letters count even where no look-alike helps.
    """
    found = [False] * len(KINDS)
    if text.isascii():
        return text, found
    for match in _LETTERS.finditer(text) if _OTHER_LETTERS.search(text) else ():
        if not match.group().isascii() and len({s for s in map(script, match.group()) if s}) > 1:
            found[5] = True
            break
    prepared = _turned(text) if _EARLY.search(text) else text
    found[6] = prepared != text
    kind = table().kind

    def splice(part: str) -> str:
        new = _splice(part)
        if new != part:
            for char in part:
                k = kind.get(char)
                if k is not None:
                    found[k] = True
        return new

    straight = spliced(prepared, splice)
    form = _turned(straight)
    found[6] = found[6] or (form != straight and not found[5])
    return form, found


def kinds(text: str) -> list[bool]:
    """Which of KINDS text has."""
    return analysed(text)[1]


_ANALYSED = T.StructType([T.StructField("form", T.StringType()), T.StructField("kinds", T.ArrayType(T.BooleanType()))])


def _consistent_udf(col: Column) -> Column:
    more = prepare()

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        install(more)
        return texts.map(consistent, na_action="ignore")

    return run(col)


def _analysed_udf(col: Column) -> Column:
    more = prepare()

    @F.pandas_udf(_ANALYSED)
    def run(texts: pd.Series) -> pd.DataFrame:
        install(more)
        return pd.DataFrame([analysed(t) if isinstance(t, str) else (None, None) for t in texts], columns=["form", "kinds"])

    return run(col)


def _stable(col: Column) -> Column:
    return col.rlike(STABLE)


def consistent_form(col: Column | str) -> Column:
    """The text in its consistent form; null stays null, empty stays empty.

    Stable texts never leave the JVM: the Python function gets null in their place.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.when(_stable(col), col).otherwise(_consistent_udf(F.when(~_stable(col), col)))


def looks_flags(col: Column | str) -> Column:
    """array<boolean>, one entry for each of KINDS; null for null and for stable texts."""
    col = F.col(col) if isinstance(col, str) else col
    return _analysed_udf(F.when(~_stable(col), col))["kinds"]


def unusual_texts(rows: DataFrame, record_id: str, text: str) -> DataFrame:
    """(record_id, kinds, text, form) of the rows whose text has one of KINDS other than other_form.

    Rows with null text are no cases. Stable texts are filtered out before Python sees
    them; repeated rows are kept.
    """
    rows = rows.select(F.col(record_id).alias("record_id"), F.col(text).alias("text"))
    rows = rows.where(F.col("text").isNotNull() & ~_stable(F.col("text")))
    cases = rows.withColumn("x", _analysed_udf(F.col("text"))).select("record_id", "text", "x.form", "x.kinds")
    # what splicing or turning changed; a run of mixed scripts without look-alikes is a case as it is
    changed = (F.col("form") != F.col("text")) | F.element_at("kinds", KINDS.index("mixed_script") + 1)
    return cases.where(changed & F.exists(F.slice("kinds", 1, len(KINDS) - 1), lambda x: x)).select("record_id", "kinds", "text", "form")
