"""Content digests and commit ids, compared as they are meant rather than as they are spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label that may precede the digits.
DIGEST_LABEL = r"^\s*sha-?_?256\s*[:=]?|^\s*0x"


def digest_value(col: Column | str) -> Column:
    """The 32 bytes of a SHA-256 digest however it is spelled; null stays null.

    Letter case, an algorithm label, blanks and separators do not count. A value
    that does not hold exactly 64 hex digits is kept as its trimmed lower-case
    bytes, so it equals only the same text.
    """
    text = F.lower(F.col(col) if isinstance(col, str) else col)
    plain = F.when(text.rlike("^[0-9a-f]{64}$"), text).otherwise(
        F.regexp_replace(F.regexp_replace(text, DIGEST_LABEL, ""), r"[^0-9a-z]", "")
    )
    return F.when(text.isNull(), F.lit(None).cast("binary")).when(
        plain.rlike("^[0-9a-f]{64}$"), F.unhex(plain)
    ).otherwise(F.encode(F.trim(text), "utf-8"))


def same_commit(left: Column, right: Column) -> Column:
    """True where one commit id begins with the other, without case; null equals null only.

    An empty id equals only an empty id.
    """
    a, b = F.lower(F.trim(left)), F.lower(F.trim(right))
    prefix = (F.startswith(a, b) | F.startswith(b, a)) & ((F.length(a) > 0) & (F.length(b) > 0) | (a == b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(prefix)
