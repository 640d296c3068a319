"""Column expressions that several operators of this package share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character, accented capitals included, stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def count_words(text: Column) -> Column:
    """The number of words; null counts as empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor: the fold a document belongs to."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))
