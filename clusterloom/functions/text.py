"""Text as column expressions.

Lengths count code points; they equal UTF-16 units outside the astral planes.
White space is what the web platform takes for it, not the ASCII of Java's `\\s`.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points of the web platform's white space (fixed values).
SPACES = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
#: The same as the inside of a character class.
SPACE = "".join(rf"\x{{{c:X}}}" for c in SPACES)

#: Words that name no topic, Polish and English (fixed values).
STOPWORDS = (
    "i w z ze na do od dla o u po przez nad pod za przy między bez jak co czy to się jest są być oraz a ale lub czyli jako tak nie ich jego jej ten ta te tym tego "
    "tej tych swoje swój ile gdzie kiedy the an of for on and or"
).split()

#: Characters that NFKC leaves alone and that compose with none of each other: a text of these needs no Python.
_STABLE = r"\x{0}-\x{7F}\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts that it may change go through Python."""
    stable = text.rlike(rf"\A[{_STABLE}]*\z")
    return F.when(stable, text).otherwise(_nfkc(F.when(~stable, text)))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def squeeze(text: Column) -> Column:
    """Trimmed, with each run of white space as one blank."""
    return F.regexp_replace(trim(text), rf"[{SPACE}]+", " ")


def tokenize(text: Column) -> Column:
    """Tokens in order, repeats included: runs of letters, digits and hyphens of two or more characters that aren't stopwords."""
    lowered = nfkc(F.lower(text))
    runs = F.regexp_extract_all(lowered, F.lit(r"([\p{L}\p{N}-]{2,}|[\p{L}\p{N}&&[\x{10000}-\x{10FFFF}]])"), F.lit(1))
    return F.filter(runs, lambda t: ~t.isin(*STOPWORDS))


def token_set(text: Column) -> Column:
    """Distinct tokens in order of first occurrence."""
    return F.array_distinct(tokenize(text))


def capitalized(token: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(token, 1, 1)), F.substring(token, F.lit(2), F.length(token)))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Polish plural form of a count."""
    few_form = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(n == 1, one).when(few_form, few).otherwise(many)


def percent(share: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(share * 100 + 0.5).cast("long")


def client_key(forwarded_for: Column, real_ip: Column) -> Column:
    """The first forwarded address, else the real one, else `unknown`; an empty header is a missing one."""
    first = trim(F.element_at(F.split(forwarded_for, ","), 1))
    return F.when(forwarded_for != "", first).when(real_ip != "", trim(real_ip)).otherwise("unknown")


def clipped(text: Column, most: int, mark: str = "") -> Column:
    """The first ``most`` characters, and ``mark`` if that isn't all."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
