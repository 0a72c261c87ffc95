from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that the operators use inside, as a table could have them.
CLASHES = ["key", "n", "norm", "h", "head", "range", "run", "vslot", "shard", "slot", "_gone", "_taken", "component", "bucket", "hash", "tokens", "domain", "spans", "score", "lang_pred", "host", "verdict"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty, blank and long texts, repeated ids and rows."""
    rng = random.Random(3)
    long = prose(rng, 6000)
    base = prose(rng, 60)
    return [
        (1, base, "en", "src1", 5), (2, base, "en", "src1", 5), (3, base + " more", None, "src2", None), (4, None, "en", "src1", 0), (5, "", "de", None, 0), (6, " \n\t ", None, None, None),
        (7, long, "en", "src1", len(long)), (8, long + " end", "en", "src3", 1), (None, base, "en", "src1", 5), (None, None, None, None, None), (9, "one two", "fr", "src2", 7), (9, "one two", "fr", "src2", 7),
        (10, "ONE  two", "fr", "src9", 8), (9, base, "en", "src1", 5), (2**62, "☃ 12", "es", "src0", 4), (-5, long, "en", "src0", 4), (12, "x" * 30000, "en", "src0", 4), (13, "12 34 !!", "en", "src0", 4),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit("?").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
