"""Properties of masks: determinism, guards, bounds, and that no raw value survives."""

import hashlib
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwell.functions import mask
from maskwell.streaming.limits import decide

import numpy as np


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))


def masked(spark, values, kind, pii, salt="s"):
    rows = column(spark, values, kind).select("i", mask.masked(F.col("v"), kind, pii, salt, "v").alias("v")).collect()
    return [r["v"] for r in sorted(rows)]


def test_seed_is_the_digest_modulo(spark):
    values = ["", "a", "é漢", "x" * 500]
    rows = column(spark, values, T.StringType()).select("i", mask.seed(F.col("v"), "salt").alias("s")).collect()
    assert [r["s"] for r in sorted(rows)] == [int(hashlib.sha256((v + "salt").encode()).hexdigest(), 16) % 10**9 for v in values]


def test_same_value_same_mask_and_other_salt(spark):
    values = [f"person {i}" for i in range(50)] * 2
    for pii in ("PERSON", "EMAIL", "PHONE", "IBAN", "SIRET", "URL", "CREDENTIAL"):
        a, b = masked(spark, values, T.StringType(), pii), masked(spark, values, T.StringType(), pii, "other")
        assert a[:50] == a[50:] and a != b
        assert not set(a) & set(values)


def test_guards(spark):
    assert masked(spark, [None, "", "  ", "\t", "x"], T.StringType(), "EMAIL")[:4] == [None, "", "  ", "\t"]
    out = masked(spark, [None, math.inf, 0.0, -1.0], T.DoubleType(), "SALARY")
    assert out[:3] == [None, math.inf, 0.0] and -1.16 < out[3] < -0.84
    assert math.isnan(masked(spark, [math.nan], T.DoubleType(), "SALARY")[0])
    assert masked(spark, [True, False, None], T.BooleanType(), "PERSON") == [True, False, None]
    assert masked(spark, [b"x", None], T.BinaryType(), None) == ["[BINARY DATA]", None]
    assert masked(spark, ["12,5", "abc", "0"], T.StringType(), "SALARY") == ["[REDACTED]", "[REDACTED]", "0"]
    assert masked(spark, ["4111"], T.StringType(), "CREDIT_CARD") == ["[REDACTED]"]
    assert masked(spark, ["x"], T.StringType(), "SAFE") == ["x"]


def test_halves_are_rounded_as_in_the_sql(spark):
    """Seeds that are 2,500 modulo 5,000 make halves of a fourth decimal, which the scaled double holds or misses."""
    salt, names = "fixed-salt-for-tests", [f"Customer#{i:09d}" for i in range(40_000)]
    seeds = [int(hashlib.sha256((n + salt).encode()).hexdigest(), 16) % 10**9 for n in names]
    halves = [(n, s) for n, s in zip(names, seeds) if s % 5000 == 2500]
    scaled = [(s / 1e9 * 180 - 90) * 1e4 for _, s in halves]
    want = [f"{math.copysign(math.floor(abs(x) + 0.5), x) / 1e4:.4f}" for x in scaled]
    assert "Customer#000012852" in [n for n, _ in halves] and masked(spark, [n for n, _ in halves], T.StringType(), "GEO", salt) == want
    assert all(0.84e307 < float(x) < 1.16e307 for x in masked(spark, ["1e307", "1.01e307"], T.StringType(), "SALARY"))


def test_noise_is_bounded_and_keeps_types(spark):
    values = list(range(1, 2000, 7))
    for kind, share in (("SALARY", 0.15), ("SCORE", 0.10)):
        out = masked(spark, values, T.LongType(), kind)
        assert all(abs(o - v) <= share * v + 0.5 for o, v in zip(out, values)) and all(isinstance(o, int) for o in out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(0, 1000), max_size=60), st.integers(1, 5), st.floats(1, 100))
def test_rate_limit_against_the_rule(times, limit, seconds):
    times = sorted(times)
    got, _ = decide(np.array(times), [], limit, seconds)
    kept: list[float] = []
    for t, allowed in zip(times, got):
        assert allowed == (sum(t - k < seconds for k in kept) < limit)
        if allowed:
            kept.append(t)
