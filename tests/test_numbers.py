"""Keys of numbers against decimal arithmetic of Python."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from docquarry.functions.numbers import exact_long, number_key, same_number

TEXTS = ["0", "-0", "0.0", "0e9", "1", "1.0", "10e-1", "1e0", "-1", "-1.0", "-1.2", "-12e-1", "-12", "9e399", "1e400", "-1e400", "1e-400", "1234567890123456789012345678901234567890", "1234567890123456789012345678901234567891", "0.1", "0.10", "1E+2", "100", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "9.223372036854775807e18", "1e18", "1e19", "123e-2", "1230e-1", "0.00001e5"]
NONE = ["", "01", "1.", ".5", "+1", "1e", "NaN", "Infinity", "0x1", " 1", "1 ", "--1", "1e5.5", None]


def test_order_equality_and_longs(spark):
    rng = random.Random(1)
    texts = TEXTS + [f"{rng.choice(['', '-'])}{rng.randint(0, 10**rng.randint(0, 25))}{rng.choice(['', '.' + str(rng.randint(0, 10**6))])}{rng.choice(['', f'e{rng.randint(-30, 30)}'])}" for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts + NONE], "t string").select("t", number_key(F.col("t")).alias("k"), exact_long(F.col("t")).alias("n")).collect()
    keys = {r.t: r.k for r in rows}
    assert all(keys[t] is None for t in NONE)
    for a in texts:
        for b in texts[:60]:
            x, y = Decimal(a), Decimal(b)
            assert (keys[a] == keys[b]) == (x == y), (a, b)
            assert (tuple(keys[a]) < tuple(keys[b])) == (x < y), (a, b)
    for r in rows:
        if r.t in texts:
            x = Decimal(r.t)
            want = int(x) if abs(x) < Decimal(10) ** 30 and x == x.to_integral_value() and -(2**63) <= x < 2**63 else None
            assert r.n == want, r.t
    ordered = [r.t for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").orderBy(number_key(F.col("t")), "t").collect()]
    assert [Decimal(t) for t in ordered] == sorted(map(Decimal, TEXTS))
    same = spark.createDataFrame([("1.0", "10e-1"), ("1e400", "1e401"), ("1", "x")], "a string, b string").select(same_number(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in same] == [True, False, None]
