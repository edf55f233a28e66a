"""Amounts of 32 bytes against Python's integers."""

import random

from pyspark.sql import functions as F

from chronolith.functions import numbers


def test_words_against_integers(spark):
    rng = random.Random(1)
    values = [0, 1, 2**256 - 1, 2**255, 10**9, 10**9 - 1, 10**18, 2**32, 2**64 - 1, 10**77] + [rng.getrandbits(rng.randint(1, 256)) for _ in range(400)]
    rows = [(i, f"0x{v:x}" if i % 3 else f"0X{v:064X}", rng.choice([0, 6, 18, 40, 80])) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, data string, decimals int")
    got = frame.select("i", "decimals", numbers.hex_decimal(F.col("data")).alias("d"), numbers.hex_parts(F.col("data"), F.col("decimals")).alias("p"), numbers.hex_units(F.col("data"), F.col("decimals")).alias("u")).collect()
    for r in got:
        v, scale = values[r.i], 10**r.decimals
        assert r.d == str(v)
        assert (r.p.whole, r.p.rest) == (str(v // scale), str(v % scale).zfill(r.decimals) if r.decimals else "")
        assert r.u == float(v // scale) + (v % scale) / float(scale) or abs(r.u / (v / scale) - 1) < 1e-15
    odd = spark.createDataFrame([(None,), ("",), ("0x",), ("12",), ("0xg",), ("0x" + "1" * 65,), ("0x0" + "f" * 64,), ("0x1\n",)], "data string")
    assert [r.d for r in odd.select(numbers.hex_decimal(F.col("data")).alias("d")).collect()] == [None] * 6 + [str(2**256 - 1), None]
