"""Keccak-256 against known digests, and answers of tokens."""

from pyspark.sql import functions as F

from chronolith.functions import keccak

KNOWN = {
    "": "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470",
    "abc": "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45",
    "Transfer(address,address,uint256)": "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
    "Approval(address,address,uint256)": "8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925",
}


def test_digests(spark):
    rows = spark.createDataFrame([(t,) for t in [*KNOWN, None]], "t string").select("t", keccak.keccak256(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == KNOWN | {None: None}
    long = ["x" * n for n in (135, 136, 137, 272, 1000)]
    assert len(set(keccak.digests([t.encode() for t in long]))) == 5
    assert keccak.digests([long[1].encode()]) == [keccak.digests([b"", long[1].encode()])[1]]


def test_answers_of_tokens(spark):
    word = lambda n: f"{n:064x}"
    raw = ["0x" + word(32) + word(4) + b"USDT".hex().ljust(64, "0"), "0x" + b"MKR".hex().ljust(64, "0"), "0x", None, "0x1234", "0x" + word(32) + word(99) + "00" * 32]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(keccak.decode_symbol(F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == ["USDT", "MKR", None, None, None, None]
    numbers = ["0x" + word(6), "0x" + word(18), "0x0", "0x" + word(99), "0x", None, "6"]
    got = spark.createDataFrame([(r,) for r in numbers], "r string").select(keccak.decode_decimals(F.col("r")).alias("s")).collect()
    assert [r.s for r in got] == [6, 18, 0, None, None, None, None]
