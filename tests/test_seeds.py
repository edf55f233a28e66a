"""Draws and walks against plain loops."""

import datetime

from pyspark.sql import functions as F

from chronolith.operators import seeds


def draws(seed):
    m, a = 0xFFFFFFFF, seed
    while True:
        a = (a + 0x6D2B79F5) & m
        t = (a ^ a >> 15) * (1 | a) & m
        t = (t + ((t ^ t >> 7) * (61 | t) & m) & m) ^ t
        yield (t ^ t >> 14) / 2**32


def test_draws_equal_a_loop(spark):
    rows = [(s, n) for s in (0, 1, 77, 2**31, 2**32 - 1) for n in range(1, 60)]
    got = {(r.s, r.n): r.d for r in spark.createDataFrame(rows, "s long, n long").select("s", "n", seeds.draw(F.col("s"), F.col("n")).alias("d")).collect()}
    for s in {s for s, _ in rows}:
        plain = draws(s)
        assert [got[s, n] for n in range(1, 60)] == [next(plain) for _ in range(59)]


def test_walks_equal_a_loop_and_do_not_depend_on_partitions(spark):
    subjects = [(1, 5, 100.0, 1000, False), (2, 9, 1.2, 500, True), (3, 11, 40.0, 7000, False)]
    shocks = {(1, datetime.date(2020, 1, 8)): 0.08, (2, datetime.date(2020, 1, 6)): -0.5, (2, datetime.date(2020, 2, 3)): -0.3, (3, datetime.date(2020, 1, 1)): 0.1}
    frame = spark.createDataFrame(subjects, "subject_id long, seed long, start double, base_volume long, every_day boolean")
    planted = spark.createDataFrame([(s, d, x) for (s, d), x in shocks.items()], "subject_id long, day date, shock double")
    one, many = ({(r.subject_id, r.day): (r.close, r.volume) for r in seeds.walks(seeds.trading_days(frame.repartition(n), "2020-01-01", "2020-06-30"), planted).collect()} for n in (1, 64))
    assert one == many
    want = {}
    for s, seed, value, base, every in subjects:
        plain = draws(seed)
        for k in range(182):
            d = datetime.date(2020, 1, 1) + datetime.timedelta(k)
            if every or d.weekday() < 5:
                drift = shocks[s, d] if (s, d) in shocks else (next(plain) - 0.49) * 0.022
                value = max(1.0, value * (1 + drift))
                want[s, d] = value, base * (1 + abs(drift) * 18) * (0.75 + next(plain) * 0.5)
    assert set(one) == set(want) and min(v for v, _ in want.values()) == 1.0
    assert all(abs(one[k][0] - v) < 0.0051 and abs(one[k][1] - n) < 0.51 for k, (v, n) in want.items())
