"""Queries over all rows of their tables, on small fixtures."""

import datetime

from chronolith import model
from chronolith.operators import stats
from chronolith.plans import queries


def test_signals_are_of_each_scope(spark):
    date = datetime.date(2024, 1, 1)
    members = spark.createDataFrame([(s, s // 10) for s in (10, 11, 12, 60, 61, 62)], "subject_id long, industry_id long")
    events = spark.createDataFrame([(1, 10, "news", date, None), (1, 11, "news", date, None), (2, 12, "news", date, None), (2, 60, "news", date, None), (3, 61, "news", date, None), (3, 62, "news", date, None)], "event_id long, subject_id long, kind string, day date, relevance double")
    closes = {10: 100.0, 11: 101.0, 12: 150.0, 60: 100.0, 61: 99.0, 62: 50.0}
    prices = spark.createDataFrame([(s, date + datetime.timedelta(k), c if k else 100.0) for s, c in closes.items() for k in (0, 1)], "subject_id long, day date, close double")
    weeks = {(r.industry_id, r.shared, r.widest, tuple(r.ids)) for r in stats.cross_peer(events, members, "industry_id").collect()}
    assert weeks == {(1, 1, 2, (1,)), (6, 1, 2, (3,))}  # event 2 joins two industries and is in neither
    got = {(r.industry_id, r.signal, r.magnitude, tuple(r.event_ids)) for r in stats.signals(events, prices, members, scope="industry_id").collect()}
    assert got == {(1, "cross_peer_cluster", 2.0, (1,)), (6, "cross_peer_cluster", 2.0, (3,)), (1, "price_divergence", 49.0, (2,)), (6, "price_divergence", -49.0, (3,))}


def test_events_of_any_bar_and_moves_of_the_models_limit(spark, monkeypatch):
    first = datetime.date(2001, 3, 1)
    days = [first + datetime.timedelta(k) for k in range(30)]
    closes = [100.0] * 10 + [103.0] * 10 + [206.0] * 10
    bars = spark.createDataFrame([(1, d, c, 1) for d, c in zip(days, closes, strict=True)], "subject_id long, day date, close double, volume long")
    events = spark.createDataFrame([(7, 1, "news", days[4]), (8, 1, "filing", days[8]), (9, 1, "news", days[22])], "event_id long, subject_id long, kind string, day date")
    monkeypatch.setattr(queries.v, "bars", lambda *_: bars)
    monkeypatch.setattr(queries, "_events_of", lambda *_: events)
    at, want = [4, 8, 22], set()
    for k in range(30):
        dist, t = min((abs(k - e), -e) for e in at)  # of two as near, the later
        if dist <= model.HOVER_REACH:
            want.add((1, str(days[k]), str(days[-t]), dist))
    assert {tuple(r) for r in queries.q_nearest_bar(spark, "").collect()} == want
    moved = {(k, abs(closes[k] / closes[k - 1] - 1) * 100 >= model.MIN_MOVE_PCT) for k in range(1, 30)}
    got = {r.day: (r.event_id, r.jump_day) for r in queries.q_catalysts(spark, "").collect()}
    assert set(got) == {str(days[k]) for k, far in moved if far} == {str(days[10]), str(days[20])}
    assert got == {str(days[10]): (8, str(days[8])), str(days[20]): (None, str(days[20]))}


def test_tone_reads_past_the_lead(spark, tmp_path):
    good, bad, no, lead = model.POSITIVE[0], model.NEGATIVE[0], model.NEGATORS[0], "plain words of tone " * 20
    docs = [(0, lead + good), (1, lead + bad), (2, lead + no + " " + bad), (3, lead), (4, good + " " + lead + bad)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.tone for r in queries.q_tone_whole(spark, str(tmp_path)).collect()}
    assert got == {0: "positive", 1: "negative", 2: "positive", 3: "neutral", 4: "neutral"}
