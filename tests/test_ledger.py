"""Commits, the latest pointer and the reconciling stream: whole or not at all, in any order of arrival."""

from __future__ import annotations

import itertools
import json
from datetime import datetime

import pytest

from pitchline.plans import store
from pitchline.plans.ledger import Ledger
from pitchline.sources import files
from pitchline.streaming.states import reconcile_states


def numbers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x int")


def rows(ledger):
    return sorted(r["x"] for r in ledger.read().collect())


def test_a_commit_is_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, tmp_path.as_uri())
    assert ledger.read() is None
    assert ledger.append(lambda old: numbers(spark, 1, 2), "a") and not ledger.append(lambda old: numbers(spark, 1, 2), "a")
    with pytest.raises(OSError):  # the writer dies before its entry
        with monkeypatch.context() as m:
            m.setattr(files, "create", lambda *a: (_ for _ in ()).throw(OSError()))
            ledger.append(lambda old: numbers(spark, 9))
    assert rows(ledger) == [1, 2]
    assert ledger.append(lambda old: numbers(spark, old.count() + 1)) and rows(ledger) == [1, 2, 3]


def test_of_two_writers_one_looks_again(spark, tmp_path):
    ledger, seen = Ledger(spark, str(tmp_path)), []

    def slow(old):
        seen.append(0 if old is None else old.count())
        if len(seen) == 1:  # another one commits the same rows meanwhile
            assert Ledger(spark, str(tmp_path)).append(lambda o: numbers(spark, 5))
        return numbers(spark, *([5] if old is None else []))

    assert ledger.append(slow) and seen == [0, 1] and rows(ledger) == [5]


def test_the_pointer_changes_in_one_step(spark, tmp_path, monkeypatch):
    root = tmp_path.as_uri()
    docs = lambda k: spark.createDataFrame([(f"m{k}", k)], "match_id string, k int")
    monkeypatch.setattr(store.predict, "flat", lambda df: df)
    store.publish(docs(1), root, 2023, 1, datetime(2023, 8, 1, 12))
    for step in ("write_csv", "write_documents"):
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(store.sinks, step, lambda *a: (_ for _ in ()).throw(OSError()))
            store.publish(docs(2), root, 2023, 2, datetime(2023, 8, 2, 12))
        said, there = store.latest(spark, root)
        assert said["round"] == 1 and there.first()["match_id"] == "m1"
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(files, "replace", lambda *a: (_ for _ in ()).throw(OSError()))
        store.publish(docs(2), root, 2023, 2, datetime(2023, 8, 2, 13))
    assert store.latest(spark, root)[0]["round"] == 1
    store.publish(docs(2), root, 2023, 2, datetime(2023, 8, 2, 14))
    assert store.latest(spark, root)[1].first()["match_id"] == "m2"


PREDICTION = "home_team string, away_team string, match_date date, prediction_time timestamp, model_version string, p_h double, p_d double, p_a double"
RESULT = "home_team string, away_team string, match_date date, told_at timestamp, actual_home int, actual_away int"


def test_matches_settle_alike_in_any_order(spark, tmp_path):
    def made(home, at, p):
        return "p", {"home_team": home, "away_team": "Z", "match_date": "2023-08-05", "prediction_time": at, "model_version": "v1", "p_h": p, "p_d": 0.2, "p_a": round(0.8 - p, 3)}

    def told(home, at, hg, ag):
        return "r", {"home_team": home, "away_team": "Z", "match_date": "2023-08-05", "told_at": at, "actual_home": hg, "actual_away": ag}

    events = [made("A", "2023-08-04T10:00:00Z", 0.5), made("A", "2023-08-05T09:00:00Z", 0.6), told("A", "2023-08-05T18:00:00Z", 2, 0), made("B", "2023-08-04T08:00:00Z", 0.3)]
    ends = [[told("B", "2023-08-05T17:00:00Z", 0, 1)], [made("C", "2023-08-20T10:00:00Z", 0.4)], [made("C", "2023-08-21T10:00:00Z", 0.4)]]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = []
    try:
        for n, order in enumerate([events, events[::-1]]):
            root = tmp_path / str(n)
            (root / "p").mkdir(parents=True)
            (root / "r").mkdir()
            number = itertools.count()
            for batch in [order[:2], order[2:], *ends]:
                for kind, event in batch:
                    (root / kind / f"{next(number)}.json").write_text(json.dumps(event))
                streams = [spark.readStream.schema(s).json(str(root / k)) for k, s in (("p", PREDICTION), ("r", RESULT))]
                reconcile_states(*streams, str(root / "history"), str(root / "checkpoint"), "3 days").awaitTermination()
            got.append(sorted((r["home_team"], r["p_h"], r["actual_home"], r["correct"]) for r in Ledger(spark, str(root / "history")).read().collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == [("A", 0.6, 2, True), ("B", 0.3, 0, True)]  # C has no result yet
