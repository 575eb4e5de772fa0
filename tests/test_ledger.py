import datetime
import os

import pytest

from larkspur.operators import drift
from larkspur.operators.metering import Ledger
from larkspur.sources.store import Store


class Clock:
    def __init__(self):
        self.at = datetime.datetime(2026, 3, 1, 23, 59, tzinfo=datetime.UTC)

    def __call__(self):
        return self.at


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "call_key string")


def told(df):
    return sorted(r.call_key for r in df.collect())


def test_bookings_keep_the_cap(spark, tmp_path):
    clock = Clock()
    ledger = Ledger(Store(spark, str(tmp_path), 2), cap=3, prices=[("m", 1.0, 10.0), ("m-large", 2.0, 20.0)], now=clock)
    assert told(ledger.book(keys(spark, "ba"), "m-large-1")) == ["a", "b"] and ledger.left() == 1
    # keys that are booked cost nothing again; of the others the first ones are taken
    assert told(ledger.book(keys(spark, "bdca"), "m-1")) == ["a", "b", "c"] and ledger.left() == 0
    assert told(ledger.book(keys(spark, "dx"), "m-1")) == []
    ledger.done(spark.createDataFrame([("a", 1_000_000, 100_000), ("c", 1_000_000, 0), ("a", 1_000_000, 100_000)], "call_key string, input_tokens long, output_tokens long"))
    assert sorted((r.call_key, r.usd) for r in ledger.log().collect()) == [("a", 4.0), ("b", None), ("c", 1.0)]
    clock.at += datetime.timedelta(minutes=2)
    assert ledger.left() == 3 and told(ledger.book(keys(spark, "d"), "m-1")) == ["d"] and ledger.log().count() == 4


def test_two_scans_at_once_share_the_cap(spark, tmp_path):
    first, second = (Ledger(Store(spark, str(tmp_path), 2), cap=3) for _ in "ab")
    append, once = first.store.append, []

    def late(*args, **more):
        if not once:
            once.append(told(second.book(keys(spark, "xy"), "m")))
        return append(*args, **more)

    first.store.append = late
    assert told(first.book(keys(spark, "abc"), "m")) == ["a"] and once == [["x", "y"]] and first.log().count() == 3


def test_a_task_that_fails_is_counted_once(spark, tmp_path):
    """The judge fails on its third pair in the first scan; the second scan makes the same calls on the same bookings."""
    broken = str(tmp_path / "broken")
    open(broken, "w").close()

    def judge():
        asked = []

        def ask(claim, fact):
            asked.append(claim)
            if len(asked) == 3 and os.path.exists(broken):
                os.unlink(broken)
                raise RuntimeError("lost")
            return '{"contradicts": true, "confidence": 0.5}'

        return ask

    ledger = Ledger(Store(spark, str(tmp_path / "store"), 2), cap=7)
    pairs = spark.createDataFrame([(f"c{k}", f"f{k}") for k in range(10)], "claim_key string, fact_key string").coalesce(1)
    cache = spark.createDataFrame([], "judge_key string, reply string")
    grant = lambda asked: ledger.book(asked, "m")
    with pytest.raises(Exception, match="lost"):
        drift.judged(pairs, cache, judge, 0, grant=grant)
    assert ledger.log().count() == 7 and ledger.left() == 0
    out, new = drift.judged(pairs, cache, judge, 0, grant=grant)
    ledger.done(new.withColumnRenamed("judge_key", "call_key"))
    assert new.count() == 7 and out.filter("cap_hit").count() == 3
    assert ledger.log().count() == 7 and ledger.log().filter("output_tokens > 0").count() == 7
    # what was answered is in the cache from now on
    again, more = drift.judged(pairs, new.select("judge_key", "reply"), judge, 0, grant=grant)
    assert more.count() == 0 and again.filter("cap_hit").count() == 3 and ledger.log().count() == 7
