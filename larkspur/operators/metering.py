"""What model calls cost."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.store import Conflict, Store

RECORD = "date string, ts string, model string, input_tokens long, output_tokens long, usd double"
DAILY_CAP = 500


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed ones are left out."""
    return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(path).filter("date IS NOT NULL")


def append_log(calls: DataFrame, path: str) -> None:
    calls.withColumn("usd", F.round("usd", 6)).write.mode("append").json(path)


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (call_id, model, input_tokens, output_tokens) with usd by the longest prefix of model in prices (prefix, usd_in, usd_out); 0 where none fits.

    The price list is sent to every task and met once for each length of its prefixes; calls aren't shuffled.
    """
    met = calls.select("call_id", "model", "input_tokens", "output_tokens")
    lengths = sorted((r[0] for r in prices.select(F.length("prefix")).distinct().collect() if r[0] is not None), reverse=True)
    for n in lengths:
        own = prices.filter(F.length("prefix") == n).dropDuplicates(["prefix"]).select(F.col("prefix").alias(f"prefix_{n}"), F.struct("usd_in", "usd_out").alias(f"price_{n}"))
        met = met.join(F.broadcast(own), F.substring("model", 1, n) == F.col(f"prefix_{n}"), "left")
    price = F.coalesce(*[F.col(f"price_{n}") for n in lengths]) if lengths else F.lit(None).cast("struct<usd_in:double,usd_out:double>")
    usd = F.col("input_tokens") / 1e6 * price["usd_in"] + F.col("output_tokens") / 1e6 * price["usd_out"]
    return met.select("call_id", "model", "input_tokens", "output_tokens", F.coalesce(usd, F.lit(0.0)).alias("usd"))


def calls_per_day(calls: DataFrame, at: str = "ts") -> DataFrame:
    return calls.groupBy(F.date_format(at, "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("calls"))


def remaining(log: DataFrame, today: str, cap: int = DAILY_CAP) -> int:
    return max(0, cap - log.filter(F.col("date") == today).count())


def estimate(priced_calls: DataFrame) -> DataFrame:
    return priced_calls.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("usd"), 4).alias("usd"))


CALLS = "call_key string, date string, ts string, model string, input_tokens long, output_tokens long, usd double"
PRICES = "prefix string, usd_in double, usd_out double"
TRIES = 10


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


class Ledger:
    """Model calls of a store: booked before they are made, against a cap a day, and priced when they are done.

    A call is booked under a key, made of what is asked. Only booked calls are made, so that no number of tasks, scans or
    tries passes the cap: a scan that failed finds its bookings again and makes those calls without new ones, and a call
    that a task has made twice is one entry. Of two scans that book at once the second does so again on what is left.
    """

    def __init__(self, store: Store, cap: int = DAILY_CAP, name: str = "calls", prices: list[tuple[str, float, float]] = (), now: Callable[[], datetime.datetime] = _now):
        self.store, self.cap, self.name, self.prices, self.now = store, cap, name, list(prices), now

    def log(self) -> DataFrame:
        return self.store.read(self.name, CALLS)

    def left(self) -> int:
        return remaining(self.log(), f"{self.now():%Y-%m-%d}", self.cap)

    def book(self, asked: DataFrame, model: str) -> DataFrame:
        """(call_key) of the asked keys that may be called today: those that are booked already, and as many others, in order
        of their keys, as the cap leaves."""
        for _ in range(TRIES):
            state, log, at = self.store.state(self.name), self.log(), self.now()
            today = log.filter(F.col("date") == f"{at:%Y-%m-%d}").select("call_key")
            room = max(0, self.cap - today.count())
            # at most `cap` rows
            new = asked.select("call_key").distinct().join(today, "call_key", "left_anti").orderBy("call_key").limit(room)
            none = F.lit(None).cast("long")
            rows = new.select("call_key", F.lit(f"{at:%Y-%m-%d}").alias("date"), F.lit(f"{at:%Y-%m-%dT%H:%M:%S}").alias("ts"), F.lit(model).alias("model"), none.alias("input_tokens"), none.alias("output_tokens"), F.lit(None).cast("double").alias("usd"))
            try:
                if room and not rows.isEmpty():
                    self.store.append(self.name, CALLS, rows, ["call_key"], after=state.number if state else 0)
            except Conflict:
                continue
            booked = self.log().filter(F.col("date") == f"{at:%Y-%m-%d}").select("call_key")
            return booked.join(asked.select("call_key").distinct(), "call_key", "left_semi")
        raise Conflict(f"{self.name}: {TRIES} other scans were first")

    def done(self, calls: DataFrame) -> None:
        """Writes tokens and cost of calls (call_key, input_tokens, output_tokens) to their bookings; a key's latest booking counts."""
        known = self.log().groupBy("call_key").agg(F.max(F.struct("date", "ts", "model")).alias("b"))
        used = calls.groupBy("call_key").agg(F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens"))
        rows = used.join(known, "call_key").select(F.concat_ws("|", "call_key", "b.date").alias("call_id"), "call_key", "b.*", "input_tokens", "output_tokens")
        prices = self.store.spark.createDataFrame(self.prices, PRICES)
        cost = priced(rows.select("call_id", "model", "input_tokens", "output_tokens"), prices).select("call_id", F.round("usd", 6).alias("usd"))
        self.store.upsert(self.name, CALLS, rows.join(cost, "call_id").drop("call_id"), ["call_key", "date"], by=["call_key"])
