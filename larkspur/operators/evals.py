"""Measures of retrieval."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("recall5", "recall10", "ndcg10", "mrr")


def is_hit(source: Column, expected: Column) -> Column:
    """Whether a source contains any expected string."""
    return F.exists(expected, lambda e: source.contains(e))


def score_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, query_class, recall5, recall10, ndcg10, mrr). cases: case_id, query_class, expected; hits: case_id, source, rank.

    A case without hits scores 0 throughout.
    """
    first = cases.join(hits, "case_id").filter(is_hit(F.col("source"), F.col("expected"))).groupBy("case_id").agg(F.min("rank").alias("first"))
    r = F.col("first")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scored = cases.join(first, "case_id", "left")
    return scored.select("case_id", "query_class", zero((r <= 5).cast("double")).alias("recall5"), zero((r <= 10).cast("double")).alias("recall10"), zero(F.when(r <= 10, 1 / F.log2(r + 1)).otherwise(0.0)).alias("ndcg10"), zero(1 / r).alias("mrr"))


def hit_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg((F.col("mrr") > 0).cast("double")).alias("hit_rate"))


def _long(scored: DataFrame) -> DataFrame:
    return scored.select("case_id", "query_class", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "value"))


def compare_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, query_class or null for all, mean_a, mean_b, delta, n) of two arms over the same cases."""
    if not a.select("case_id").exceptAll(b.select("case_id")).isEmpty() or not b.select("case_id").exceptAll(a.select("case_id")).isEmpty():
        raise ValueError("the arms have different cases")
    both = _long(a).withColumnRenamed("value", "a").join(_long(b).select("case_id", "metric", F.col("value").alias("b")), ["case_id", "metric"])
    grouped = both.groupingSets([["metric"], ["metric", "query_class"]], "metric", "query_class")
    return grouped.agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("b") - F.col("a")).alias("delta"), F.count("*").alias("n"))


#: The generator's seed, and the places in the sorted means that bound the interval.
SEED = 0


def interval_places(resamples: int, alpha: float) -> tuple[int, int]:
    """Places of the lower and upper bound among that many sorted means: one before alpha / 2 of them, and at 1 - alpha / 2."""
    cut = alpha / 2
    return min(max(int(cut * resamples) - 1, 0), resamples - 1), min(int((1 - cut) * resamples), resamples - 1)


def bootstrap_ci(deltas: list[float], resamples: int = 2000, alpha: float = 0.05, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of the mean over samples with replacement, drawn by the standard library's generator; (0, 0) of nothing."""
    n = len(deltas)
    if n == 0:
        return 0.0, 0.0
    draw = random.Random(seed)
    drawn = np.fromiter((draw.choice(range(n)) for _ in range(resamples * n)), np.int64, resamples * n).reshape(resamples, n)
    # a resample's mean is how often each value was drawn, times the values
    offsets = drawn + np.arange(resamples)[:, None] * n
    times = np.bincount(offsets.ravel(), minlength=resamples * n).reshape(resamples, n)
    means = times @ np.asarray(deltas, float) / n
    low, high = interval_places(resamples, alpha)
    ordered = np.partition(means, (low, high))
    return float(ordered[low]), float(ordered[high])


def bootstrap(df: DataFrame, group: str, order: str, value: str, resamples: int = 2000) -> DataFrame:
    """(group, lo, hi) of the mean of each group's values, taken in order. A group is a set of evaluation cases."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(g, *bootstrap_ci(list(v), resamples)) for g, v in zip(frame[group], frame["values"], strict=True)], columns=[group, "lo", "hi"])

    lists = df.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))
    return lists.mapInPandas(run, f"{group} {df.schema[group].dataType.simpleString()}, lo double, hi double")


def freshness(stored: Column, current: Column) -> Column:
    known = stored.isNotNull() & (stored != "") & current.isNotNull() & (current != "")
    return F.when(~known, "unknown").when(stored == current, "fresh").otherwise("stale")


def stale_stats(chunks: DataFrame, group: list[str], stored: str = "version_id", current: str = "current_version") -> DataFrame:
    """(group, fresh, stale, unknown, rate); rate is null where nothing is known."""
    state = freshness(F.col(stored), F.col(current))
    n = [F.count_if(state == s).alias(s) for s in ("fresh", "stale", "unknown")]
    return chunks.groupBy(*group).agg(*n).withColumn("rate", F.try_divide(F.col("stale"), F.col("fresh") + F.col("stale")))


def list_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two result lists; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def latency_summary(timed: DataFrame, group: str = "name", seconds: str = "seconds") -> DataFrame:
    """(group, median, mean) of measured times."""
    return timed.groupBy(group).agg(F.percentile(seconds, 0.5).alias("median"), F.avg(seconds).alias("mean"))


def throughput(batches: DataFrame, corpus_tokens: int) -> DataFrame:
    """(batch_size, tokens_per_second, hours): speed of embedding by size of batch, and what a whole index would take.

    batches: batch_size, tokens, seconds. A size that took no time has no speed.
    """
    speed = F.try_divide(F.sum("tokens").cast("double"), F.sum("seconds"))
    rated = batches.groupBy("batch_size").agg(speed.alias("tokens_per_second"))
    return rated.withColumn("hours", F.try_divide(F.lit(float(corpus_tokens)), F.col("tokens_per_second")) / 3600)
