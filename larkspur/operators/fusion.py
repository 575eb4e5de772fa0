"""Fusing ranked lists, and taking near-duplicates out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W_VECTOR, W_KEYWORD = 60, 1.0, 0.6
SAME_LINES = 0.55
PLACES = 12


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = K, w_vector: float = W_VECTOR, w_keyword: float = W_KEYWORD) -> DataFrame:
    """(query_id, id, score, rank) of weighted reciprocal-rank fusion. Hits: query_id, id, rank from 1.

    Ties keep the order of first sight: vector hits by rank, then keyword hits. An id twice in a list counts twice.
    """
    a = vector_hits.select("query_id", "id", (F.lit(w_vector) / (k + F.col("rank"))).alias("part"), F.lit(0).alias("list"), "rank")
    b = keyword_hits.select("query_id", "id", (F.lit(w_keyword) / (k + F.col("rank"))).alias("part"), F.lit(1).alias("list"), "rank")
    summed = a.union(b).groupBy("query_id", "id").agg(F.round(F.sum("part"), PLACES).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen.list", "seen.rank", "id")
    return summed.withColumn("rank", F.row_number().over(order)).drop("seen")


def by_distance(hits: DataFrame) -> DataFrame:
    """Ranks vector hits where no keyword hit exists: by distance, with null and exactly 0 last; ties keep their rank."""
    order = Window.partitionBy("query_id").orderBy(F.coalesce(F.nullif(F.col("distance"), F.lit(0.0)), F.lit(float("inf"))), "rank")
    return hits.withColumn("position", F.row_number().over(order))


def without_near_duplicates(hits: DataFrame, threshold: float = SAME_LINES, text: str = "text") -> DataFrame:
    """Hits (query_id, id, rank, text) of which none shares more than `threshold` of its lines with a kept one before it.

    A fold in rank order over the hits of one query, of which there are at most a few times n. Adds kept_rank. Lines are
    compared by 64-bit hashes; shared > threshold * (all - shared) is asked in whole ten-thousandths, so that the shared
    lines of a pair are looked for once.
    """
    share = round(threshold * 10_000)
    same = lambda x, y: F.size(F.array_intersect(x, y)) * (10_000 + share) > (F.size(x) + F.size(y)) * share
    entry = F.struct("rank", "id", F.array_distinct(F.transform(F.split(text, "\n"), lambda line: F.xxhash64(line))).alias("lines"))
    kind = dict(hits.dtypes)["id"]
    none = F.array().cast(f"array<struct<rank:int,id:{kind},lines:array<bigint>>>")
    lists = hits.withColumn("rank", F.col("rank").cast("int")).groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("hits"))
    keep = F.aggregate("hits", none, lambda kept, x: F.when(F.exists(kept, lambda y: same(x["lines"], y["lines"])), kept).otherwise(F.concat(kept, F.array(x))))
    return lists.select("query_id", F.posexplode(keep).alias("p", "x")).select("query_id", F.col("x.id").alias("id"), F.col("x.rank").alias("rank"), (F.col("p") + 1).alias("kept_rank"))
