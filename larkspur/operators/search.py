"""Hybrid search over several targets for many queries in one plan."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import bm25, fusion, vector
from larkspur.operators.keyword_index import KeywordIndex


def selected_targets(targets: DataFrame, project: str | None = None, kind: str | None = None, strict: bool = False) -> DataFrame:
    """Targets (project, kind, ...) to search. An unknown project means all of them, or an error where strict."""
    if project is not None and not targets.filter(F.col("project") == project).isEmpty():
        targets = targets.filter(F.col("project") == project)
    elif project is not None and strict:
        raise ValueError(f"unknown project {project!r}")
    return targets if kind is None else targets.filter(F.col("kind") == kind)


def same_model(targets: DataFrame, markers: DataFrame, model: str) -> DataFrame:
    """Targets whose recorded model is the configured one or unknown; the others have vectors of another space."""
    marked = markers.select("collection", F.col("model").alias("recorded"))
    return targets.join(marked, "collection", "left").filter(F.col("recorded").isNull() | (F.col("recorded") == model)).drop("recorded")


#: Hits of all queries that are sent to every task to meet their texts there; more are joined by a shuffle.
MOST_HITS = 1_000_000


def _ranked(hits: pd.DataFrame, most: int) -> list[tuple]:
    """(id, lines, score, distance) of one query in order, from the `most` best of each target's lists: fused, or by distance where no keyword was met."""
    lists = []
    for k in (0, 1):
        mine = hits[(hits["list"] == k) & (hits["target_rank"] <= most)].sort_values(["target", "target_rank"], kind="stable")
        lists.append(list(zip(mine["id"], mine["distance"], mine["lines"], strict=True)))
    if not lists[1]:
        far = [(d if d else math.inf, rank, i, lines) for rank, (i, d, lines) in enumerate(lists[0])]
        distances = dict((i, d) for i, d, _ in lists[0])
        return [(i, lines, None, distances[i]) for _, _, i, lines in sorted(far, key=lambda x: x[:2])]
    found: dict = {}
    for k, weight in enumerate((fusion.W_VECTOR, fusion.W_KEYWORD)):
        for rank, (i, _, lines) in enumerate(lists[k], 1):
            have = found.setdefault(i, [0.0, (k, rank), lines])
            have[0] += weight / (fusion.K + rank)
    distances = {i: d for i, d, _ in reversed(lists[0])}
    scored = [(-round(score, fusion.PLACES), seen, i, lines) for i, (score, seen, lines) in found.items()]
    return [(i, lines, -score, distances.get(i)) for score, _, i, lines in sorted(scored, key=lambda x: x[:3])]


def _kept(ranked: list[tuple], threshold: float) -> list[tuple]:
    """(id, score, distance) without those that share more than threshold of their lines with one before them that is kept."""
    kept: list[tuple] = []
    for i, lines, score, distance in ranked:
        own = None if lines is None else set(lines)
        if not any(own is not None and other is not None and len(own & other) / len(own | other) > threshold for _, _, _, other in kept):
            kept.append((i, score, distance, own))
    return [k[:3] for k in kept]


def with_texts(hits: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """hits with the columns of texts, by id. Of `most` hits up to MOST_HITS no text is shuffled: the hits go to every task."""
    return texts.join(F.broadcast(hits) if most <= MOST_HITS else hits, "id")


def search(targets: list[DataFrame], queries: DataFrame, n: int = 5, threshold: float = fusion.SAME_LINES, path_filter: str | None = None, metric: str = "l2", keywords: list[KeywordIndex | None] | None = None, texts: list[DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score, rank, distance) of hybrid search; distance is null where only a keyword was met.

    targets, in order: DataFrames (id, text, embedding, path); keywords: their stored keyword indexes, None where a target has
    none and its texts are to be cut for the search; texts: their (id, text), for targets made by a join that hits needn't
    pass through. queries: query_id, text, embedding. Each list gives 2 n
    hits a target; a query of which fewer than n survive de-duplication takes 3 n instead. Both are cuts of the same
    3 n hits, which meet their texts once; what follows is done for one query at a time, over at most 6 n hits a target.
    Lines are compared by 64-bit hashes.
    """
    hits = own = None
    for place, target in enumerate(targets):
        rows = target.filter(F.col("path").contains(path_filter)) if path_filter is not None else target
        v = vector.nearest(rows, queries, 3 * n, metric=metric).select("query_id", "id", F.lit(0).alias("list"), F.lit(place).alias("target"), F.col("rank").alias("target_rank"), "distance")
        stored = keywords[place] if keywords else None
        k = stored.search(queries, 3 * n, path_filter) if stored else bm25.search(target, queries, 3 * n, path="path", path_filter=path_filter)
        k = k.select("query_id", "id", F.lit(1).alias("list"), F.lit(place).alias("target"), F.col("rank").alias("target_rank"), F.lit(None).cast("double").alias("distance"))
        t = (texts[place] if texts else target).select("id", "text")
        hits, own = (v.union(k), t) if own is None else (hits.union(v).union(k), own.union(t))
    met = with_texts(hits, own, queries.count() * 6 * n * len(targets))
    met = met.withColumn("lines", F.array_distinct(F.transform(F.split("text", "\n"), lambda line: F.xxhash64(line)))).drop("text")

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        kept = _kept(_ranked(frame, 2 * n), threshold)
        if len(kept) < n:
            kept = _kept(_ranked(frame, 3 * n), threshold)
        kept = kept[:n]
        return pd.DataFrame({"query_id": frame["query_id"].iloc[0], "id": [k[0] for k in kept], "score": pd.Series([k[1] for k in kept], dtype=float), "rank": range(1, len(kept) + 1), "distance": pd.Series([k[2] for k in kept], dtype=float)})

    kinds = {c: met.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    return met.groupBy("query_id").applyInPandas(answer, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank int, distance double")
