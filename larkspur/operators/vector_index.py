"""A stored index of vectors: trained coarse centres, vectors stored by the cell of their nearest centre, and searches that
read the cells nearest to each query and rank their vectors exactly.

Cells are the buckets of a Store table, so that an upsert or delete writes the cells that it touches, and a search joins
on the bucket and reads the files of the probed cells alone. Centres are fitted once, on a bounded sample, and every vector
is indexed, whatever its cell: what a search misses is measured as recall, against `vector.nearest` over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import vector
from larkspur.sources.store import BUCKET, Store

#: Rows that centres are fitted on at most, and rounds of fitting.
SAMPLE, ROUNDS = 50_000, 12
CENTRES = "cell int, centre array<double>"


def fitted(vectors: DataFrame, cells: int, sample: int = SAMPLE, metric: str = "l2", id_: str = "id", embedding: str = "embedding") -> np.ndarray:
    """Centres of at most `cells` cells, by Lloyd's rounds over the `sample` rows of the smallest hashed ids."""
    rows = vectors.filter(F.col(embedding).isNotNull()).orderBy(F.xxhash64(id_), id_).select(embedding).limit(sample).toPandas()[embedding]
    points, _ = vector._unit(np.array([np.asarray(r, np.float64) for r in rows]).reshape(len(rows), -1), metric)
    if not len(points):
        raise ValueError("there are no vectors to fit centres on")
    rng = np.random.default_rng(7)
    centres = points[[rng.integers(len(points))]]
    far = vector._distances(points, centres, "l2")[:, 0]
    while len(centres) < min(cells, len(points)) and far.max() > 0:
        # points far from all centres so far are likely, so that small groups get a centre too
        new = points[[rng.choice(len(points), p=far / far.sum())]]
        centres = np.vstack([centres, new])
        far = np.minimum(far, vector._distances(points, new, "l2")[:, 0])
    for _ in range(ROUNDS):
        own = np.concatenate([vector._distances(points[a : a + 4096], centres, "l2").argmin(1) for a in range(0, len(points), 4096)])
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class VectorIndex:
    """The index at {name} of a store: tables {name}/centres and {name}/cells. Vectors have one width; nulls aren't indexed."""

    def __init__(self, store: Store, name: str, id_kind: str = "long", metric: str = "l2"):
        self.store, self.name, self.metric = store, name, metric
        self.id_kind, self.schema = id_kind, f"id {id_kind}, embedding array<float>, bucket_ int"

    def build(self, vectors: DataFrame, cells: int = 256, sample: int = SAMPLE) -> None:
        """Fits centres and stores all vectors (id, embedding), in place of what was there."""
        centres = fitted(vectors, cells, sample, self.metric)
        spark = self.store.spark
        self.store.overwrite(f"{self.name}/centres", spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], CENTRES))
        held = self.store.buckets
        try:
            self.store.buckets = len(centres)
            self.store.overwrite(f"{self.name}/cells", self._placed(vectors, centres), ["bucket_"])
        finally:
            self.store.buckets = held

    def centres(self) -> np.ndarray:
        """As many rows as there are cells."""
        rows = sorted(self.store.read(f"{self.name}/centres", CENTRES).collect())
        return np.array([r["centre"] for r in rows])

    def _placed(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        metric = self.metric

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = np.zeros(batch.num_rows, np.int32)
                for here, m in vector.matrices(batch.column(1)):
                    if m.shape[1] != centres.shape[1]:
                        raise ValueError(f"the index has vectors of width {centres.shape[1]}, not {m.shape[1]}")
                    cell[here] = vector._distances(vector._unit(m, metric)[0], centres, "l2").argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], ["id", "embedding", "bucket_"])

        rows = vectors.filter("id IS NOT NULL AND embedding IS NOT NULL").select(F.col("id").cast(self.id_kind), F.col("embedding").cast("array<float>"))
        return rows.mapInArrow(run, self.schema)

    def _cells_of(self, ids: DataFrame) -> DataFrame:
        """Cells that have rows of the ids; of the stored vectors, the ids alone are read."""
        stored = self.store.read_bucketed(f"{self.name}/cells", self.schema).select("id", F.col(BUCKET).alias("bucket_"))
        return stored.join(ids.select("id"), "id", "left_semi").select("bucket_").distinct()

    def upsert(self, new: DataFrame) -> None:
        """new (id, embedding), one row for each id, in place of the vectors of these ids. Writes the cells that they leave and enter."""
        placed = self._placed(new, self.centres())
        touched = self._cells_of(new).union(placed.select("bucket_")).distinct()
        self.store.change(f"{self.name}/cells", self.schema, ["bucket_"], touched, lambda before: before.join(new.select("id"), "id", "left_anti").unionByName(placed))

    def delete(self, ids: DataFrame) -> None:
        self.store.change(f"{self.name}/cells", self.schema, ["bucket_"], self._cells_of(ids), lambda before: before.join(ids.select("id"), "id", "left_anti"))

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """(query_id, id, distance, rank) as vector.nearest, among the vectors of the `probes` cells nearest to each query (query_id, embedding)."""
        centres, metric = self.centres(), self.metric
        asked = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<float>").alias("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for here, m in vector.matrices(batch.column(1)):
                    if m.shape[1] == centres.shape[1]:
                        d = vector._distances(vector._unit(m, metric)[0], centres, "l2")
                        n = min(probes, len(centres))
                        cell = np.argpartition(d, n - 1, axis=1)[:, :n]
                        rows = pa.array(np.repeat(here, n))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cell.ravel().astype(np.int32))], ["query_id", "v", "cell"])

        visits = asked.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, v array<float>, cell int")
        stored = self.store.read_bucketed(f"{self.name}/cells", self.schema).select("id", F.col("embedding").alias("v"), F.col(BUCKET).alias("cell"))
        return vector.block_join(stored, visits, k, metric)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (recall): the share of the exact neighbours (query_id, id) that were found."""
    hit = exact.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
