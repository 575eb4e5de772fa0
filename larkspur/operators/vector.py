"""Nearest neighbours of vectors: exact, by a scan for few queries and by a join on cells around pivots for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 6
#: Query vectors that are sent to every task at most; more are joined with the vectors by cells.
BLOCK = 4096
#: Pivots of a join, and rows of either side that meet in one block of it at most, about.
PIVOTS, ROWS = 64, 20_000
#: Distances of a matrix product at once.
PRODUCT = 1 << 22
#: Cells of a width: the pivots' own, one of vectors without length, one of widths that no pivot has.
_WIDTH, _ZERO, _OTHER = 1 << 16, (1 << 16) - 2, (1 << 16) - 1


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.maximum(0.0, (q * q).sum(1)[:, None] - 2 * q @ v.T + (v * v).sum(1)[None])
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - np.where(norm == 0, 0.0, q @ v.T / norm)


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each width of an array of number lists; null lists are left out."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    widths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), -1)
    for w in np.unique(widths[widths >= 0]):
        rows = np.flatnonzero(widths == w)
        yield rows, flat[offsets[rows][:, None] + np.arange(w)]


def _best(q: np.ndarray, v: np.ndarray, ids: pa.Array, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, distance) of the k nearest of each row of q, ties by id."""
    place = np.argsort(np.asarray(ids.to_pylist(), dtype=object), kind="stable")
    rank, v = np.empty(len(place), np.int64), v[place]
    rank[place] = np.arange(len(place))
    rows, cols, found = [], [], []
    step = max(1, PRODUCT // max(1, len(v)))
    for a in range(0, len(q), step):
        d = np.round(_distances(q[a : a + step], v, metric), PLACES) + 0.0
        if k < d.shape[1]:
            # the k-th distance bounds what can be among the nearest; ties with it are cut after sorting
            last = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero(d <= last)
        else:
            r, c = (x.ravel() for x in np.indices(d.shape))
        order = np.lexsort((c, d[r, c], r))
        r, c = r[order], c[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[nth < k], c[nth < k]
        rows.append(r + a)
        cols.append(place[c])
        found.append(d[r, c])
    return np.concatenate(rows or [np.empty(0, int)]), np.concatenate(cols or [np.empty(0, int)]), np.concatenate(found or [np.empty(0)])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _schema(v: DataFrame, q: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return f"query_id {q.schema['query_id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, distance double", to_arrow_type(q.schema["query_id"].dataType)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "id", vector: str = "embedding", query: str = "query_id", query_vector: str = "embedding", metric: str = "l2", block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): squared L2 or 1 - cosine, ascending, ties by id, rounded to 6 places.

    Up to `block` queries are sent to every task, which keeps its k best for each, so that only those are shuffled. More
    queries are joined with the vectors: see nearest_join. Null vectors and vectors of another width are no neighbours.
    """
    own = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(query).alias("query_id"), F.col(query_vector).alias("v")).filter("v IS NOT NULL")
    rows = asked.take(block + 1)
    if len(rows) > block:
        return nearest_join(vectors, queries, k, id_, vector, query, query_vector, metric)
    schema, q_type = _schema(own, asked)
    shared = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [np.array(r[1], np.float64) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, qs = shared.value
        by_width: dict[int, list[int]] = {}
        for i, q in enumerate(qs):
            by_width.setdefault(len(q), []).append(i)
        for batch in batches:
            for here, v in matrices(batch.column(1)):
                if which := by_width.get(v.shape[1]):
                    ids = batch.column(0).take(pa.array(here))
                    r, c, d = _best(np.array([qs[i] for i in which]), v, ids, k, metric)
                    yield pa.RecordBatch.from_arrays([pa.array([names[which[i]] for i in r], q_type), ids.take(pa.array(c)), pa.array(d)], ["query_id", "id", "distance"])

    return _ranked(own.mapInArrow(run, schema), k)


def block_join(vectors: DataFrame, visits: DataFrame, k: int, metric: str, rows: int = ROWS) -> DataFrame:
    """As nearest, among vectors (id, v, cell) and queries (query_id, v, cell) that meet in a cell, of which there are few thousands.

    A cell of many rows is cut on both sides, and every slice meets every lot, so that no task has more than about `rows`
    of either side, whatever falls into one cell. Cells that no query visits aren't read beyond their cell.
    """
    many = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = F.broadcast(many(visits, "lots").join(many(vectors, "slices"), "cell"))  # a row for each cell
    s = vectors.join(sizes, "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    r = visits.join(sizes, "cell").select("query_id", "v", "cell", F.pmod(F.xxhash64("query_id"), F.col("lots")).cast("int").alias("lot"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    schema, q_type = _schema(vectors, visits)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [pa.table({"query_id": pa.array([], q_type), "id": left["id"].combine_chunks()[:0], "distance": pa.array([], pa.float64())})]
        asked = {q.shape[1]: (rows_of, q) for rows_of, q in matrices(right["v"])}
        for here, v in matrices(left["v"]):
            if v.shape[1] in asked:
                rows_of, q = asked[v.shape[1]]
                ids = left["id"].combine_chunks().take(pa.array(here))
                a, c, d = _best(q, v, ids, k, metric)
                parts.append(pa.table({"query_id": right["query_id"].combine_chunks().take(pa.array(rows_of[a])), "id": ids.take(pa.array(c)), "distance": pa.array(d)}))
        return pa.concat_tables(parts)

    key = ["cell", "slice", "lot"]
    return _ranked(s.groupBy(*key).cogroup(r.groupBy(*key)).applyInArrow(meet, schema), k)


def _unit(m: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose Euclidean distance orders as the metric does, and which of them have no length (by cosine)."""
    if metric == "l2":
        return m, np.zeros(len(m), bool)
    norms = np.sqrt((m * m).sum(1))
    return m / np.where(norms == 0, 1, norms)[:, None], norms == 0


def _straight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_distances(a, b, "l2"))


def nearest_join(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "id", vector: str = "embedding", query: str = "query_id", query_vector: str = "embedding", metric: str = "l2", within: float | None = None, pivots: int = PIVOTS, rows: int = ROWS) -> DataFrame:
    """As nearest, exactly, with queries and vectors on executors alone; `within` leaves out neighbours that are farther.

    Every vector belongs to the cell of its nearest pivot. By the triangle inequality the k vectors nearest to the pivots
    bound how far a query's k-th neighbour can be, and a cell's least and greatest distance from its pivot how near its
    vectors can be: a query visits the cells that aren't ruled out. `pivots` vectors and these bounds are all that the driver
    sees; vectors and queries are read a fixed number of times, however many there are.
    """
    own = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(F.col(query).alias("query_id"), F.col(query_vector).alias("v")).filter("v IS NOT NULL")
    centres: dict[int, np.ndarray] = {}
    for row in own.orderBy(F.xxhash64("id"), "id").select("v").take(pivots):
        m, zero = _unit(np.array([row[0]], np.float64), metric)
        if not zero[0]:
            centres[m.shape[1]] = np.vstack([centres[m.shape[1]], m]) if m.shape[1] in centres else m
    id_kind, q_kind = own.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    v_kind, a_kind = own.schema["v"].dataType.simpleString(), asked.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for here, m in matrices(batch.column(1)):
                w = m.shape[1]
                m, zero = _unit(m, metric)
                if w in centres:
                    d = _straight(m, centres[w])
                    cell[here], far[here] = d.argmin(1), d.min(1)
                else:
                    cell[here] = _OTHER
                cell[here[zero]] = _ZERO
                cell[here] += _WIDTH * w
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(far)], ["id", "v", "cell", "far"])

    placed = own.mapInArrow(assign, f"id {id_kind}, v {v_kind}, cell long, far double")
    if k == 1:
        bounds = placed.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.array(F.min("far")).alias("near"))
    else:
        order = Window.partitionBy("cell").orderBy("far")
        near = placed.select("cell", "far").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).groupBy("cell").agg(F.collect_list("far").alias("near"))
        bounds = placed.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high")).join(near, "cell")
    known = {r["cell"]: (r["low"], r["high"], r["near"]) for r in bounds.toLocalIterator()}  # a row for each cell

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        double = 1 if metric == "l2" else 2  # squared distance of unit vectors is twice 1 - cosine
        for batch in batches:
            who, where = [], []
            for here, m in matrices(batch.column(1)):
                w = m.shape[1]
                m, zero = _unit(m, metric)
                cells = sorted(c - _WIDTH * w for c in known if c // _WIDTH == w)
                plain = [c for c in cells if c < _ZERO]
                some = [c for c in cells if c >= _ZERO]
                reach = np.full(len(m), np.inf)
                least = np.zeros((len(m), 0))
                if plain:
                    d = _straight(m, centres[w][plain])
                    low, high, near = zip(*(known[c + _WIDTH * w] for c in plain))
                    up = np.hstack([d[:, [j]] + np.array(x)[None] for j, x in enumerate(near)])
                    if _ZERO in some:
                        up = np.hstack([up, np.full((len(m), len(known[_ZERO + _WIDTH * w][2])), np.sqrt(2.0))])
                    if up.shape[1] >= k:
                        reach = np.partition(up, k - 1, axis=1)[:, k - 1]
                    least = np.maximum(d - np.array(high), np.array(low) - d)
                if within is not None:
                    reach = np.minimum(reach, np.sqrt(double * within))
                # what is equal after rounding counts too, and sums of squares are not exact
                size = 1 + np.sqrt((m * m).sum(1))
                reach = np.sqrt(reach**2 + 4 * double * 10.0**-PLACES) + 1e-5 * size
                hit = np.hstack([(least <= reach[:, None]) | zero[:, None], np.full((len(m), len(some)), True)])
                r, c = np.nonzero(hit)
                who.append(here[r])
                where.append(np.array(plain + some, np.int64)[c] + _WIDTH * w)
            who, where = np.concatenate(who or [np.empty(0, int)]), np.concatenate(where or [np.empty(0, np.int64)])
            for a in range(0, len(who), 10_000):
                part = pa.array(who[a : a + 10_000])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(part), batch.column(1).take(part), pa.array(where[a : a + 10_000])], ["query_id", "v", "cell"])

    visits = asked.mapInArrow(visit, f"query_id {q_kind}, v {a_kind}, cell long")
    found = block_join(placed.drop("far"), visits, k, metric, rows)
    return found if within is None else found.filter(F.col("distance") <= within + 10.0**-PLACES / 2)
