import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import drift, vector
from larkspur.operators.vector_index import VectorIndex, recall
from larkspur.sources.store import BUCKET, Store

ROWS = "id long, embedding array<float>"


def clustered(rng, n, width=12, groups=9, spread=0.15):
    """Vectors in groups, a third of them one and the same, some without length, some of another width, some null."""
    centres = rng.normal(size=(groups, width))
    out = []
    for k in range(n):
        if k % 3 == 0:
            v = centres[0]
        elif k % 17 == 0:
            v = np.zeros(width)
        elif k % 23 == 0:
            v = rng.normal(size=width - 4)
        else:
            v = centres[rng.integers(groups)] + spread * rng.normal(size=width)
        out.append((k, None if k % 29 == 0 else [float(np.float32(x)) for x in v]))
    return out


def brute(vectors, queries, k, metric, within=None):
    out = set()
    for q, a in queries:
        found = []
        for i, b in vectors:
            if a is None or b is None or len(a) != len(b):
                continue
            a64, b64 = np.array(a), np.array(b)
            if metric == "l2":
                d = ((a64 - b64) ** 2).sum()
            else:
                norm = np.linalg.norm(a64) * np.linalg.norm(b64)
                d = 1 - (a64 @ b64 / norm if norm else 0.0)
            found.append((float(d), i))
        out |= {(q, i, d) for d, i in sorted(found)[:k] if within is None or d <= within}
    return out


def far(found):
    """Distances of each query, in order: which of equally far vectors was taken is another test's matter."""
    return [(q, pytest.approx(d, abs=2e-6)) for q, _, d in sorted(found, key=lambda x: (x[0], x[2]))]


def told(df):
    return {(r.query_id, r.id, r.distance) for r in df.collect()}


@pytest.mark.parametrize(("metric", "k", "within"), [("l2", 1, None), ("cosine", 1, 0.15), ("cosine", 4, None), ("l2", 5, 0.4)])
def test_joined_neighbours_are_brute_force(spark, metric, k, within):
    rng = np.random.default_rng(k)
    rows = clustered(rng, 260)
    asked = [(1000 + k, v) for k, v in clustered(rng, 40)]
    v, q = spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(asked, ROWS).withColumnRenamed("id", "query_id")
    want = brute(rows, asked, k, metric, within)
    for pivots, most in ((7, 50), (1, 10_000)):
        got = sorted(told(vector.nearest_join(v, q, k, metric=metric, within=within, pivots=pivots, rows=most)), key=lambda x: (x[0], x[2]))
        assert [(q, d) for q, _, d in got] == far(want)
    if within is None:
        for block in (1000, 5):
            got = sorted(told(vector.nearest(v, q, k, metric=metric, block=block)), key=lambda x: (x[0], x[2]))
            assert [(q, d) for q, _, d in got] == far(want)


def test_no_rows_on_either_side(spark):
    v, none = spark.createDataFrame([(1, [1.0, 0.0])], ROWS), spark.createDataFrame([], ROWS)
    for a, b in ((v, none), (none, v), (none, none)):
        assert vector.nearest_join(a, b.withColumnRenamed("id", "query_id"), 2).collect() == []


def test_ties_go_to_the_smallest_id(spark):
    v = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(90)], ROWS)
    q = spark.createDataFrame([(1, [1.0, 1.0])], ROWS).withColumnRenamed("id", "query_id")
    for rows in (4, 1000):
        assert sorted((r.id, r.rank) for r in vector.nearest_join(v, q, 3, rows=rows).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_a_threshold_keeps_most_pairs_apart(spark):
    """Claims near one group of facts visit the cells of that group alone."""
    rng = np.random.default_rng(3)
    centres = np.eye(16)
    facts = [(k, [float(x) for x in centres[k % 16] + 0.02 * rng.normal(size=16)]) for k in range(640)]
    claims = [(k, [float(x) for x in centres[5] + 0.02 * rng.normal(size=16)]) for k in range(20)]
    f, c = spark.createDataFrame(facts, "chain_key long, embedding array<float>"), spark.createDataFrame(claims, "claim_id long, embedding array<float>").withColumn("chain_key", F.col("claim_id") + 10_000)
    seen, own = [], vector.block_join

    def counted(vectors, visits, *more):
        seen.append((visits.join(vectors.groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0], visits.count()))
        return own(vectors, visits, *more)

    vector.block_join = counted
    try:
        got = drift.semantic_candidates(c, f).collect()
    finally:
        vector.block_join = own
    assert len(got) == 20 and {r.chain_key % 16 for r in got} == {5} and seen[0][0] < 20 * 640 / 4


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(24, 16))[rng.integers(24, size=3000)] + 0.35 * rng.normal(size=(3000, 16)))]
    df = spark.createDataFrame(rows, ROWS)
    index = VectorIndex(Store(spark, str(tmp_path_factory.mktemp("index"))), "v")
    index.build(df, cells=48, sample=1500)
    return index, df, rows


def test_stored_index_has_recall(spark, indexed):
    index, df, _ = indexed
    asked = df.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    exact = vector.nearest(df, asked, 10)
    found = index.search(asked, 10, probes=6)
    assert recall(found, exact).first()["recall"] >= 0.95
    # all cells together miss nothing
    assert told(index.search(asked, 10, probes=1000)) == told(exact)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and BUCKET in plan


def test_stored_index_grows_by_the_cells_it_touches(spark, indexed):
    index, _, rows = indexed
    before = index.store.state("v/cells")
    moved = spark.createDataFrame([(5, [-x for x in rows[5][1]]), (9999, rows[7][1])], ROWS)
    index.upsert(moved)
    after = index.store.state("v/cells")
    assert sum(before.parts.get(b) != after.parts.get(b) for b in {*before.parts, *after.parts}) <= 3
    ask = lambda v, n=1: [r.id for r in index.search(spark.createDataFrame([(0, v)], "query_id long, embedding array<float>"), n, probes=48).orderBy("rank").collect()]
    assert ask(rows[7][1], 2) == [7, 9999] and ask(moved.filter("id = 5").first()["embedding"]) == [5] and ask(rows[5][1]) != [5]
    assert index.store.read("v/cells", index.schema).count() == 3001
    index.delete(spark.createDataFrame([(9999,), (7,), (123_456,)], "id long"))
    assert 7 not in ask(rows[7][1], 5) and index.store.read("v/cells", index.schema).count() == 2999
    with pytest.raises(Exception, match="width"):
        index.upsert(spark.createDataFrame([(1, [1.0])], ROWS))
