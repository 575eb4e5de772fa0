import os
import re

import pytest
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.operators import index
from larkspur.sources import config as configs
from larkspur.sources.store import KEPT, MOST_VERSIONS, Conflict, Store

ROWS = "k long, v string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def held(store, name="t"):
    return sorted(map(tuple, store.read(name, ROWS).collect()))


def test_commits_are_numbered_and_old_files_go(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert held(store) == [] and store.snapshot("t") is None
    for k in range(6):
        store.overwrite("t", frame(spark, [(k, "x")]))
        assert held(store) == [(k, "x")] and store.snapshot("t") == k + 1
    assert len(store.commits("t")) == KEPT and len(list((tmp_path / "t/data/bucket__=0").iterdir())) == KEPT
    assert not [f for f in os.listdir(tmp_path / "t") if f.startswith("staged") or f.endswith("draft")]


def test_changes_touch_their_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    store.overwrite("t", frame(spark, [(k, "a") for k in range(400)]), ["k"])
    before = store.state("t")
    assert before.buckets == 16 and len(before.parts) == 16
    store.upsert("t", ROWS, frame(spark, [(7, "b"), (1000, "n")]), ["k"])
    after = store.state("t")
    assert 1 <= sum(before.parts[b] != after.parts[b] for b in range(16)) <= 2
    want = {k: "a" for k in range(400)} | {7: "b", 1000: "n"}
    assert held(store) == sorted(want.items())
    store.delete("t", ROWS, frame(spark, [(7, ""), (8, ""), (5000, "")]), ["k"])
    del want[7], want[8]
    assert held(store) == sorted(want.items())
    number = store.snapshot("t")
    assert store.delete("t", ROWS, frame(spark, []), ["k"]) is None and store.snapshot("t") == number
    store.replace("t", ROWS, frame(spark, [(9, "p"), (9, "q")]), frame(spark, [(9, ""), (10, "")]), ["k"])
    del want[9], want[10]
    assert held(store) == sorted([*want.items(), (9, "p"), (9, "q")])


def test_a_bucket_that_loses_all_rows_is_empty(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=1)
    store.overwrite("t", frame(spark, [(1, "a")]), ["k"])
    store.delete("t", ROWS, frame(spark, [(1, "")]), ["k"])
    assert held(store) == [] and store.state("t").parts == {}


def test_appends_don_t_read_and_full_buckets_are_written_anew(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=2)
    for k in range(MOST_VERSIONS + 3):
        store.append("t", ROWS, frame(spark, [(10 * k + i, "x") for i in range(10)]), ["k"])
    assert held(store) == [(k, "x") for k in range(10 * (MOST_VERSIONS + 3))]
    assert max(map(len, store.state("t").parts.values())) <= MOST_VERSIONS


@pytest.mark.parametrize("kind", ["upsert", "append", "overwrite"])
def test_two_writers_lose_no_change(spark, tmp_path, kind):
    """The second writer commits between the first one's reading and its commit."""
    first, second = Store(spark, str(tmp_path), buckets=4), Store(spark, str(tmp_path), buckets=4)
    first.overwrite("t", frame(spark, [(k, "a") for k in range(40)]), ["k"])
    publish, once = first._publish, []

    def late(name, state):
        if not once:
            once.append(second.upsert("t", ROWS, frame(spark, [(1, "second"), (99, "second")]), ["k"]))
        publish(name, state)

    first._publish = late
    new = frame(spark, [(2, "first"), (98, "first")] if kind == "upsert" else [(97, "first"), (98, "first")])
    if kind == "upsert":
        first.upsert("t", ROWS, new, ["k"])
        want = {k: "a" for k in range(40)} | {1: "second", 99: "second", 2: "first", 98: "first"}
    elif kind == "append":
        first.append("t", ROWS, new, ["k"])
        want = {k: "a" for k in range(40)} | {1: "second", 99: "second", 97: "first", 98: "first"}
    else:
        first.overwrite("t", new, ["k"])
        want = {97: "first", 98: "first"}
    assert held(first) == sorted(want.items()) and first.snapshot("t") == 3 and once == [2]


def test_a_number_is_committed_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.overwrite("t", frame(spark, [(1, "a")]))
    with pytest.raises(Conflict):
        store._publish("t", store.state("t"))
    assert held(store) == [(1, "a")]
    # what a writer that failed before its commit has left is not read
    store._write("t", frame(spark, [(2, "b")]), [], 1)
    assert held(store) == [(1, "a")]


def test_joins_read_the_buckets_they_need(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=32)
    store.overwrite("t", frame(spark, [(k, "a") for k in range(2000)]), ["k"])
    rows = store.read_bucketed("t", ROWS)
    plan = rows.filter("bucket__ = 3")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket__", plan)
    asked = frame(spark, [(5, "")]).select("k", Store.bucket(["k"], 32).alias("bucket__")).filter("k > 0")
    joined = rows.join(F.broadcast(asked), ["k", "bucket__"])
    assert [r.k for r in joined.collect()] == [5]
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()


def test_a_key_twice_needs_an_order(spark):
    target, new = frame(spark, [(1, "a")]), spark.createDataFrame([(2, "b", 1), (2, "c", 2)], f"{ROWS}, at int")
    assert sorted(map(tuple, index.upsert(target, new, ["k"], "at").collect())) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="need an order"):
        index.upsert(target, new.drop("at"), ["k"]).collect()


def test_one_changed_file_writes_one_bucket(spark, tmp_path):
    (tmp_path / "code").mkdir()
    for k in range(60):
        (tmp_path / f"code/f{k}.py").write_text(f"word{k}\n")
    config = configs.Config(str(tmp_path / "c.yaml"), {"p": configs.Project("p", [configs.CodeDir(str(tmp_path / "code"), [".py"])], [], False)})
    engine = Engine(spark, config, str(tmp_path / "store"))
    engine.store.buckets = 8
    engine.index()
    was = {t: engine.store.state(f"{t}/p-code") for t in ("chunks", "manifest")}
    (tmp_path / "code/f3.py").write_text("another text\n")
    engine.index()
    for t, before in was.items():
        after = engine.store.state(f"{t}/p-code")
        assert sum(before.parts[b] != after.parts[b] for b in before.parts) == 1 and after.number == before.number + 1
    assert engine.search(["another text"], 1).first().file_path == "code/f3.py"
