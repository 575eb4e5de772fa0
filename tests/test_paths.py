import random

from pyspark.sql import functions as F

from larkspur.functions.paths import ancestors
from larkspur.operators import index, metering, upkeep


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ancestors(spark):
    rows = spark.createDataFrame([("/a/b/c",), ("x/y",), ("plain",), ("",), (None,), ("/",)], "p string").select(ancestors(F.col("p")).alias("a")).collect()
    assert [r.a for r in rows] == [["", "/a", "/a/b"], ["x"], [], [], None, [""]]


def test_ten_thousand_roots_are_joined_by_key(spark):
    rng = random.Random(2)
    names = ["src", "lib", "library", "é", "a b", "x"]
    folder = lambda: "/" + "/".join(rng.choice(names) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 4)))
    roots = [(f"n{k}", p, k) for k, p in enumerate({folder() for _ in range(10_000)})]
    files = [f"{folder()}/f{k}" for k in range(400)] + ["", "/", "none"]
    r, f = spark.createDataFrame(roots, "name string, path string, place int"), spark.createDataFrame([(p, "h") for p in files], "abs_path string, sha256 string")
    owned = upkeep.owning_root(f, r)
    place = {p: k for _, p, k in roots}
    want = {}
    for p in files:
        held = [place[a] for a in (p[:k] for k, c in enumerate(p) if c == "/") if a in place]
        if held:
            k = min(held)
            want[p] = (roots[k][0], p[len(roots[k][1]) + 1 :])
    assert {x.abs_path: (x.name, x.rel) for x in owned.collect()} == want and want
    routed = index.route_manifest(f.withColumnRenamed("abs_path", "path"), r.select(F.col("name").alias("project"), F.col("path").alias("root"), "place"))
    begun = {p: min((k for _, q, k in roots if p.startswith(q)), default=None) for p in files}
    assert {x.path: x.project for x in routed.collect()} == {p: "_orphaned" if k is None else f"n{k}" for p, k in begun.items()}
    assert "NestedLoop" not in plan(owned) + plan(routed) and "Cartesian" not in plan(owned) + plan(routed)


def test_prices_by_the_longest_prefix(spark):
    calls = spark.createDataFrame([(1, "m-large-2", 10**6, 10**6), (2, "m-2", 10**6, 0), (3, "other", 1, 1), (4, None, 1, 1)], "call_id int, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("m-large", 3.0, 4.0)], "prefix string, usd_in double, usd_out double")
    got = metering.priced(calls, prices)
    assert sorted((r.call_id, r.usd) for r in got.collect()) == [(1, 7.0), (2, 1.0), (3, 0.0), (4, 0.0)] and "NestedLoop" not in plan(got)
    assert {r.usd for r in metering.priced(calls, prices.limit(0)).collect()} == {0.0}
    anything = metering.priced(calls, spark.createDataFrame([("", 1.0, 1.0)], "prefix string, usd_in double, usd_out double"))
    assert {r.call_id for r in anything.filter("usd > 0").collect()} == {1, 2, 3}


def test_prices_are_met_without_a_shuffle_of_calls(spark):
    calls = spark.range(1000).select(F.col("id").alias("call_id"), F.lit("view-v1").alias("model"), F.lit(1_000_000).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    prices = spark.createDataFrame([("", 1.0, 1.0), ("view", 2.0, 1.0), ("view-v", 3.0, 1.0), ("view-v2", 9.0, 9.0)], "prefix string, usd_in double, usd_out double")
    got = metering.priced(calls, prices)
    assert "call_id" not in "".join(line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line)
    assert got.groupBy("usd").count().collect() == [(3.0, 1000)]
