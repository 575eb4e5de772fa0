import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import drift, evals, facts, fusion, index, metering, search, vector


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_fusion_keeps_order_of_first_sight(spark):
    v = spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, id string, rank int")
    k = spark.createDataFrame([(0, "b", 1), (0, "c", 2)], "query_id int, id string, rank int")
    got = fusion.fuse(v, k).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"] and abs(got[0].score - (1 / 62 + 0.6 / 61)) < 1e-9


def test_exact_zero_distance_sorts_last(spark):
    v = spark.createDataFrame([(0, 1, 0.0, 1), (0, 2, 0.5, 2), (0, 3, None, 3)], "query_id int, id int, distance double, rank int")
    assert [r.id for r in fusion.by_distance(v).orderBy("position").collect()] == [2, 1, 3]


def greedy(texts):
    kept = []
    for t in texts:
        lines = set(t.split("\n"))
        if not any(len(lines & k) / len(lines | k) > 0.55 for k in kept):
            kept.append(lines)
    return len(kept)


def test_near_duplicates_at_the_threshold(spark):
    lines = lambda shared, own, n: "\n".join([*(f"s{i}" for i in range(shared)), *(f"{n}{i}" for i in range(own))])
    rng = random.Random(3)
    sets = [[lines(55, 22, "a"), lines(55, 22, "b")], [lines(50, 25, "a"), lines(50, 25, "b")], ["x"] * 5, ["\n".join(rng.choices("abcdef", k=6)) for _ in range(20)], ["", ""]]
    hits = spark.createDataFrame([(q, k, k + 1, t) for q, ts in enumerate(sets) for k, t in enumerate(ts)], "query_id int, id int, rank int, text string")
    got = {r.query_id: r.n for r in fusion.without_near_duplicates(hits).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert got == {q: greedy(ts) for q, ts in enumerate(sets)} and got[0] == 1 and got[1] == 2


@pytest.mark.parametrize("block", [1, 100])
def test_nearest(spark, block):
    rng = random.Random(1)
    vs = [(k, [rng.random() for _ in range(4)]) for k in range(50)]
    v = spark.createDataFrame([*vs, (99, None), (98, [1.0])], "id int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(k, x) for k, x in vs[:3]], "query_id int, embedding array<double>")
    got = rows(vector.nearest(v, q, 4, block=block), "query_id", "rank", "id")
    want = []
    for k, x in vs[:3]:
        best = sorted((round(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), 6), n) for n, y in vs)[:4]
        want += [(k, r + 1, n) for r, (_, n) in enumerate(best)]
    assert got == sorted(want)


def test_cosine_without_length(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_search_goes_on_to_three_n(spark):
    docs = [(k, "same\nlines\nword" if k < 4 else f"word number{k}\nother{k}", [float(k), 0.0], "p") for k in range(8)]
    target = spark.createDataFrame(docs, "id int, text string, embedding array<double>, path string")
    asked = spark.createDataFrame([(0, "nothing here", [0.0, 0.0])], "query_id int, text string, embedding array<double>")
    got = search.search([target], asked, 2).orderBy("rank").collect()
    assert len(got) == 2 and got[0].id in (1, 2, 3) and got[1].id == 4


def test_targets(spark):
    t = spark.createDataFrame([("p", "code", "p-code"), ("q", "docs", "q-docs")], "project string, kind string, collection string")
    assert search.selected_targets(t, "none").count() == 2 and search.selected_targets(t, "p").count() == 1 and search.selected_targets(t, kind="x").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        search.selected_targets(t, "none", strict=True)
    m = spark.createDataFrame([("p-code", "old")], "collection string, model string")
    assert [r.collection for r in search.same_model(t, m, "new").collect()] == ["q-docs"]


def machine(events):
    held, out = {}, []
    for chain, at, o in events:
        now = held.get(chain)
        action = "INSERT" if now is None else "NOOP" if now[0] == o else "SUPERSEDE"
        version = (now[1] if now else 0) + (action != "NOOP")
        held[chain] = (o, version)
        out.append((chain, at, o, action, version))
    return sorted(out)


def test_fact_chains_in_batches(spark):
    rng = random.Random(5)
    events = [(f"c{rng.randint(0, 5)}", k + 1, rng.choice("xyz")) for k in range(200)]
    df = lambda e: spark.createDataFrame([(c, t, o, t) for c, t, o in e], "chain_key string, valid_from long, object string, fact_id long")
    columns = ("chain_key", "valid_from", "object", "action", "version")
    whole = facts.apply_facts(df(events), ["valid_from"])
    assert rows(whole, *columns) == machine(events)
    first = facts.apply_facts(df(events[:120]), ["valid_from"])
    second = facts.apply_facts(df(events[120:]), ["valid_from"], current=facts.current_facts(first))
    assert sorted(rows(first, *columns) + rows(second, *columns)) == machine(events)
    assert whole.filter("is_current AND invalid_at <> 0").count() == 0


def test_repair_is_idempotent(spark):
    df = spark.createDataFrame([("c", 1, 1, True, 0), ("c", 2, 2, True, 0), ("d", 3, 1, True, 0), ("c", 4, 0, False, 5)], "chain_key string, fact_id long, version int, is_current boolean, invalid_at long")
    once = facts.repaired(df, F.lit(9).cast("long"))
    want = [(1, False, 9), (2, True, 0), (3, True, 0), (4, False, 5)]
    assert rows(once, "fact_id", "is_current", "invalid_at") == want == rows(facts.repaired(once, F.lit(10).cast("long")), "fact_id", "is_current", "invalid_at")


def test_extraction_reads_each_text_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def extractor():
        def find(t):
            with open(log, "a") as f:
                f.write("x")
            return [("s", "p", t)]

        return find

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, text string")
    assert rows(drift.extract_facts(df, extractor), "id", "object") == [(1, "a"), (2, "a"), (3, "b")]
    assert len(open(log).read()) == 2


def test_judge_respects_cache_cap_and_bad_replies(spark):
    c = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("a", "x")], "claim_key string, fact_key string")
    cache = spark.createDataFrame([], "judge_key string, reply string")
    judge = lambda: lambda a, b: "nonsense" if a == "a" else '{"contradicts": true, "confidence": 0.9}'
    out, new = drift.judged(c, cache, judge, 10)
    assert new.count() == 3 and out.filter("error").count() == 2 and out.filter("verdict.contradicts").count() == 2
    again, more = drift.judged(c, new, judge, 0)
    assert more.count() == 0 and again.filter("cap_hit").count() == 0
    capped, _ = drift.judged(c, cache, judge, 1)
    assert 2 <= capped.filter("cap_hit").count() <= 3


def batches(sizes, most, items):
    out, batch, used, n = [], 0, 0, 0
    for s in sizes:
        t = min(s, most * 2) // 2
        if n and (used + t > most or n >= items):
            batch, used, n = batch + 1, 0, 0
        used, n = used + t, n + 1
        out.append(batch)
    return out


def test_packing_in_order(spark):
    rng = random.Random(8)
    sizes = [rng.choice([0, 3, 50, 199, 400, 1000]) for _ in range(300)]
    df = spark.createDataFrame([("g", k, "x" * s) for k, s in enumerate(sizes)], "g string, k int, text string")
    got = index.packed(df, "g", ["k"], most_tokens=200, most_items=7).orderBy("k").collect()
    assert [r.batch for r in got] == batches(sizes, 200, 7) and max(len(r.text) for r in got) == 400


def test_safety_of_sweeps(spark):
    chunks = spark.createDataFrame([(1, "a/x"), (2, "a/y"), (3, "b/z"), (4, "c/w")], "id int, file_path string")
    roots = spark.createDataFrame([("a", "/a", True), ("b", "/b", False), ("c", "/c", True), ("c", "/d", True)], "name string, path string, exists boolean")
    files = spark.createDataFrame([("a/x",)], "file_path string")
    assert rows(index.deleted_sources(chunks, roots, files), "id") == [(2,)]
    assert index.orphan_documents(chunks, "a", files.limit(0)).count() == 0
    assert rows(index.orphan_documents(chunks, "a", files), "id") == [(2,)]


def test_excluded_folder_is_no_prefix(spark):
    df = spark.createDataFrame([("r/Lib/a",), ("r/Library/a",)], "p string")
    assert rows(df.filter(index.under(F.col("p"), "r", ["Lib"])), "p") == [("r/Lib/a",)]


def test_evenly(spark):
    df = spark.range(100).repartition(5)
    assert [r.id for r in index.evenly(df, 10, "id").orderBy("id").collect()] == list(range(0, 100, 10))


def test_other_index_operators(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert rows(index.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"]), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    c = spark.createDataFrame([("x", "new", 5), ("y", "new", 0), ("z", "new", 5)], "collection string, model string, n int")
    m = spark.createDataFrame([("x", "old"), ("y", "old"), ("z", "new")], "collection string, model string")
    assert rows(index.changed_models(c, m), "collection") == [("x",)]
    man = spark.createDataFrame([("/r/a.py",), ("/r/b.py",), ("/r/c.txt",), ("/rr/d.py",)], "path string")
    assert rows(index.out_of_scope(man, "/r", spark.createDataFrame([("/r/a.py",)], "path string"), [".py"]), "path") == [("/r/b.py",)]
    assert index.not_indexed(man.withColumnRenamed("path", "file_path"), spark.createDataFrame([("/r/a.py",)], "file_path string")).count() == 3


def test_metrics(spark):
    cases = spark.createDataFrame([(0, "nl", ["b"]), (1, "nl", ["z"]), (2, "id", ["a", "c"])], "case_id int, query_class string, expected array<string>")
    hits = spark.createDataFrame([(0, "a", 1), (0, "xbx", 2), (1, "a", 1), (2, "q", 6), (2, "c", 7)], "case_id int, source string, rank int")
    got = {r.case_id: r for r in evals.score_cases(cases, hits).collect()}
    assert (got[0].recall5, got[0].mrr, round(got[0].ndcg10, 4)) == (1.0, 0.5, 0.6309)
    assert (got[1].recall10, got[1].mrr, got[1].ndcg10) == (0.0, 0.0, 0.0)
    assert (got[2].recall5, got[2].recall10, round(got[2].mrr, 4)) == (0.0, 1.0, 0.1429)
    assert abs(evals.hit_rate(evals.score_cases(cases, hits)).first()[0] - 2 / 3) < 1e-9


def test_bootstrap():
    assert evals.bootstrap_ci([]) == (0.0, 0.0) and evals.bootstrap_ci([0.0] * 50) == (0.0, 0.0)
    lo, hi = evals.bootstrap_ci([0.1] * 30 + [-0.1] * 10)
    assert lo < 0.05 < hi and evals.bootstrap_ci([0.1] * 30 + [-0.1] * 10) == (lo, hi)


def test_freshness_and_overlap(spark):
    df = spark.createDataFrame([("g", "a", "a"), ("g", "a", "b"), ("g", None, "b"), ("h", "a", "")], "g string, version_id string, current_version string")
    assert rows(evals.stale_stats(df, ["g"]), "g", "fresh", "stale", "unknown", "rate") == [("g", 1, 1, 1, 0.5), ("h", 0, 0, 1, None)]
    empty = F.array().cast("array<int>")
    assert spark.range(1).select(evals.list_overlap(empty, empty)).first()[0] == 1.0


def test_metering(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.json").write_text('{"date": "2024-01-01", "model": "m", "input_tokens": 1, "output_tokens": 2, "usd": 0.5}\n\nnot json\n{"date": "2024-01-02", "model": "m"}\n')
    got = metering.read_log(spark, str(log))
    assert got.count() == 2 and metering.remaining(got, "2024-01-01", 2) == 1 and metering.remaining(got, "2024-01-01", 1) == 0
    metering.append_log(spark.createDataFrame([("2024-01-01", "t", "m", 1, 1, 0.12345678)], metering.RECORD), str(log))
    assert metering.read_log(spark, str(log)).filter("usd = 0.123457").count() == 1


def test_packing_without_texts_shuffles_none(spark):
    df = spark.createDataFrame([("s", k, "x" * (k % 7 * 90)) for k in range(60)], "g string, k int, text string")
    whole, slim = index.packed(df, "g", ["k"], most_tokens=200), index.packed(df, "g", ["k"], most_tokens=200, keep_text=False)
    assert sorted(whole.drop("text").collect()) == sorted(slim.collect()) and "text" not in slim.columns
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 16 << 20
