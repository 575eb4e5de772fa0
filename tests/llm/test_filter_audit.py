import os
import random
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import filter_audit, registry

SF = "/root/testdata/sf0.001"
DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(docs):
    """Per row, the letters that it fails."""
    out = []
    for doc, text, _ in docs:
        t = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if doc is not None and any(d is not None and d < doc and (u or "") == t for d, u, _ in docs) else set()
        out.append(fails)
    return out


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    fails, out = failures(docs), {}
    for part in {p or "" for _, _, p in docs}:
        own = [(d, f) for (d, _, p), f in zip(docs, fails) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                everywhere = sum(letter in f for _, f in own)
                out[part, "".join(order), k + 1] = [len(left), len(gone), everywhere - len(gone), sum(f == {letter} for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    rows = filter_audit.step_audit(filter_audit.flag_cells(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))).collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in rows}


def test_every_order_is_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one\x0btwo\x85three", "same " * 300, " ".join(f"w{k}" for k in range(250)), "ABC " + "x" * 90, "A" * 3 + "b" * 97, "A" * 3 + "b" * 96, "é#" * 50, " ".join("abc") * 201]
    texts += [" ".join(rng.choice(["Ab", "cd", "e$", f"w{rng.randint(0, 300)}"]) for _ in range(rng.choice([3, 199, 200, 260]))) for _ in range(25)]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", "", None])) for k in rng.sample(range(400), 120)]
    # repeated rows, one id of two texts and parts, rows without an id, hot copies
    docs += [docs[3], docs[3], (docs[4][0], "other", "fr"), (None, "other", "fr"), (None, "", "en")] + [(1000 + k, "hot copy", "en") for k in range(60)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 1060, 2)] + [(1001, 0, 1), (1001, 1, 0), (None, 1, 1), (5000, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_small_tables_and_other_columns(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    one = audited(spark, [(1, None, None)], [])
    assert len(one) == 600 and one["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and one["", "BACDE", 2] == [0, 1, 0, 1, 0, 0, 120]
    clash = spark.createDataFrame([(1, "x", "en")], DOCS).withColumns({c: F.lit(7) for c in ("id", "part", "digest", "A", "n", "good", "own", "first")})
    marked = spark.createDataFrame([(1, 1, 0)], LABELS).withColumns({c: F.lit(7) for c in ("id", "good", "n")})
    rows = filter_audit.step_audit(filter_audit.flag_cells(clash, marked)).filter("step = 1 AND filter_order = 'ABCDE'").collect()
    assert [(r.part, r.removed, r.good_lost) for r in rows] == [("en", 1, 1)]


def test_a_very_long_text_is_one_row(spark):
    got = audited(spark, [(1, "word " * 400_000, "en"), (2, "x" * 2_000_000, "en")], [])
    assert got["en", "BACDE", 1][:2] == [1, 1] and got["en", "ABCDE", 1][:2] == [1, 1]


def test_survivors_of_other_flags(spark):
    cells = spark.createDataFrame([("p", True, False, 3, 1, 0), ("p", False, False, 5, 2, 2), ("q", True, True, 4, 0, 0)], "part string, X boolean, Y boolean, n long, good long, toxic long")
    got = {(r.part, r.subset): (r.n, r.good, r.toxic) for r in filter_audit.survivors(cells, "XY").collect()}
    assert got == {("p", 0): (8, 3, 2), ("p", 1): (8, 3, 2), ("p", 2): (5, 2, 2), ("p", 3): (5, 2, 2), ("q", 0): (4, 0, 0), ("q", 1): (0, 0, 0), ("q", 2): (0, 0, 0), ("q", 3): (0, 0, 0)}
    steps = {(r.part, r.filter_order, r.step): r.shapley for r in filter_audit.step_audit(cells, "XY").collect()}
    assert steps["q", "XY", 1] == 4 and steps["p", "YX", 2] == 6


@pytest.mark.parametrize("name", ["op11_filter_audit"])
def test_query_matches_sql(spark, name, tmp_path):
    registry.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    c.sql(f"CREATE TABLE want AS {registry.oracle_sql()[name]}")
    c.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    listed = ", ".join(sorted(r[0] for r in c.sql("DESCRIBE want").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert c.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []
