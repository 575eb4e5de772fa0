import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import prefix_trie, registry
from larkspur.llm.common import settle

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"


def brute(talks):
    """Nodes of conversations {id: [(role, text), ...]} in a plain trie, as sorted rows."""
    nodes = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = ",".join(map(str, sorted(c for c in members if len(talks[c]) == len(key))))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below), sum(not any(len(n) == len(k) + 1 and n[: len(k)] == k for n in nodes) for k in below),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rebuilt(talks):
    out = {}
    for c, turns in talks.items():
        h, head = zlib.crc32(str(c).encode()) % 6, c - c % 100
        out[c] = talks.get(head, [])[:h] + turns[h:]
    return out


def rows_of(talks, rng):
    rows = [(c, None if k == 0 else k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def talks_of(rng, n, words=3, most=9):
    """Many common beginnings, ends inside of others, hot copies, a long one."""
    word = lambda: ("user", "é" * rng.randint(0, words))
    talks = {}
    for c in rng.sample(range(1, 100 * n), n):
        other = rng.choice([*talks.values(), []])
        talks[c] = other[: rng.randint(0, len(other))] + [word() for _ in range(rng.randint(0, most))]
        talks[c] = talks[c] or [word()]
    hot = [("system", "s"), *[word() for _ in range(4)]]
    talks |= {100 * n + k: hot + [("user", str(k % 3))] * (k % 4) for k in range(n)}
    talks[200 * n] = hot + [word() for _ in range(60)]
    talks[200 * n + 1] = talks[200 * n][:50]
    return talks


def told(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


def trie(spark, talks, rng):
    return prefix_trie.prefix_trie(settle(prefix_trie.turn_lists(spark.createDataFrame(rows_of(talks, rng), ROWS))))


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 3), (3, 25), (4, 60)])
def test_nodes_are_brute_force(spark, seed, parts):
    rng = random.Random(seed)
    talks = talks_of(rng, 40)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert told(trie(spark, talks, rng)) == brute(talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("seed", range(40))
def test_ranges_cut_anywhere_add_up(seed):
    """The shares of every cut of the sorted paths, put together in plain Python, are the nodes of the whole."""
    rng = random.Random(seed)
    talks = talks_of(rng, rng.choice([1, 3, 12]), words=1, most=4)
    talks |= {900_000: []} if seed % 3 == 0 else {}
    digests = {}
    for c, turns in talks.items():
        path = b"".join(hashlib.md5(repr(t).encode()).digest() for t in turns)
        digests.setdefault(path, ([len(t) for _, t in turns], []))[1].append(c)
    paths = [(p, chars, len(ids), min(ids), hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()) for p, (chars, ids) in sorted(digests.items())]
    cuts = sorted({0, *[rng.randint(0, len(paths) - 1) for _ in range(rng.choice([0, 1, 5, 40]))]})
    ranges = [paths[a:b] for a, b in zip(cuts, [*cuts[1:], len(paths)])]
    edges = []
    for k, r in enumerate(ranges):
        left = prefix_trie._shared(ranges[k - 1][-1][0], r[0][0]) if k else 0
        right = prefix_trie._shared(r[-1][0], ranges[k + 1][0][0]) if k + 1 < len(ranges) else -1
        edges += prefix_trie.compressed(r, left, right)
    whole, shares = [], {}
    for e in edges:
        for at, saved in enumerate(e["saved"]):
            last = at == len(e["saved"]) - 1
            children, ends = (e["children"], e["ends"]) if last else (e["inner"], None)
            if e["keys"]:
                s = shares.setdefault(e["keys"][at + 1], [None, e["top"] + 1 + at, e["keys"][at], 0, 0, 0, 0, None])
                s[0] = e["low"] if s[0] is None else min(s[0], e["low"])
                for i, x in ((3, e["n"]), (4, children), (5, e["leaves"]), (6, saved)):
                    s[i] += x
                s[7] = ends or s[7]
            else:
                whole.append([e["low"], e["top"] + 1 + at, (e["parent_key"] or e["parent_low"]) if at == 0 else e["low"], e["n"], children, e["leaves"], saved, ends])
    made = [(r[0], r[1], (shares[r[2]][0] if r[2] in shares else None if r[2] == b"" else r[2]), *r[3:7], r[7] or prefix_trie.EMPTY) for r in [*whole, *shares.values()]]
    assert sorted(made, key=str) == brute(talks)


def test_heads_nulls_and_ties(spark):
    rng = random.Random(9)
    talks = talks_of(rng, 30) | {0: [("a", "x"), ("b", "y"), ("a", "z")], 100: [("user", "q")], 7: [("u", "v")] * 7, 300: [("", "")] * 8}
    df = spark.createDataFrame(rows_of(talks, rng), ROWS).withColumns({"path": F.lit(1), "first": F.lit(2), "turns": F.lit(3), "n": F.lit(4)})
    df = df.withColumn("text", F.when(F.col("conv_id") == 300, None).otherwise(F.col("text"))).withColumn("role", F.when(F.col("conv_id") == 300, None).otherwise(F.col("role")))
    df = df.union(df.limit(3).withColumn("conv_id", F.lit(None).cast("long")))
    lists = settle(prefix_trie.turn_lists(df))
    assert told(prefix_trie.prefix_trie(settle(prefix_trie.shared_heads(lists)))) == brute(rebuilt(talks))
    tied = spark.createDataFrame([(1, 5, "u", t) for t in "abcabc"] + [(2, 5, "u", t) for t in "ccbbaa"], ROWS)
    assert sorted((r.depth, r.n_convs) for r in prefix_trie.prefix_trie(settle(prefix_trie.turn_lists(tied))).collect()) == [(d, 2) for d in range(7)]
    assert told(prefix_trie.prefix_trie(settle(prefix_trie.turn_lists(tied.limit(0))))) == []


def test_nothing_left_ends_at_the_root(spark):
    c = next(k for k in range(1, 99) if zlib.crc32(str(k).encode()) % 6 > 2)
    lists = settle(prefix_trie.turn_lists(spark.createDataFrame([(c, 0, "u", "x")], ROWS)))
    assert told(prefix_trie.prefix_trie(settle(prefix_trie.shared_heads(lists)))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_query_matches_sql(spark, tmp_path):
    registry.queries()["op12_prefix_trie"](spark, SF).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    c.sql(f"CREATE TABLE want AS {registry.oracle_sql()['op12_prefix_trie']}")
    c.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    listed = ", ".join(sorted(r[0] for r in c.sql("DESCRIBE want").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert c.sql(f"SELECT {listed} FROM {a} EXCEPT ALL SELECT {listed} FROM {b} LIMIT 3").fetchall() == []
