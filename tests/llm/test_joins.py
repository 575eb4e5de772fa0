import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import image_copies, jaccard_join, registry
from larkspur.llm.common import components


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = {k: shingles(t) for k, t in texts}
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {k: (len(s), label[k]) for k, s in sets.items()}


def family(rng):
    """Texts with copies, near copies at and around the threshold, shared passages, short and empty texts."""
    word = lambda: f"w{rng.randint(0, 400)}"
    passage, texts = [word() for _ in range(40)], [None, "", "  ", "a b", "A b", "a b c", "x y z v w"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(5, 80))] + (passage if rng.random() < 0.5 else [])
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return [(k + 1, t) for k, t in enumerate(rng.sample(texts, len(texts)))]


@pytest.mark.parametrize(("seed", "frequent", "long"), [(1, 1 << 18, 100_000), (2, 0, 100_000), (3, 1000, 2)])
def test_components_are_brute_force(spark, seed, frequent, long):
    texts = family(random.Random(seed))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"id": F.lit(0), "n": F.lit(1), "component": F.lit(2)})
    got = jaccard_join.jaccard_components(df, most_frequent=frequent, long_list=long).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts) and len(got) == len(texts)


def test_near_copies_meet_across_salts(spark):
    texts = []
    for k in range(8):
        base = [f"f{k}w{i}" for i in range(60)]
        copies = [" ".join(base)] * 40  # of more copies than long_list, so that all of the prefix is salted
        texts += [(100 * k + i, t) for i, t in enumerate([*copies, " ".join([*base[:30], "other", *base[31:]])])]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, long_list=4).collect()}
    assert got == {i: i // 100 * 100 for i, _ in texts}


@pytest.mark.parametrize("long", [1, 7, 60, 300])
def test_two_of_many_texts_with_a_frequent_shingle_meet(spark, long):
    passage = [f"p{i}" for i in range(5)]
    pair = [[f"a{i}" for i in range(3)] + passage + [f"b{i}" for i in range(3 + k)] for k in range(2)]
    # the passage is in every text and in the prefix of hardly any; the pair's other shingles are more frequent still
    texts = [*pair, *(passage + [f"t{k}w{i}" for i in range(30)] for k in range(200)), *([f"s{k}"] + (pair[k % 2][:5] if k % 3 else pair[k % 2][6:]) + [f"u{k}w{i}" for i in range(40)] for k in range(300))]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), long_list=long).collect()}
    assert got == brute(rows)


def test_join_is_its_sql(spark, tmp_path):
    registry.queries()["op10_jaccard_join"](spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    c.sql(f"CREATE TABLE want AS SELECT doc_id, n_shingles, component_id FROM ({registry.oracle_sql()['op10_jaccard_join']})")
    c.sql(f"CREATE TABLE got AS SELECT doc_id, n_shingles, component_id FROM '{tmp_path}/out/*.parquet'")
    assert c.sql("FROM want EXCEPT ALL FROM got").fetchall() == [] == c.sql("FROM got EXCEPT ALL FROM want").fetchall()


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "one two three four five six"
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None), (3, "else")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (0, 2, 1), (0, 0, None), (3, 1, 3)], key=str)
    kept = jaccard_join.keep_one_of_each(df.filter("doc_id IS NOT NULL"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert jaccard_join.jaccard_components(df.limit(0)).count() == 0


def test_one_row_of_each_component_is_kept(spark):
    copied, clean, other = "one two three four five six", "an entirely clean text of its own", "and yet another one of no other's"
    rows = [(5, copied), (5, clean), (2, copied), (None, other), (None, other), (None, copied), (7, clean + " x y z"), (7, "more words that none else has")]
    kept = jaccard_join.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(2, copied), (5, clean), (0, other), (7, clean + " x y z"), (7, "more words that none else has")])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 12)] + [(30, 20), (20, 30)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 1 for k in range(1, 13)} | {20: 20, 30: 20}


def pgm(x):
    return b"P5 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.astype(np.uint8).tobytes()


def test_cropped_and_edited_copies(spark):
    rng = np.random.default_rng(5)
    scene = lambda: np.kron(rng.integers(20, 220, (22, 22)), np.ones((4, 4)))
    a, b = scene(), scene()
    turned = np.rot90(a)
    images = [(0, pgm(a)), (1, pgm(a[9:80, 5:77])), (2, pgm(np.clip(a * 0.9 + 12, 0, 255))), (3, pgm(b)), (4, pgm(a)), (5, None), (6, b"junk"), (7, pgm(np.zeros((40, 40)))), (8, pgm(turned)), (9, b"")]
    df = spark.createDataFrame(images, "image_id long, image binary").withColumn("class", F.lit(1))
    for block in (2000, 1):
        got = {(r.query_id, r.copy_id): r for r in image_copies.find_copies(df, df.filter("image_id IN (0, 3, 5, 7)").select("image_id"), block=block).collect()}
        assert set(got) == {(0, 0), (0, 1), (0, 2), (0, 8), (3, 3)} and got[0, 0].copies == 2
        assert abs(abs(got[0, 8].degrees) - 90) < 15
    assert image_copies.find_copies(df.limit(0), df.select("image_id").limit(0)).count() == 0
    more = df.union(spark.createDataFrame([(None, pgm(b), 1), (8, pgm(turned), 1)], df.schema))
    got = image_copies.copy_classes(more).collect()
    assert len(got) == 12 and {r.image_id: r.class_id for r in got} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 5, 6: 6, 7: 7, 8: 0, 9: 9, None: None}
    assert all(r.agreeing >= image_copies.AGREEING for r in got if r.match_id is not None) and {r.image_id for r in got if r.match_id is not None} >= {0, 1, 2, 8}
    assert image_copies.copy_classes(df.limit(0)).count() == 0


def compared(a, b):
    """Whether two images are copies, with all their descriptors and without tables."""
    (p, x), (q, y) = (image_copies.descriptors(i) for i in (a, b))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None]).sum(axis=2) <= image_copies.DIFFERENT)
    return len(i) >= image_copies.AGREEING and image_copies.agreeing(p[i], q[j])[0] >= image_copies.AGREEING


def test_classes_are_those_of_all_pairs(spark):
    rng, images = np.random.default_rng(12), []
    for _ in range(14):
        base = np.kron(rng.integers(20, 220, (18, 18)), np.ones((4, 4)))
        for _ in range(rng.integers(1, 6)):
            top, left = rng.integers(0, 12, 2)
            images.append(np.clip(base[top : 72 - rng.integers(0, 6), left:] * rng.uniform(0.85, 1.1) + rng.integers(-8, 9) + rng.normal(0, 0.7, (1, 1)), 0, 255).astype(np.uint8))
    got = {r.image_id: r.class_id for r in image_copies.copy_classes(spark.createDataFrame([(k, pgm(x)) for k, x in enumerate(images)], "image_id long, image binary").repartition(5)).collect()}
    decoded = [image_copies.decode(pgm(x)) for x in images]
    pairs = [(a, b, compared(decoded[a], decoded[b])) for a in range(len(images)) for b in range(a)]
    linked = [(a, b) for a, b, yes in pairs if yes]
    assert len(linked) > 20 and sum(got[a] == got[b] for a, b in linked) >= 0.95 * len(linked)
    above = dict(enumerate(got))
    for _ in images:
        for a, b in linked:
            above[a] = above[b] = min(above[a], above[b])
    assert all(got[a] != got[b] or above[a] == above[b] for a, b, _ in pairs)


def test_no_link_of_find_copies_is_lost(spark, monkeypatch):
    """Noisy copies whose descriptors are neighbours in few tables; held in one block and in many."""
    rng, images = np.random.default_rng(21), []
    for _ in range(30):
        base = np.kron(rng.integers(20, 220, (18, 18)), np.ones((4, 4)))
        images += [np.clip(base + rng.normal(0, 36, base.shape), 0, 255) for _ in range(3)]
    df = spark.createDataFrame([(k, pgm(x)) for k, x in enumerate(images)], "image_id long, image binary").localCheckpoint()
    links = [(r.query_id, r.copy_id) for r in image_copies.find_copies(df, df.select("image_id")).collect()]
    for held, met in ((1 << 18, 1 << 20), (1500, 50)):
        monkeypatch.setattr(image_copies, "HELD", held)
        monkeypatch.setattr(image_copies, "MET", met)
        got = {r.image_id: r.class_id for r in image_copies.copy_classes(df).collect()}
        assert len(set(links)) > 120 and all(got[a] == got[b] for a, b in links)


def test_query_finds_copies_among_any_ids(spark, tmp_path):
    rng = np.random.default_rng(9)
    a, b, c = (rng.normal(0, 1, 64).tolist() for _ in range(3))
    rows = [(1, a), (7, a), (13, a), (100, b), (101, b), (150, c)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.image_id: r.class_id for r in image_copies.op4_image_copies(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 7: 1, 13: 1, 100: 100, 101: 100, 150: 150}


def test_pnm_headers():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert np.allclose(image_copies.decode(b"P5 # made\n4\n# by hand\n3 255\n" + x.tobytes()), x)
    assert np.allclose(image_copies.decode(b"P5 4 3 65535\n" + (x.astype(">u2") * 257).tobytes()), x, atol=1e-3)
    assert image_copies.decode(b"P5 4 3 255\nab") is None


def test_png_is_read():
    import struct
    import zlib

    x = np.random.default_rng(1).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    raw, above = b"", np.zeros((7, 3), int)
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        line, left, corner = x[y].astype(int), np.zeros(3, int), np.zeros(3, int)
        raw += bytes([kind])
        for k in range(7):
            up = above[k]
            p = left + up - corner
            d = abs(p - left), abs(p - up), abs(p - corner)
            paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], up, corner))
            guess = (0, left, up, (left + up) // 2, paeth)[kind]
            raw += ((line[k] - guess) % 256).astype(np.uint8).tobytes()
            left, corner = line[k], up
        above = line
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert np.allclose(image_copies.decode(png), x.mean(axis=2), atol=1e-3)


def test_pipeline_keeps_columns_and_order(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "personal_data", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_consensus_grows_with_the_matches():
    """A lattice of dots matches itself in every way; votes for moves take the place of matches tried on all matches."""
    import resource
    import time

    image = np.zeros((192, 192), np.float32)
    for y in range(8, 184, 8):
        for x in range(8, 184, 8):
            image[y : y + 3, x : x + 3] = 200
    places, parts = image_copies.descriptors(image)
    tables = image_copies.HammingTables(np.zeros(len(places), int), places, parts)
    row, other = tables.matches(parts)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    n, scale, turn = image_copies.agreeing(places[row], places[other])
    assert n > 100 and scale == 1.0 and abs(turn) < 1
    assert time.process_time() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_huge_headers_are_images_that_can_t_be_read():
    import struct
    import zlib

    assert image_copies.decode(b"P5 99999999999 99999999999 255\n" + bytes(10)) is None
    assert image_copies.decode(b"P6 " + b"9" * 5000 + b" 1 255\n") is None
    assert image_copies.decode(b"P5 20000 20000 255\n" + bytes(10)) is None
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    head = b"\x89PNG\r\n\x1a\n"
    bomb = chunk(b"IDAT", zlib.compress(bytes(50_000_000)))
    assert image_copies.decode(head + chunk(b"IHDR", struct.pack(">IIBBBBB", 2**31, 2**31, 8, 0, 0, 0, 0)) + bomb) is None
    assert image_copies.decode(head + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 0, 0, 0, 0)) + bomb).shape == (4, 4)
    assert image_copies.decode(head + chunk(b"IHDR", struct.pack(">IIBBBBB", 0, 4, 8, 0, 0, 0, 0)) + bomb) is None


def test_consensus_finds_a_moved_and_turned_set():
    rng = np.random.default_rng(5)
    a = np.column_stack([rng.uniform(0, 200, (60, 2)), np.ones(60), rng.uniform(-3, 3, 60)])
    turn = 0.4
    b = a.copy()
    b[:, 0], b[:, 1] = 2 * (np.cos(turn) * a[:, 0] - np.sin(turn) * a[:, 1]) + 30, 2 * (np.sin(turn) * a[:, 0] + np.cos(turn) * a[:, 1]) - 12
    b[:, 2], b[:, 3] = 2.0, a[:, 3] + turn
    b[40:, :2] = rng.uniform(0, 200, (20, 2))
    b[:, :2] += rng.uniform(-1.5, 1.5, (60, 2))
    n, scale, angle = image_copies.agreeing(a, b)
    assert 36 <= n <= 44 and scale == 2.0 and abs(angle - np.degrees(turn)) < 3
    assert image_copies.agreeing(a[:0], b[:0])[0] == 0
