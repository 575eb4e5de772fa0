import hashlib
import os
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, html_text, language, packing, pii, quality, registry, shards, token_counts
from larkspur.llm.tokens import ByteBpe

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs(spark, texts, extra="x"):
    """Documents with a further column whose name the operators use inside."""
    return spark.createDataFrame([(k, t, extra) for k, t in enumerate(texts)], "doc_id long, text string, row string").withColumns({"words": F.lit(1), "hash": F.lit("h"), "shard": F.lit(0), "node": F.lit(3)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items, size=10):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(size, len(w))
        for a in range(len(w) - n + 1) if n else ():
            for b in range(len(own) - n + 1):
                if own[b : b + n] == w[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add(str(name))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("per_pass", [1_000_000, 900])
def test_decontamination_is_brute_force(spark, per_pass):
    rng = random.Random(4)
    words_of = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(10, words_of(14)), (2, "Ä b"), (3, "x"), (4, None), (5, "..."), (6, words_of(10)), (7, "x"), (8, words_of(7))]
    texts = [None, "", "--", "x", "X, y Ä B!", items[0][1] + " " + items[5][1], *(words_of(rng.randint(1, 120)) for _ in range(12)), "x", f"q {items[0][1].upper()} q"]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = decontaminate.find_contamination(docs(spark, texts), bench, bytes_per_pass=per_pass)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == {k: contaminated(t, items) for k, t in enumerate(texts)}


def test_decontamination_acts(spark):
    item = "one two three four five six seven eight nine ten"
    d = docs(spark, ["clean text", f"Say: {item.title()}, then go.", None]).withColumn("n_chars", F.length("text"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, bench).collect()) == [0, 2]
    cut = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.decontaminate(d, bench, "spans").collect()}
    assert cut == {0: ("clean text", 10), 1: ("Say: then go.", 13), 2: (None, None)}
    assert decontaminate.find_contamination(d, bench.limit(0)).filter("n_hit = 0").count() == 3
    assert decontaminate.find_contamination(d.limit(0), bench).count() == 0
    with pytest.raises(ValueError, match="action"):
        decontaminate.decontaminate(d, bench, "none")
    shared = spark.createDataFrame([(1, "clean"), (1, item), (None, item), (None, "also clean"), (2, None), (2, item + " too")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.decontaminate(shared, bench).collect()) == [(0, "also clean"), (1, "clean"), (2, "")]
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.decontaminate(shared, bench, "spans").collect()) == [(0, ""), (0, "also clean"), (1, ""), (1, "clean"), (2, ""), (2, "too")]
    assert decontaminate.decontaminate(d.limit(0), bench).count() == 0 and decontaminate.decontaminate(d, bench.limit(0)).count() == 3


def test_items_that_share_a_window_are_all_told(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(k, item) for k in range(700)], "item_id long, text string")
    got = decontaminate.find_contamination(docs(spark, [f"x {item} y", "none"]), bench, bytes_per_pass=40_000).orderBy("doc_id").collect()
    assert (got[0].n_hit, got[0]["items"]) == (10, sorted(str(k) for k in range(700))) and (got[1].n_hit, got[1]["items"]) == (0, [])


def test_decontamination_is_its_sql(spark, tmp_path):
    registry.queries()["op2_decontamination"](spark, SF).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    columns = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    c.sql(f"CREATE TABLE want AS SELECT {columns} FROM ({registry.oracle_sql()['op2_decontamination']})")
    c.sql(f"CREATE TABLE got AS SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    assert c.sql("FROM want EXCEPT ALL FROM got").fetchall() == [] == c.sql("FROM got EXCEPT ALL FROM want").fetchall()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    parts = ["a", "@", ".", "b.c", "1", "23", "255", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+", "(", ")", "é", "%", "\n", "1.2.3.4", "+1 (555) 555-1234", "x@y.z", "0000"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        assert pii.find_spans(text)[0] == base_spans(text), text


def test_added_spans_and_marks(spark):
    text = "pay 4111111111111111 4111111111111111 or IBAN: DE89 3704 0044 0532 0130 00 and http://me:pw@h.org a@b.co"
    base, added = pii.find_spans(text)
    assert [s[0] for s in base] == ["email"] or base == base_spans(text)
    assert [k for k, *_ in added] == ["card", "card", "account", "login"]
    long = "a" * 50_000 + "@" + "b" * 50_000 + ".c"
    d = docs(spark, [None, "", "no", "a@b.co +1 (555) 555-1234", long, "a@b.co +1 (555) 555-1234"])
    got = {r.doc_id: r for r in pii.find_pii(d).collect()}
    assert got[0].spans == got[2].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == got[5].spans == "email:0:6,phone:7:24" and (got[3].n_email, got[3].n_phone) == (1, 1) and got[4].n_email == 1
    assert [r.text for r in pii.redact(d).orderBy("doc_id").collect()][:4] == [None, "", "no", "[EMAIL] [PHONE]"]
    assert pii.find_pii(d.limit(0)).count() == 0


def test_language_held_out_accuracy_and_edges(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.op6_language(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    model = language.train(d)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(spark, [None, "", "123 !!", "the and that", "日本"]), model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and got[4][0] in model.languages and 0 <= got[4][1] < 0.9
    assert language.identify(docs(spark, ["the"]), language.train(d.limit(0))).first().lang_pred == "und"


def test_shards(spark):
    texts = [None, "", "a", "a", "ü" * 5000] + ["w" * (k % 97) for k in range(3000)]
    got = shards.shard(docs(spark, texts), 4).collect()
    by = {k: [r for r in got if r.shard == k] for k in range(4)}
    assert len(got) == len(texts) and all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    sizes = [sum(r.size for r in rs) for rs in by.values()]
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes)
    assert shards.shard(docs(spark, []), 4).count() == 0


def test_no_map_loses_rows(spark, tmp_path):
    d = docs(spark, [f"t{k}" for k in range(300)])
    store = shards.SlotMap(spark, str(tmp_path / "map"))
    store.write(1, shards.first_map({}, 4, 64))
    for asked, slots in ((4, 128), (4, 32), (3, 64)):
        with pytest.raises(ValueError, match="the map has"):
            shards.shard(d, asked, slots=slots, slot_map=store)
    with pytest.raises(ValueError, match="written already"):
        store.write(1, shards.first_map({}, 5, 64))
    assert shards.shard(d, 4, slots=64, slot_map=store).count() == 300
    store.rebalance({}, 5)
    assert {r.version for r in shards.shard(d, 5, slots=64, slot_map=store).collect()} == {2}
    repeated = spark.createDataFrame([(7, "same")] * 50 + [(None, "x"), (None, None)], "doc_id long, text string").withColumn("size", F.lit("clash"))
    got = shards.shard(repeated, 2).collect()
    assert len(got) == 52 and all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in (0, 1))


def test_rebalancing_moves_few_slots(spark, tmp_path):
    sums = {s: 100 + s % 7 for s in range(256)}
    store = shards.SlotMap(spark, str(tmp_path / "map"))
    store.write(1, shards.first_map(sums, 4, 256))
    assert store.rebalance(sums, 5) == 2
    version, now = store.latest()
    before = {r.virtual_slot: r.shard for r in store.versions().filter("version = 1").collect()}
    moved = [s for s in now if now[s] != before[s]]
    assert version == 2 and 40 <= len(moved) <= 60 and all(now[s] == 4 for s in moved)
    fewer = shards.rebalanced(now, sums, 3)
    assert set(fewer.values()) == {0, 1, 2} and sum(fewer[s] != now[s] for s in now if now[s] < 3) < 20


def test_token_ids_are_those_of_the_library():
    bpe, rng = ByteBpe(BPE), random.Random(9)
    alphabet = [chr(c) for c in [*range(0x180), *range(0x370, 0x450), 0x2028, 0x2160, 0x4E2D, 0x1F600, 0x85, 0xA0]] + [" ", "\n", "'s", "<|endoftext|>"] * 20
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert bpe.ids(text) == bpe.slow.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    texts = [None, "", "a b", "a b", "word " * 5000, *(f"w{k} " * (k * 7 % 900) for k in range(60))]
    got = packing.pack_documents(docs(spark, texts), BPE, size=512).collect()
    bpe = ByteBpe(BPE)
    for k, t in enumerate(texts):
        ids = [*bpe.ids(t or ""), 0]
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 512 for r in mine[1:]) and all(r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])) for r in mine)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert packing.pack_documents(docs(spark, []), BPE).count() == 0


def test_genetic_packing_beats_or_equals_best_fit(spark):
    demand = {41: 7, 37: 9, 31: 12, 29: 5, 23: 8, 19: 11, 60: 4}
    first = packing.best_fit(demand, 100)
    best = packing.pack_lengths(spark, demand, 100, islands=2, rounds=2, generations=8)
    for p in (first, best, packing.crossover(first, best, demand, 100, random.Random(1))):
        held = {}
        for pattern, n in p:
            assert sum(pattern) <= 100
            for x in pattern:
                held[x] = held.get(x, 0) + n
        assert held == demand
    assert packing.cost(best, 100) <= packing.cost(first, 100)


def test_packing_sends_the_driver_one_row_for_each_length(spark, monkeypatch):
    rows, frame = [], type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: rows.append(collect(self)) or rows[-1])
    cut = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 3 + 30).alias("length"), F.col("id").alias("ids_crc32"))
    got = collect(packing.pack(cut, size=100, islands=2))
    assert max(map(len, rows)) <= 4  # three lengths; the two best packings of two islands
    assert sorted(r.doc_id for r in got) == list(range(600)) and len({(r.sequence_id, r.offset) for r in got}) == 600
    for s in {r.sequence_id for r in got}:
        own = sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 100


def test_token_counts_are_those_of_word_pieces(spark):
    from tokenizers import models

    pieces = ["▁a", "▁ab", "▁abc", "b", "c", "bc", "cde", "d", "▁x", "▁", "ef"]
    vocab = {p: k for k, p in enumerate(["[UNK]", *(p[1:] if p[0] == "▁" else f"##{p}" for p in pieces if p != "▁")])}
    wp, m, rng = models.WordPiece(vocab, unk_token="[UNK]"), token_counts.LongestMatch(pieces), random.Random(2)
    for _ in range(5000):
        word = "".join(rng.choice("abcdefx") for _ in range(rng.randint(1, 9)))
        got = [t.value for t in wp.tokenize(word)]
        assert m.count(word) == (0 if got == ["[UNK]"] else len(got)), word
    got = token_counts.count_tokens(docs(spark, [None, " ", "abc zz abc"]), pieces).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_tokens, r.n_unknown) for r in got] == [(0, 0, 0), (0, 0, 0), (3, 3, 1)]


def test_quality_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train(d, labels.filter(~held))
    out = quality.score_documents(d, model).join(labels.filter(held), "doc_id").collect()
    share = lambda rows: sum(not r.keep for r in rows) / len(rows)
    assert share([r for r in out if r.toxic]) > 0.9 and share([r for r in out if not r.quality]) > 0.95 and share([r for r in out if r.quality and not r.toxic]) < 0.02


def test_a_classifier_holds_its_matrix_once_more_at_most():
    rng = np.random.default_rng(3)
    x = (rng.random((4000, 500)) < 0.1).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    tracemalloc.start()
    try:
        w = quality.logistic(x, y)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 2 * x.nbytes
    assert ((quality.logit(x, w) > 0) == (y > 0)).mean() > 0.99
    assert np.array_equal(w, quality.logistic(x[:3000], y, below=x[3000:]))


def test_quality_edges(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(d, labels)
    odd = spark.createDataFrame([(1, None, None, None, 5), (1, "", "s", "en", 5), (None, "a\ud7ff b", "s", "en", 5)], "doc_id long, text string, source string, lang string, keep int").withColumnRenamed("keep", "one")
    assert quality.score_documents(odd, model).filter("p_bad BETWEEN 0 AND 1").count() == 3
    assert quality.keep_good(odd, labels.limit(0)).count() == 3 and quality.keep_good(odd.limit(0), labels).count() == 0
    repeated = d.limit(5).select("doc_id", "text", "source", "lang").crossJoin(spark.range(40).select())
    assert quality.score_documents(repeated, quality.train(repeated.union(d.select(repeated.columns)), labels)).count() == 200
    nulls = labels.withColumns({c: F.lit(None).cast("int") for c in ("quality", "toxic")})
    assert quality.keep_good(d, nulls).count() == d.count()


def test_beginnings_of_words_count():
    v = quality.Vocabulary(["idiot", "achl "])
    assert v.of(quality.tokens_of("Idiot idiotic achlich achlau achl")) == {0: 1.0, 1: pytest.approx(1.585, abs=1e-3)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class="home sidebar">
<header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">Cookies?</div><aside>Side</aside>
<article><h1>Head &amp; more</h1><p><b>First<br>line<p>Second&nbsp; line</p><div class="ad">Buy</div><form><p>Mail</p></form><ul><li>one<li>two</ul><!-- no --></article>
<section id="comments"><p>Nice</p></section><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    plain = lambda k: f"<body><div>Shared top</div><p>Own text {k}</p><p>Shared end</p></body>"
    rows = [(0, "http://h/a", PAGE), (1, "http://h/a/b", None), (2, "http://h/c", ""), (3, "http://g/1", plain(1)), (4, "http://g/2", plain(2)), (5, None, "<p>lone"), (6, "http://h/a", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit("y")})
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    main = "Head & more\nFirst line\nSecond line\none\ntwo"
    assert got[0] == got[6] == (main, len(main)) and got[1] == got[2] == ("", 0) and got[5][0] == "lone"
    assert got[3][0] == "Own text 1" and got[4][0] == "Own text 2"
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="layout with-sidebar"><article>text</article></div>', "text"),
        ('<form id="aspnetForm"><nav>menu</nav><article>text</article></form>', "text"),
        ("<article><p title='it's'>text</p><p>more</p></article>", "text\nmore"),
        ("<article><!-->text</article>", "text"),
        ('<article><p class="market-share">a</p><p class="search-results">b</p></article>', "a\nb"),
        ("<article>Press <button>Go</button> to start.</article>", "Press to start."),
        ('<article><p>x <span class="ad">buy</span> y</p><div class="cookie-bar">no</div></article>', "x y"),
        ('<article>a</article><section class="comments"><article>b</article></section>', "a"),
        ('<article a="b>c" d=e">x<p / e =f>y</article', "x\ny"),
        ("<article>1 < 2 <3 </ > 4", "1 < 2 <3 4"),
        ("<article><p>" + "long " * 200_000 + "</article>", ("long " * 200_000).strip()),
        ("<article><br " + "x='" * 50_000, ""),
    ],
)
def test_markup(page, want):
    assert (html_text.main_text(html_text.blocks(page)) or "") == want


def tags(page):
    """Names and ends of tags, character by character, by the rules of the HTML standard."""
    out, at, space = [], 0, " \t\n\f\r"
    while (at := page.find("<", at)) >= 0:
        k = at + 1 + page.startswith("</", at)
        if not page[k : k + 1].isalpha():
            at += 1
            continue
        start = k
        while k < len(page) and page[k] not in space + "/>":
            k += 1
        name, state = page[start:k], "before"
        while k < len(page) and not (page[k] == ">" and state in ("before", "name", "after", "equals", "plain")):
            c = page[k]
            if state in ('"', "'"):
                state = "before" if c == state else state
            elif state == "equals":
                state = state if c in space else c if c in "\"'" else "plain"
            elif state == "plain":
                state = "before" if c in space else state
            elif state in ("name", "after") and c == "=":
                state = "equals"
            elif c in space:
                state = "after" if state in ("name", "after") else "before"
            else:
                state = "before" if c == "/" else "name"
            k += 1
        out.append((name, k))
        at = k
    return out


def test_tags_end_where_the_standard_ends_them():
    rng = random.Random(13)
    for _ in range(20_000):
        page = "".join(rng.choice(["<", "</", ">", "a", "b", "=", '"', "'", " ", "/", "\n", "<a "]) for _ in range(rng.randint(1, 25))) + "z"
        got = [(m[2], m.end() - page[: m.end()].endswith(">")) for m in html_text._TOKEN.finditer(page) if m[2]]
        if all(m[2] for m in html_text._TOKEN.finditer(page)):  # tags() has no comments, such as </ without a letter
            assert got == tags(page), page


@pytest.mark.parametrize("tasks", ["1", "3", "40"])
def test_neighbours_decide_without_an_article(spark, tasks):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        check_neighbours(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def check_neighbours(spark):
    plain = lambda host, k: f"<body><div>Top of {host}</div><p>Own text {k}</p><p>End of {host}</p></body>"
    rows = [(k, f"http://{h}/{k:03}" if h else None, plain(h, k)) for k in range(120) for h in [("a", "b", None)[k % 3]]]
    rows += [(None, "http://a/zzz", None), (500, "http://c/", plain("c", 500)), (501, "no address", "x"), (7, "http://a/" + "y" * 5000, plain("a", 7))]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id not in (None, 500, 501):
            assert r.text == f"Own text {r.page_id}", r
    assert {r.page_id: r.text for r in got if r.page_id in (None, 500, 501)} == {None: "", 500: "Top of c\nOwn text 500\nEnd of c", 501: "x"}


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = html_text.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in sorted(found))
