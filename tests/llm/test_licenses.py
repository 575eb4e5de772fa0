import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import licenses, registry
from larkspur.llm.licenses import PHRASES, TEMPLATES, TemplateAutomaton, as_regex, find_licenses, listed, parsed, shortest

SF = "/root/testdata/sf0.001"
ALL = listed(PHRASES) + listed(TEMPLATES)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    """The contract's columns, phrase by phrase and wording by wording as regular expressions."""
    w = words(text)
    line = " " + " ".join(w) + " "
    starts = [(k, label) for label, parts in listed(PHRASES) for k in range(len(w)) if w[k : k + len(parts)] == parts]
    found = [(label, parts) for label, parts in ALL if re.search(" " + as_regex(parts), line)]
    at = [k for k, _ in starts]
    score = max((shortest(p) / (shortest(p) + 4) for _, p in found), default=0.0)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in starts})), ",".join(sorted({x for x, _ in found})), score


def drawn(rng, parts):
    """An accepted wording."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
        elif p[0] == "gap":
            out += [rng.choice(["Jane", "the", "license", "2020", "é"]) for _ in range(rng.randint(p[1], p[2]))]
        elif p[0] == "choice" or rng.random() < 0.5:
            out += drawn(rng, rng.choice(p[1]))
    return out


def texts_of(rng, n):
    out = [None, "", "...", "no words of note", "Under the MIT License", "under-the,mit\nLICENSE under the mit license", "under the mit licenses", "cc by nc cc by nc by nc", "xcc by nc", "Apache License, Version 2.0", "all rights reserved", "éunder the mit license", "UNDER THE MİT LICENSE"]
    for _ in range(n):
        w = [rng.choice(["plain", "under", "the", "license", "é", "cc", "2"]) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            own = drawn(rng, rng.choice(ALL)[1])
            if rng.random() < 0.4 and own:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = own
        out.append("".join(x.upper() + rng.choice([" ", ", ", "\n", "-"]) if rng.random() < 0.2 else x + rng.choice([" ", ". "]) for x in w))
    return out


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()), key=str)


def test_whole_texts_are_brute_force(spark):
    texts = texts_of(random.Random(4), 400)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    clash = df.withColumns({"labels": F.lit(1), "score": F.lit("x"), "n_words": F.lit(2)})
    want = sorted(((k, *brute(t)) for k, t in enumerate(texts)), key=str)
    assert rows(find_licenses(df)) == want and rows(find_licenses(clash)) == want
    assert rows(find_licenses(df.filter("doc_id < 9").union(df.filter("doc_id < 9")))) == sorted(2 * [r for r in want if r[0] < 9], key=str)
    assert rows(find_licenses(df.limit(0))) == [] and find_licenses(df.limit(0)).columns[-1] == "spans"


@pytest.mark.parametrize("label", sorted({label for label, _ in ALL}))
def test_any_changed_mandatory_word_is_not_accepted(label):
    rng = random.Random(label)
    for own, parts in ALL:
        if own != label:
            continue
        machine = TemplateAutomaton([(own, parts)])
        plain = [p if isinstance(p, str) else drawn(rng, [p]) for p in parts]
        for k in [None, *[k for k, p in enumerate(parts) if isinstance(p, str)]]:
            text = [w for i, p in enumerate(plain) for w in (["otherword"] if i == k else [p] if isinstance(p, str) else p)]
            if label != "all-rights-reserved" or k is None or parts[k] in ("all", "rights", "reserved"):
                assert bool(list(machine.places([w.encode() for w in text]))) == (k is None)
                assert (machine.cue.search(" ".join(text).encode()) is not None) or k is not None


def test_places_are_the_smallest_starts():
    rng = random.Random(8)
    wordings = ["a b", "a [x] {1-3} c", "(a|a b) a", "b {0-2} (c|[d] e)", "a {0-4} a"]
    machine = TemplateAutomaton([(w, parsed(w)) for w in wordings])
    for _ in range(300):
        text = [rng.choice("abcdex") for _ in range(rng.randint(0, 14))]
        want = set()
        for k, w in enumerate(wordings):
            for end in range(len(text)):
                starts = [s for s in range(end + 1) if re.fullmatch(as_regex(parsed(w)), "".join(f"{x} " for x in text[s : end + 1]))]
                if starts:
                    want.add((k, min(starts), end))
        assert set(machine.places([x.encode() for x in text])) == want


def test_words_are_counted_over_slices(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é.A9_") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "", "x"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([5, *map(len, data)]).astype(np.int64)
    whole = np.frombuffer(b"zzzzz" + b"".join(data), np.uint8)
    for size in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(licenses, "SLICE", size)
        assert licenses.word_counts(whole, offsets).tolist() == [len(words(t)) for t in texts]


def test_wrong_markup_is_an_error():
    for wording in ("a [b", "[a b]", "{1-2} a", "(a|b)"):
        with pytest.raises(ValueError):
            TemplateAutomaton([("x", parsed(wording))])


def test_a_long_text_ends(spark):
    text = "copyright " * 300_000 + "all rights reserved"
    (row,) = find_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.labels, row.spans) == (300_003, "all-rights-reserved", "all-rights-reserved:299987:300002")


def test_query_matches_sql(spark, tmp_path):
    registry.queries()["op13_licenses"](spark, SF).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    c.sql(f"CREATE TABLE want AS {registry.oracle_sql()['op13_licenses']}")
    c.sql(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    listed_columns = ", ".join(sorted(r[0] for r in c.sql("DESCRIBE want").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert c.sql(f"SELECT {listed_columns} FROM {a} EXCEPT ALL SELECT {listed_columns} FROM {b} LIMIT 3").fetchall() == []
