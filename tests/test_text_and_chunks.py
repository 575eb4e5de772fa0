import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from larkspur.functions import chunk, text
from larkspur.operators import bm25


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("given", "tokens"),
    [("getUserName", ["get", "user", "name"]), ("HTTPServer", ["http", "server"]), ("MAX_SIZE", ["max", "size"]), ("__init__", ["init"]), ("v2beta", ["v", "2", "beta"]), ("café", ["caf"]), ("日本", ["日本"]), ("a b", ["a", "b"]), ("!?", []), (None, [])],
)
def test_tokens(spark, given, tokens):
    assert one(spark, given, text.tokens) == tokens


def test_terms_drop_underscores_and_accents(spark):
    assert one(spark, "__ éü x_y", text.terms) == ["eu", "x", "y"]


@pytest.mark.parametrize(("given", "slug"), [("Hello, World!", "hello-world"), ("", "untitled"), ("!!!", "untitled"), ("a__b  c", "a-b-c"), ("Über Äpfel", "über-äpfel"), ("x" * 150, "x" * 100)])
def test_slugify(spark, given, slug):
    assert one(spark, given, text.slugify) == slug


@pytest.mark.parametrize(("given", "tag"), [(None, "v:unknown"), ("", "v:unknown"), ("a" * 40, "v:aaaaaaaa"), ("1700.5", "v:1700.5")])
def test_freshness(spark, given, tag):
    assert one(spark, given, text.freshness_tag) == tag


@pytest.mark.parametrize(
    ("given", "want"),
    [('{"contradicts": true, "confidence": 1.7, "reason": "r"}', (True, 1.0, "r")), ('```json\n{"contradicts": false}\n```', (False, 0.0, "")), ('{"contradicts": true, "confidence": "high"}', None), ("no", None)],
)
def test_verdict(spark, given, want):
    got = one(spark, given, text.verdict)
    assert (tuple(got) if got else None) == want


def test_strip_takes_off_all_white_space(spark):
    assert one(spark, "\t\n\u00a0 a b \u2003\r", text.strip) == "a b"


def windows(content, lines, overlap):
    if not content.strip():
        return []
    rows, out, at = content.split("\n"), [], 0
    while True:
        out.append((len(out), at + 1, min(at + lines, len(rows)), "\n".join(rows[at : at + lines])))
        if at + lines >= len(rows):
            return out
        at += lines - overlap


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 10, 11, 301])
def test_line_windows(spark, n):
    content = "\n".join(f"l{i}" for i in range(n))
    df = spark.createDataFrame([(content,), ("  \n ",)], "text string")
    got = [(r.chunk_index, r.start_line, r.end_line, r.chunk) for r in chunk.line_windows(df, lines=4, overlap=2).orderBy("chunk_index").collect()]
    assert got == windows(content, 4, 2)


def test_overlap_must_be_less(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunk.line_windows(spark.createDataFrame([("a",)], "text string"), lines=5, overlap=5)


def document(spark, content):
    return [(r.title, r.chunk) for r in chunk.document_chunks(spark.createDataFrame([(content,)], "text string")).orderBy("chunk_index").collect()]


def test_document_chunks(spark):
    assert document(spark, "pre\n\n# A\nbody a\n### in\nmore\n## B\nbody b\n## Empty\n") == [("untitled", "pre"), ("A", "# A\nbody a\n### in\nmore"), ("B", "## B\nbody b")]
    assert document(spark, "one\n\n\ntwo\n\n") == [("untitled", "one"), ("untitled", "two")]
    assert document(spark, "### Only\ntext") == [("Only", "### Only\ntext")]
    assert document(spark, " \n") == []


def test_long_sections_are_split_by_paragraphs(spark):
    body = "\n\n".join(["x" * 40, "short", "y" * 40] + ["z" * 30] * 100)
    got = document(spark, f"# T\n\n{body}")
    assert len(got) == 102 and {t for t, _ in got} == {"T"} and ("T", "short") not in got


CS = "using A;\nnamespace N\n{\n" + "".join(f"    public class C{k}\n    {{\n" + "        int x; // }\n" * 20 + "    }\n" for k in range(2)) + "}\n"


def test_declarations():
    assert chunk.declarations(CS, ".cs") == [(3, 25), (26, 48)]
    assert [c[:3] for c in chunk.declaration_chunks(CS, ".cs")] == [(0, 1, 26), (1, 27, 51)]
    assert chunk.declaration_chunks("a\nb", ".py")[0][:3] == (0, 1, 2)
    assert chunk.declaration_chunks(" ", ".cs") == []


def test_long_declarations_get_windows():
    long = "export function f() {\n" + "  x;\n" * 600 + "}\n"
    got = chunk.declaration_chunks(long, ".ts")
    assert [c[0] for c in got] == list(range(len(got))) and len(got) == 4 and got[-1][2] == 603


def test_declaration_table_function(spark):
    got = chunk.DeclarationChunks(F.lit(CS), F.lit(".cs")).collect()
    assert [r.start_line for r in got] == [1, 27]


def test_bm25_is_that_of_sqlite(spark):
    texts = ["the quick brown fox", "the lazy dog dog", "fox and dog", "", "quick quick quick fox", "zebra"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    asked = spark.createDataFrame([(0, "quick dog"), (1, "fox fox zebra"), (2, "?")], "query_id int, text string")
    got = {(r.query_id, r.id): r.score for r in bm25.search(docs, asked, 10).collect()}
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    db.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(k + 1, t) for k, t in enumerate(texts)])
    want = {}
    for q, words in ((0, ["quick", "dog"]), (1, ["fox", "fox", "zebra"])):
        for rowid, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{w}"' for w in words),)):
            want[q, rowid - 1] = -s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_folding_is_that_of_unicode():
    a, b = text._folding()
    assert all(unicodedata.normalize("NFD", x)[0] == y for x, y in zip(a, b, strict=True)) and re.search("é", a)


def test_folding_goes_beyond_cyrillic(spark):
    got = spark.createDataFrame([("ệ Ḃ ᾳ é ø 日本 _",)], "t string").select(text.terms(F.col("t")).alias("t")).first().t
    assert got == ["e", "b", "α", "e", "ø", "日本"]


def test_hits_as_blocks_of_text(spark):
    rows = spark.createDataFrame([(1, "p", "p-docs", "a.md", 0.12345678, "a" * 40, "x" * 2001), (2, None, None, None, None, None, "short")], "rank int, project string, collection string, path string, distance double, version string, text string")
    got = [r.s for r in rows.select(text.result_text(*[F.col(c) for c in rows.columns]).alias("s")).collect()]
    assert got == ["--- Result 1 [p:p-docs] a.md (distance: 0.1235) [v:aaaaaaaa] ---\n" + "x" * 2000 + "\n... [truncated]", "--- Result 2 [?:?] ? [v:unknown] ---\nshort"]


STRINGS = {
    ".cs": [
        'string s = """\n  { not "" code {{ \n   """;',
        'string r = $$"""a {b} {{c + "}"}} "" """;',
        'string v = @"a ""{"" \\";',
        'string i = $"x {d["}"]} {{ {f(new { a = 1 })} {{";',
        'string j = $@"{g("")} ""{{"" ";',
        "char c = '{'; char q = '\\''; char d = '\"';",
        "/* { \" */ // { '",
        "#region it's {\n#endregion",
    ],
    ".ts": [
        "const a = `x ${f({b: `}${`{`}`})} {`;",
        "const r = /[/{]\\/{/g, q = a / b / c;",
        "return /}/.test(x) || `{`;",
        "const s = \"{\", t = '}\\'';",
        "const j = <p>don't</p>; // {",
        "const n = `\\`{\\${`;",
    ],
}


@pytest.mark.parametrize(("extension", "line"), [(e, x) for e, lines in STRINGS.items() for x in lines])
def test_braces_in_strings_are_none_of_the_files(extension, line):
    pad = "    int x;\n" * 20
    text = f"class A\n{{\n{line}\n{pad}}}\n\n\n\nclass B\n{{\n{pad}}}\n"
    first = len(line.split("\n")) + 22
    assert chunk.declarations(text, extension) == [(0, first), (first + 4, first + 26)]
    quiet = chunk.quieted(text, extension)
    assert [len(x) for x in quiet.split("\n")] == [len(x) for x in text.split("\n")] and quiet.count("{") == quiet.count("}") == 2


def test_outer_declarations_of_nested_and_large_files():
    nested = "using System;\n\nnamespace My\n{\n    public class Player\n    {\n        public int H { get; set; }\n        public void Hit(int a)\n        {\n            if (H < 0) H = 0;\n        }\n" + "        int z;\n" * 10 + "    }\n\n    public class Enemy\n    {\n        class Inner { }\n" + "        int z;\n" * 14 + "    }\n}\n"
    texts = [c[3] for c in chunk.declaration_chunks(nested, ".cs")]
    assert len(texts) == 2 and "Player" in texts[0] and "Hit" in texts[0] and "Inner" in texts[1]
    ts = "\nexport function greet(name: string): string {\n    return `Hello, ${name}!`;\n}\n\nexport class UserService {\n    private users: Map<string, User> = new Map();\n" + "    add(user: User): void { this.users.set(user.id, user); }\n" * 14 + "}\n\ninterface User {\n    id: string;\n}\n"
    texts = [c[3] for c in chunk.declaration_chunks(ts, ".tsx")]
    assert len(texts) >= 2 and "greet" in texts[0] and any("UserService" in t for t in texts)
    big = "public class Big\n{\n" + "".join(f"    void M{k}()\n    {{\n        var s = \"}}\";\n    }}\n" for k in range(160)) + "}"
    assert len(chunk.declaration_chunks(big, ".cs")) >= 2


def test_a_long_file_of_quotes_ends():
    for extension in (".cs", ".ts"):
        for sign in ('"', "'", "`", "/", '$"{', "`${", '"""', "{"):
            assert len(chunk.quieted(sign * 40_000, extension)) == len(sign) * 40_000
