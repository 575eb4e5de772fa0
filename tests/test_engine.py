import pytest

from larkspur import cli
from larkspur.engine import FACTS as engine_facts
from larkspur.engine import Engine
from larkspur.functions import providers
from larkspur.sources import config as configs
from larkspur.sources import tree
from larkspur.sources.store import Store
from larkspur.streaming import live


@pytest.fixture
def project(tmp_path):
    code, docs = tmp_path / "code", tmp_path / "docs"
    for path, content in {"code/a.py": "def alpha():\n    return 1\n", "code/__init__.py": "init = True\n", "code/.hidden/x.py": "no\n", "code/lib/b.py": "beta\n", "code/library/c.py": "gamma words\n", "code/readme.md": "# Read\nme\n", "docs/guide.md": "# Guide\nhow alpha works\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    return configs.Config(str(tmp_path / "config.yaml"), {"p": configs.Project("p", [configs.CodeDir(str(code), [".md", ".py"], [], ["lib"])], [str(docs)], True)})


def test_tree(spark, project):
    dirs = project.projects["p"].code_dirs
    assert sorted(r.rel for r in tree.code_files(spark, dirs).collect()) == ["__init__.py", "a.py", "library/c.py"]
    assert sorted(r.rel for r in tree.document_files(spark, project.projects["p"].docs_dirs, dirs).collect()) == ["guide.md", "readme.md"]
    assert tree.code_files(spark, [configs.CodeDir("/nowhere", [".py"])]).count() == 0
    assert tree.head_commit("/nowhere") is None


def test_config_round_trip(project):
    project.save()
    got = configs.load(project.path)
    assert got.projects == project.projects and got.project_of(project.projects["p"].code_dirs[0].path + "/a.py") == "p" and got.project_of("/etc") is None
    assert configs.load("/nowhere.yaml").projects == {}
    with pytest.raises(ValueError, match="extensions"):
        configs.CodeDir("x", [])
    assert configs.parse_code_dir("C:/x:py,.cs") == configs.CodeDir("C:/x", [".py", ".cs"])


def test_golden_set(tmp_path):
    (tmp_path / "g.yaml").write_text("cases:\n- query: q\n  expected: [a]\n- query: r\n  expected: [b]\n  class: id\n")
    assert [c["query_class"] for c in configs.load_golden_set(str(tmp_path / "g.yaml"))] == ["nl", "id"]


def test_index_search_and_change(spark, project, tmp_path):
    engine = Engine(spark, project, str(tmp_path / "store"))
    engine.index()
    hits = engine.search(["alpha"], 2).collect()
    assert {h.file_path for h in hits} == {"docs/guide.md", "code/a.py"}
    before = engine.store.snapshot("chunks/p-code")
    assert engine.index() == {} and engine.store.snapshot("chunks/p-code") == before and engine.tracked_files() == 5
    rates = {(r.project, r.kind): (r.fresh, r.stale, r.unknown, r.rate) for r in engine.stale_rates().collect()}
    assert rates == {("p", "code"): (3, 0, 0, 0.0), ("p", "docs"): (2, 0, 0, 0.0)}
    code = project.projects["p"].code_dirs[0].path
    (tmp_path / "code/a.py").unlink()
    (tmp_path / "code/library/c.py").write_text("delta alpha\n")
    engine.index("p")
    assert {h.file_path for h in engine.search(["alpha"], 5, kind="code").collect()} == {"code/library/c.py", "code/__init__.py"}
    assert code and {(r.project, r.kind, r.n) for r in engine.status().collect()} >= {("p", "code", 2), ("p", "docs", 2), (None, None, 4)}
    path = engine.add_document("p", "My Notes!", "# Notes\nepsilon\n")
    assert path.endswith("my-notes.md") and engine.search(["epsilon"], 1).first().file_path == "docs/my-notes.md"
    with pytest.raises(ValueError, match="unknown"):
        engine.index("q")


def test_another_model_keeps_keywords_until_it_is_indexed(spark, project, tmp_path):
    Engine(spark, project, str(tmp_path / "store")).index()
    other = Engine(spark, project, str(tmp_path / "store"), model="other")
    assert {r.decision for r in other.plan_model(project.projects["p"]).collect()} == {"clear"}
    hits = other.search(["alpha"], 2).collect()
    assert {h.file_path for h in hits} == {"docs/guide.md", "code/a.py"}
    assert other._vectors().isEmpty()
    other.index()
    assert other._vectors().count() == 5 and {r.model for r in other.store.read("markers", "collection string, model string").collect()} == {"other"}
    assert {h.file_path for h in other.search(["alpha"], 2).collect()} == {"docs/guide.md", "code/a.py"}
    (tmp_path / "docs").rename(tmp_path / "away")
    third = Engine(spark, project, str(tmp_path / "store"), model="third")
    assert {r.kind: r.decision for r in third.plan_model(project.projects["p"]).collect()} == {"code": "clear", "docs": "blocked"}
    assert third.index() == {} and third.store.read("chunks/p-docs", "id string").count() == 2
    shadow = third.build_shadow("p", "docs", "shadow-model", "s")
    assert shadow.count() == 2 and third.build_shadow("p", "docs", "shadow-model", "s").count() == 2


def test_declarations_folders_and_failed_batches(spark, project, tmp_path):
    (tmp_path / "code/t.cs").write_text("class A\n{\n" + "    int x;\n" * 30 + "}\n\nclass B\n{\n" + "    int y;\n" * 30 + "}\n")
    project.projects["p"].code_dirs[0].extensions.append(".cs")
    engine = Engine(spark, project, str(tmp_path / "store"))
    engine.index()
    got = engine.store.read("chunks/p-code", "file_path string, start_line int, text string").filter("file_path = 'code/t.cs'").orderBy("start_line").collect()
    assert [r.start_line for r in got] == [1, 35] and got[1].text.startswith("class B")
    project.projects["p"].code_dirs[0].exclude_dirs.append("library")
    engine.index()
    assert engine.store.read("chunks/p-code", "file_path string").filter("file_path LIKE 'code/library/%'").isEmpty()
    hidden = tmp_path / "docs/.notes/n.md"
    hidden.parent.mkdir()
    hidden.write_text("# Note\nkept by wish\n")
    engine.index_document("p", str(hidden))
    assert engine.store.read("chunks/p-docs", "file_path string").filter("file_path = 'docs/.notes/n.md'").count() == 1
    with pytest.raises(ValueError, match="no folder"):
        engine.index_document("p", "/etc/hosts")


def test_prose_drift(spark, project, tmp_path, capsys):
    # functions inside a function go to the executors whole
    def extractor():
        return lambda text: [tuple(x.split("|")) for x in text.split("\n") if x.count("|") == 2]

    def judge():
        return lambda claim, fact: '{"contradicts": true, "confidence": 0.9}' if "blue" in claim else "no idea"

    (tmp_path / "docs/claims.md").write_text("# Claims\nsky|colour|green\nsea|colour|grey\nthe sky|has colour|blue\nsky|hue|grey\n")
    engine = Engine(spark, project, str(tmp_path / "store"), extractor=extractor, judge=judge)
    engine.index()
    engine.store.overwrite("facts/p", spark.createDataFrame([("sky|colour", "sky", "colour", "blue", "s1", 2, True), ("sea|colour", "sea", "colour", "grey", "s2", 1, True), ("old|x", "old", "x", "y", "s0", 1, False)], engine_facts))
    import larkspur.operators.drift as d

    least, d.scan.__defaults__ = d.scan.__defaults__, (0.2, *d.scan.__defaults__[1:])
    try:
        for calls in (2, 0):
            found = engine.prose_drift("p")
            rows = {(r.subject, r.match_type): (r.doc_object, r.fact_object, r.source) for r in found.drift.collect()}
            assert rows == {("sky", "exact"): ("green", "blue", "docs/claims.md"), ("the sky", "semantic"): ("blue", "blue", "docs/claims.md")}
            c = found.counters.first()
            assert (c.facts_scanned, c.docs_scanned, c.judge_calls, c.cap_hit) == (2, 3, calls, False)
            # three texts and two pairs, once each, with tokens and without a price
            assert sorted(r.usd for r in engine.ledger.log().filter("input_tokens > 0").collect()) == [0.0] * 5 and engine.ledger.left() == 495
        assert engine.store.read("doc_facts/p", "file_path string, subject string").count() == 4
    finally:
        d.scan.__defaults__ = least
    assert cli.prose_drift(engine, "p", 1) == 1 and cli.prose_drift(engine, "q", 1) == 2
    assert cli.prose_drift(Engine(spark, project, str(tmp_path / "store")), "p", 1) == 3
    project.projects["p"].prose_drift_enabled = False
    assert cli.prose_drift(engine, "p", 1) == 2 and "green" in capsys.readouterr().out


def test_query_cache_and_loaded_provider():
    now, asked = [0.0], []

    class Counting(providers.HashProvider):
        def embed(self, texts, **more):
            asked.extend(texts)
            return super().embed(texts, **more)

    cache = providers.QueryCache(most=2, clock=lambda: now[0])
    for texts in (["a", "b", "a"], ["b"], ["c"], ["a"]):
        assert len(cache.embed(Counting(), texts, "m")) == len(texts)
    assert asked == ["a", "b", "c", "a"]
    now[0] = 301
    cache.embed(Counting(), ["a"], "m")
    assert asked[-1] == "a" and len(asked) == 5
    loaded = providers.LoadedProvider(lambda model: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts], {"m": 2, "wide": 5}, "q: ")
    assert loaded.embed(["xy"], model="m").embeddings == [[0.6, 0.8]]
    for model, match in (("wide", "registered"), ("none", "unknown")):
        with pytest.raises(ValueError, match=match):
            loaded.embed(["x"], model=model)
    assert providers.tokens_told(ValueError("has 91,234 tokens, more than")) == 91234 and providers.tokens_told(ValueError("no")) is None


def test_older_config_form(tmp_path):
    (tmp_path / "c.yaml").write_text("projects:\n  p:\n    code_dir: /x\n    extensions: [.py]\n    include_dirs: [a]\n    exclude_dirs: [b]\n  q:\n    code_dir: /x\n    code_dirs: [{path: /y, extensions: [.py]}]\n")
    got = configs.load(str(tmp_path / "c.yaml")).projects
    assert got["p"].code_dirs == [configs.CodeDir("/x", [".py"], ["a"], ["b"])] and [d.path for d in got["q"].code_dirs] == ["/y"]


def test_cli(spark, project, tmp_path, capsys):
    top = ["--config", str(tmp_path / "c.yaml"), "--store", str(tmp_path / "s")]
    assert cli.main([*top, "project", "add", "p", "--code-dir", f"{tmp_path}/code:py", "--docs-dir", f"{tmp_path}/docs"]) == 0
    assert cli.main([*top, "index", "p"], spark) == 0
    assert cli.main([*top, "search", "alpha", "-n", "1"], spark) == 0
    assert cli.main([*top, "status"], spark) == 0
    assert cli.main([*top, "project", "remove", "p"]) == 0 and cli.main([*top, "project", "remove", "p"]) == 2
    assert "alpha" in capsys.readouterr().out


def test_providers():
    p = providers.provider("hash")
    a, b = p.embed(["x y", "x y"]).embeddings
    assert a == b and abs(sum(v * v for v in a) - 1) < 1e-9 and providers.provider("hash") is p
    with pytest.raises(ValueError, match="unknown"):
        providers.provider("none")
    tries = []

    def fails():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        providers.with_retries(fails, (OSError,), tries=3, wait=0)
    assert len(tries) == 3


def test_stream_of_files(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    schema = "file_path string, content string"
    spark.createDataFrame([("a", "one\ntwo"), ("b", "three")], schema).coalesce(1).write.json(str(source))
    run = lambda: live.keep_chunks(spark.readStream.schema(schema).json(str(source)), store, "chunks", str(tmp_path / "check")).awaitTermination()
    run()
    spark.createDataFrame([("a", "new")], schema).coalesce(1).write.mode("append").json(str(source))
    run()
    assert sorted((r.file_path, r.chunk) for r in store.read("chunks", live.CHUNKS).collect()) == [("a", "new"), ("b", "three")]
